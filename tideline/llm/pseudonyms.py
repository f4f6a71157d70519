"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format by a keyed Feistel network.

A value is taken out of its notation (the digits of a card, the payload of an IBAN, the day number of a date), permuted in
its own domain, and put back into the same notation, with check digits made anew. The same value becomes the same
pseudonym in every document and notation; the key alone decides the permutation. A Feistel network over two digit halves
adds a keyed hash of one half to the other, modulo ten to its length. Where a result is no valid value, the
permutation is walked on until it is one.

Everything is DataFrame expressions within one row: no shuffle, no Python on the executors.

Kinds: card (13 to 19 digits, Luhn), number (15 to 16 digits, grouped or not, that no Luhn check confirms), iban (mod 97),
ssn, phone (international or with an area code), ip (four octets, or IPv6, written out in full), date (ISO, or day and month first in one or
two digits; the month before the day only where the day cannot be first), email (the user part becomes 128 bits of a keyed hash, the domain example.com),
secret (hexadecimal runs of 32 and more, keys with a known first part, and values with a digit behind a name such as `password=`). A hexadecimal secret
is permuted by a Feistel network over its digits; another has each letter and digit replaced from a keyed hash of it all, for such a value has no
numeric format.

A run of groups that is no valid card or IBAN may hold one beside other digits or letters: then the longest valid run of
whole groups in it is replaced, and the rest stays.

Defined results: a null text stays null, an empty one empty. Digits outside these formats stay. Repeated rows are treated alike.
A column `pii` of the input is replaced; other columns stay, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: What is looked for, the first that matches at a place wins. Groups are not captured.
KINDS: dict[str, str] = {
    "email": r"[A-Za-z0-9À-ɏ._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "named": r"(?<![0-9A-Za-z])(?i:(?:[a-z0-9]{1,20}[_\-]){0,3}(?:password|passwd|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key))[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?=[A-Za-z+/_.~!$%^&*\-]{0,200}\d)[0-9A-Za-z+/_.~!$%^&*\-]{6,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk)[_\-](?:[a-z]{2,8}[_\-]){0,2}[0-9A-Za-z]{16,}|gh[opsru]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{30,}|xox[abeoprs]-[0-9A-Za-z\-]{10,}|AIza[0-9A-Za-z_\-]{35})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f]{0,3}\d)[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "date": r"(?<![\d\-/.])(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[/.](?:0?[1-9]|[12]\d|3[01])[/.](?:19|20)\d\d)(?![\d])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\dA-Za-z])\d(?:[ \-]?\d){12,18}(?![\dA-Za-z])",
    "phone": r"(?<![\dA-Za-z+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\dA-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without this holds none of them; it is cheap to look for.
HINT = r"\d[\d.\-/ ()]{5}|@|[0-9a-fA-F]{32}|:[0-9a-fA-F]{0,4}:|(?i:passw|pwd|passphrase|secret|token|key)|A[KS]IA|[spr]k[_\-]|gh[opsru]_|github_pat|xox|AIza"
#: What stays of a secret: the name before a value, or the first part that says whose key it is.
FIRST = r"^(?:(?i:[a-z0-9_\-]*(?:word|wd|phrase|secret|token|key))[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?|)(?:AKIA|ASIA|(?:sk|pk|rk)[_\-](?:[a-z]{2,8}[_\-]){0,2}|gh[opsru]_|github_pat_|xox[abeoprs]-|AIza|)"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(key: str, *parts: Column) -> Column:
    """A keyed hash as a number from 0 to 2 ** 60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def permute_digits(digits: Column, key: str, base: int = 10) -> Column:
    """A digit string of 2 to 36 digits to another of its length, one to one for each key, length and base 10."""
    half = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.substr(digits, F.lit(1), half).alias("a"), F.substr(digits, half + 1).alias("b"))

    def one(state: Column, k: Column) -> Column:
        # Halves change places, so each is added to in turn.
        size = F.length(state["a"])
        modulus = F.rpad(F.lit("1"), size + 1, "0").cast("decimal(20,0)")
        total = state["a"].cast("decimal(20,0)") + _hash(key, F.length(digits), k, state["b"])
        return F.struct(state["b"].alias("a"), F.lpad(F.pmod(total, modulus).cast("decimal(20,0)").cast("string"), size, "0").alias("b"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one)
    return F.when(F.length(digits) < 2, digits).otherwise(_let(end, lambda e: F.concat(e["a"], e["b"])))


def _stream(key: str, size: Column, *parts: Column) -> Column:
    """`size` hexadecimal digits, or some more, that hang on the key and on all of `parts`."""
    block = lambda i: F.sha2(F.concat_ws("/", F.lit(key), i.cast("string"), *(p.cast("string") for p in parts)), 512)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 128).cast("int")), block), "")


def _xor_hex(a: Column, b: Column) -> Column:
    """Two strings of hexadecimal digits, digit by digit; `b` is as long as `a` or longer."""
    number = lambda x: F.conv(x, 16, 10).cast("bigint")

    def piece(i: Column) -> Column:
        own = F.substr(a, 8 * i + 1, F.lit(8))
        return F.lpad(F.lower(F.hex(number(own).bitwiseXOR(number(F.substr(b, 8 * i + 1, F.length(own)))))), F.length(own), "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(a) - 1) / 8).cast("int")), piece), "")


def permute_hex(text: Column, key: str) -> Column:
    """A lower-case hexadecimal string of two digits and more to another of its length, one to one for each key and length."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))
    one = lambda s, k: F.struct(s["b"].alias("a"), _xor_hex(s["a"], _stream(key, F.length(s["a"]), F.length(text), k, s["b"])).alias("b"))
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one), lambda e: F.concat(e["a"], e["b"]))


def put_letters(value: Column, key: str) -> Column:
    """`value` with each digit and letter replaced by one of its kind, drawn from a keyed hash of it all."""
    drawn = lambda stream, i, n: F.conv(F.substr(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % n

    def letter(stream: Column, c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), drawn(stream, i, 10).cast("string")).when(c.rlike("[a-z]"), F.char(97 + drawn(stream, i, 26))).when(c.rlike("[A-Z]"), F.char(65 + drawn(stream, i, 26))).otherwise(c)

    each = F.filter(F.split(value, ""), lambda c: c != "")
    return _let(_stream(key, 2 * F.length(value), value), lambda stream: F.array_join(F.transform(each, lambda c, i: letter(stream, c, i)), ""))


def permute_below(value: Column, n: Column, key: str) -> Column:
    """A whole number below `n` (n up to 2 ** 40) to another, one to one for each key and n: digits permuted, then walked."""
    size = F.length((n - 1).cast("string"))
    step = lambda v: permute_digits(F.lpad(v.cast("string"), F.greatest(size, F.lit(2)), "0"), key).cast("bigint")
    # A cycle leaves the numbers from n on sooner or later; each walk stays outside with a chance below 0.9 (99 of 100 for n < 10).
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(200)), step(value), lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return F.when(walk < n, walk).otherwise(value)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def put_digits(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, one after the other, by `digits`."""
    state = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    each = F.filter(F.split(shape, ""), lambda c: c != "")
    filled = F.aggregate(
        each,
        state,
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substr(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))
        ),
    )
    return filled["s"]


def luhn_digit(payload: Column) -> Column:
    """The check digit that Luhn's rule puts behind a digit string."""
    reversed_ = F.filter(F.split(F.reverse(payload), ""), lambda c: c != "")
    weighed = F.transform(reversed_, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return ((10 - F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's rearranged characters (letters as 10 to 35)."""
    each = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _is_luhn(s: Column) -> Column:
    d = _digits(s)
    return luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1))


def _is_iban(s: Column) -> Column:
    flat = F.replace(s, F.lit(" "), F.lit(""))
    return _mod97(F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))) == 1


def _day(match: Column) -> Column:
    flat = F.translate(match, "/.", "--")
    return F.coalesce(F.try_to_date(match, "yyyy-MM-dd"), F.try_to_date(flat, "d-M-yyyy"), F.try_to_date(flat, "M-d-yyyy"))


def inner_run(match: Column) -> Column:
    """(before, run, after): the longest run of whole groups in a card's or IBAN's match that is a valid card or IBAN, the first of equal ones; else null."""
    cut = lambda groups, a, n: F.array_join(F.slice(groups, a, n), "")

    def valid(run: Column) -> Column:
        card = run.rlike(rf"\A(?:{KINDS['card']})\z")
        iban = run.rlike(rf"\A(?:{KINDS['iban']})\z")
        return F.when(card, _is_luhn(run)).when(iban, _is_iban(run)).otherwise(False)

    def search(groups: Column) -> Column:
        size = F.size(groups)

        def from_(a: Column) -> Column:
            def one(n: Column) -> Column:
                run = F.regexp_replace(cut(groups, a, n), r"[ \-]$", "")
                rest = F.substr(cut(groups, a, size), F.length(run) + 1)
                return F.struct(F.length(run).alias("size"), (-a).alias("first"), cut(groups, F.lit(1), a - 1).alias("before"), run.alias("run"), rest.alias("after"))

            return F.transform(F.sequence(F.lit(1), size - a + 1), one)

        return F.array_max(F.filter(F.flatten(F.transform(F.sequence(F.lit(1), size), from_)), lambda x: valid(x["run"])))

    return F.when(match.rlike(rf"\A(?:{KINDS['card']}|{KINDS['iban']})\z"), _let(F.split(match, r"(?<=[ \-])"), search))


def _groups(match: Column) -> Column:
    """The eight groups of an IPv6 address; of a shortened one with the left out ones as '0'."""
    sides = F.split(match, "::")
    left, right = (F.filter(F.split(F.coalesce(F.get(sides, F.lit(k)), F.lit("")), ":"), lambda x: x != "") for k in (0, 1))
    return F.concat(left, F.array_repeat(F.lit("0"), F.when(F.size(sides) > 1, 8 - F.size(left) - F.size(right)).otherwise(0)), right)


def kind_of(match: Column) -> Column:
    """The kind of a match of `ANY`, null where its value is not valid."""
    whole = lambda k: match.rlike(rf"\A(?:{KINDS[k]})\z")
    day = _day(match)
    return (
        F.when(whole("email"), "email").when(whole("secret") | whole("named") | whole("token"), "secret").when(whole("iban") & _is_iban(match), "iban").when(whole("ip") | (whole("ip6") & (F.size(_groups(match)) == 8)), "ip")
        .when(whole("date") & day.isNotNull(), "date").when(whole("ssn") & ~match.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$"), "ssn")
        .when(whole("card") & _is_luhn(match), "card").when(whole("card") & F.length(_digits(match)).isin(15, 16), "number").when(whole("phone"), "phone")
    )


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """The keyed stand-in for a valid match, in its format."""
    d = _digits(match)
    size = F.length(d)
    payload = lambda: permute_digits(F.substr(d, F.lit(1), size - 1), f"{key}/card")
    card = _let(payload(), lambda p: put_digits(match, F.concat(p, luhn_digit(p))))
    number = put_digits(match, permute_digits(d, f"{key}/number"))
    # The prefix (country or area code) stays, so the number stays one that is well formed there.
    phone = put_digits(match, F.concat(F.substr(d, F.lit(1), size - 7), permute_digits(F.right(d, F.lit(7)), f"{key}/phone")))
    area, group, serial = (F.substr(d, F.lit(a), F.lit(b)).cast("bigint") for a, b in ((1, 3), (4, 2), (6, 4)))
    index = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    ssn = _let(
        permute_below(index, F.lit(898 * 99 * 9999), f"{key}/ssn"),
        lambda i: _let(
            F.floor(i / (99 * 9999)) + 1,
            lambda a: F.concat_ws("-", F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(i / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((i % 9999 + 1).cast("string"), 4, "0")),
        ),
    )
    octets = F.split(match, r"\.")
    address = reduce(lambda a, k: a * 256 + F.get(octets, F.lit(k)).try_cast("bigint"), range(1, 4), F.get(octets, F.lit(0)).try_cast("bigint"))
    ip = _let(permute_below(address, F.lit(1 << 32), f"{key}/ip"), lambda v: F.concat_ws(".", *((F.floor(v / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0))))
    hex6 = permute_hex(F.array_join(F.transform(_groups(F.lower(match)), lambda g: F.lpad(g, 4, "0")), ""), f"{key}/ip6")
    ip6 = _let(hex6, lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(h, 4 * i + 1, F.lit(4)), "^0{1,3}", "")), ":"))
    ip = F.when(match.contains(":"), ip6).otherwise(ip)
    iso = match.rlike(r"^\d{4}")
    first, days = F.lit("1900-01-01").cast("date"), 73414  # to the end of 2100
    moved = F.date_add(first, permute_below(F.datediff(_day(match), first).cast("bigint"), F.lit(days), f"{key}/date").cast("int"))
    short, month_first = match.rlike(r"^\d[/.]|[/.]\d[/.]"), F.try_to_date(F.translate(match, "/.", "--"), "d-M-yyyy").isNull()

    def noted(at: Column) -> Column:
        padded = F.when(month_first, F.date_format(at, "MM-dd-yyyy")).otherwise(F.date_format(at, "dd-MM-yyyy"))
        brief = F.when(month_first, F.date_format(at, "M-d-yyyy")).otherwise(F.date_format(at, "d-M-yyyy"))
        marks, parts = F.regexp_replace(match, "[0-9]", ""), F.split(F.when(short, brief).otherwise(padded), "-")
        return F.concat(F.get(parts, F.lit(0)), F.substr(marks, F.lit(1), F.lit(1)), F.get(parts, F.lit(1)), F.substr(marks, F.lit(2), F.lit(1)), F.get(parts, F.lit(2)))

    date = F.when(iso, F.date_format(moved, "yyyy-MM-dd")).otherwise(_let(moved, noted))
    flat = F.replace(match, F.lit(" "), F.lit(""))
    account = F.substr(flat, F.lit(5))
    digits = _digits(account)
    spaced = lambda s: F.when(match.contains(" "), F.rtrim(F.regexp_replace(s, "(.{4})", "$1 "))).otherwise(s)
    bban = put_digits(account, permute_digits(digits, f"{key}/iban"))
    iban = _let(bban, lambda b: spaced(F.concat(F.substr(flat, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(F.concat(b, F.substr(flat, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), b)))
    user = F.substring(F.sha2(F.concat_ws("/", F.lit(f"{key}/email"), F.lower(match)), 256), 1, 32)
    email = F.concat(F.lit("user-"), user, F.lit("@example.com"))

    def disguised(value: Column) -> Column:
        hexed = permute_hex(F.lower(value), f"{key}/secret")
        whole = F.when(value.rlike("^[0-9a-f]{2,}$"), hexed).when(value.rlike("^[0-9A-F]{2,}$"), F.upper(hexed))
        return F.coalesce(whole, put_letters(value, f"{key}/secret"))

    secret = _let(F.regexp_extract(match, FIRST, 0), lambda first: F.concat(first, _let(F.substr(match, F.length(first) + 1), disguised)))
    out = F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "card", card).when(kind == "number", number).when(kind == "iban", iban)
    return out.when(kind == "ssn", ssn).when(kind == "ip", ip).when(kind == "date", date).when(kind == "phone", phone).otherwise(match)


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces the values in `text`, and adds `pii`: an array of (kind, value's pseudonym) in text order.

    The text is cut at the matches; each piece between them stays byte for byte.
    """
    whole = F.col(text)
    found = F.when(whole.rlike(HINT), F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    made, pairs = (next(n for n in (f"{c}{k}" for k in range(len(df.columns) + 1)) if n not in df.columns) for c in ("found", "pairs"))
    marked = df.withColumn(made, found)
    # Of a match that is no value itself, the run within it; a match that is one is all run.
    within = lambda m, k: F.coalesce(F.when(k.isNull(), inner_run(m)), F.struct(F.lit(0).alias("size"), F.lit(0).alias("first"), F.lit("").alias("before"), m.alias("run"), F.lit("").alias("after")))
    paired = lambda r: _let(kind_of(r["run"]), lambda k: F.struct(k.alias("kind"), F.concat(r["before"], pseudonym(r["run"], k, key), r["after"]).alias("value")))
    as_pairs = F.transform(made, lambda m: _let(_let(kind_of(m), lambda k: within(m, k)), paired))
    marked = marked.withColumn(pairs, F.when(F.size(made) > 0, as_pairs).otherwise(F.array().cast("array<struct<kind:string,value:string>>")))
    pieces = F.split(whole, ANY, -1)
    joined = F.array_join(F.zip_with(pieces, pairs, lambda piece, pair: F.concat(piece, F.coalesce(pair["value"], F.lit("")))), "")
    replaced = F.when(F.size(made) > 0, joined).otherwise(whole)
    return marked.withColumn(text, replaced).withColumn("pii", F.filter(pairs, lambda p: p["kind"].isNotNull())).drop(made, pairs)


def op5_pseudonyms(documents: DataFrame, key: str) -> DataFrame:
    """doc_id, n_pii, kinds (of each value, in text order), text with the pseudonyms."""
    out = pseudonymise(documents.select("doc_id", "text"), key)
    return out.select("doc_id", F.size("pii").cast("long").alias("n_pii"), F.transform("pii", lambda p: p["kind"]).alias("kinds"), "text")
