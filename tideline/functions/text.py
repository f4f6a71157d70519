"""Text functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and their letters, words that end in a full stop without ending a sentence, calibrated phrases
# (one that begins like another comes before it), and words that change a question's sense.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
ABBREVIATIONS = ("fig", "eq", "no", "al", "cf", "ca", "approx", "dr", "mr", "mrs", "ms", "prof", "vs", "st", "sr", "jr", "e.g", "i.e", "etc")
CALIBRATED = (
    "virtually certain", "more likely than not", "about as likely as not", "extremely likely", "extremely unlikely", "very likely", "very unlikely",
    "unlikely", "likely", "very high confidence", "high confidence", "medium confidence", "low confidence",
)
VETO = ("not", "never", "no", "will", "would", "could", "might", "may", "is")
#: Characters that a permitted context lets show.
EXCERPT = {"open": 600, "non-commercial-educational": 300, "permission-on-file": 300}


def let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise_text(text: Column) -> Column:
    """Words broken over a line end joined again; ligatures as letters."""
    out = F.regexp_replace(text, r"(?U)(?<=\w)-\n(?=\w)", "")
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return out


_MARKER = r"(?<=[A-Za-z)\]\"'”’])([.!?])(?:(\d{1,3})(?=\s|$)|\s+(\d{1,3})(?=\s+[A-Z]|\s*$))"
_SHIELDED = "(?i)(?<![A-Za-z])(?:" + "|".join(a.split(".")[-1] for a in ABBREVIATIONS) + r")\."


def strip_note_markers(text: Column) -> Column:
    """Without reference numbers that stand behind a sentence's end, but for those after an abbreviation."""
    guard = "(?<!(?i:" + "|".join(rf"(?<![A-Za-z]){a.split('.')[-1]}" for a in ABBREVIATIONS) + "))"
    return F.regexp_replace(text, guard + _MARKER, "$1")


def note_markers(text: Column) -> Column:
    guard = "(?<!(?i:" + "|".join(rf"(?<![A-Za-z]){a.split('.')[-1]}" for a in ABBREVIATIONS) + "))"
    found = F.regexp_extract_all(text, F.lit(guard + _MARKER), F.lit(0))
    return F.transform(found, lambda m: F.regexp_extract(m, r"(\d+)$", 1))


def split_sentences(text: Column) -> Column:
    """Sentences: cut between a sentence end and a capital, but not after an abbreviation. One pass marks the joints, one cuts at the others."""
    parts = F.split(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), r"(?<=[.!?])\s+(?=[A-Z])")
    last_word = lambda s: F.lower(F.rtrim(F.regexp_extract(s, r"(\S+)\s*$", 1), F.lit(".")))
    glue = F.transform(parts, lambda part: F.concat(part, F.when(last_word(part).isin(*ABBREVIATIONS), " ").otherwise("\x01")))
    return F.filter(F.transform(F.split(F.array_join(glue, ""), "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def count_tokens(text: Column) -> Column:
    """Words and single other signs."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def estimate_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def confidence_markers(text: Column) -> Column:
    """Calibrated phrases in the order they are first met, but for quoted, hyphenated and negated ones."""
    quoted = r"\"[^\"\n]*\"|“[^”\n]*”|‘[^’\n]*’|(?U)(?<!\w)'[^'\n]*'(?!\w)"
    bare = F.regexp_replace(text, quoted, "\x00")
    phrase = "|".join(CALIBRATED)
    found = F.regexp_extract_all(bare, F.lit(rf"(?i)(?:\b(?:not|cannot|never)\b(?:\s+\w+){{0,2}}\s+)?(?<![\w\-])(?:{phrase})\b"), F.lit(0))
    low = F.transform(found, lambda m: F.lower(m))
    positive = ("more likely than not", "extremely likely", "very likely", "likely")
    name = lambda m: F.regexp_extract(m, rf"({phrase})$", 1)
    kept = F.filter(low, lambda m: ~(m.rlike(r"^(not|cannot|never)\b") & name(m).isin(*positive)))
    return F.array_distinct(F.transform(kept, name))


def strip_separator_rows(cells: Column) -> Column:
    return F.array_join(F.filter(F.split(cells, "\n"), lambda r: ~r.rlike(r"^[\s|:-]*-[\s|:-]*$")), "\n")


def context_header(title: Column, path: Column, arrow: str = " → ") -> Column:
    return F.array_join(F.concat(F.array(title), F.coalesce(path, F.array().cast("array<string>"))), arrow)


def chunk_id(doc: Column, path: Column, body: Column, occurrence: Column | None = None) -> Column:
    """The id of a passage: its document and 16 digits of a hash of document, section, body and, from the second on, ordinal."""
    raw = F.concat_ws("\x1f", doc, F.array_join(path, "\x1e"), body)
    if occurrence is not None:
        raw = F.concat(raw, F.when(occurrence > 0, F.concat(F.lit("\x1f#"), occurrence.cast("string"))).otherwise(""))
    return F.concat(doc, F.lit(":"), F.substring(F.sha2(raw, 256), 1, 16))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def licence_of_url(url: Column) -> Column:
    """The licence that a Creative Commons address names, the most specific fragment first."""
    low = F.lower(url)
    out = F.when(~low.rlike(r"creativecommons\.org/"), F.lit(None))
    for name in ("by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by"):
        out = out.when(low.contains(f"/licenses/{name}/"), f"cc-{name}")
    return out.when(low.contains("/publicdomain/zero/"), "cc0").otherwise(F.lit(None))


def statement_licence(text: Column) -> Column:
    """The licence that a sentence states: riders before the bare attribution."""
    low = F.lower(text)
    cc = low.rlike(r"creative commons|\bcc[ -]by")
    has = lambda a, b: low.rlike(rf"{a}|\b{b}\b")
    nc, nd, sa = has("non-?commercial", "nc"), has("no-?deriv", "nd"), has("share-?alike", "sa")
    return (
        F.when(cc & nc & nd, "cc-by-nc-nd").when(cc & nc & sa, "cc-by-nc-sa").when(cc & nc, "cc-by-nc").when(cc & nd, "cc-by-nd").when(cc & sa, "cc-by-sa")
        .when(cc & low.rlike(r"attribution|\bby\b|cc[ -]by"), "cc-by")
    )


def is_doi(doi: Column) -> Column:
    return doi.rlike(r"^10\.\d{4,9}/\S+$")


def normalise_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def veto_profile(question: Column) -> Column:
    """Negations and modal words of a question, sorted; a word in n't counts as its base and not."""
    tokens = F.regexp_extract_all(F.lower(question), F.lit("[a-z']+"), F.lit(0))
    parts = F.flatten(F.transform(tokens, lambda t: F.when(t.endswith("n't"), F.array(F.regexp_replace(t, "n't$", ""), F.lit("not"))).otherwise(F.array(t))))
    return F.array_sort(F.array_intersect(parts, F.array(*map(F.lit, VETO))))


def chart_slug(raw: Column) -> Column:
    """Blanks and underscores as hyphens, other signs gone, hyphens single and inside, 64 characters at most."""
    low = F.regexp_replace(F.regexp_replace(F.lower(raw), r"(?U)[\s_]+", "-"), r"[^a-z0-9-]+", "")
    return F.rtrim(F.substring(F.btrim(F.regexp_replace(low, "-+", "-"), F.lit("-")), 1, 64), F.lit("-"))


NEGATIONS = ("not", "never", "no", "cannot")


def _term_in(text: Column, term: str) -> tuple[Column, Column]:
    """Whether a phrase stands in the text as whole words in a row, and whether the first time right behind a negation."""
    words = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), " ")
    phrase = " ".join(term.lower().split())
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    before = F.substring_index(padded, f" {phrase} ", 1)
    there = F.instr(padded, f" {phrase} ") > 0
    return there, there & F.element_at(F.split(before, " "), -1).isin(*NEGATIONS)


def term_preserved(source: Column, answer: Column, term: str) -> Column:
    """Whether the answer has a calibrated term with the polarity that it has in the source."""
    (_, source_negated), (there, negated) = _term_in(source, term), _term_in(answer, term)
    return there & (source_negated == negated)


def any_calibrated(text: Column) -> Column:
    out = F.lit(False)
    for term in CALIBRATED:
        out = out | _term_in(text, term)[0]
    return out


def strip_json_fence(text: Column) -> Column:
    """Without one fence around the whole text."""
    return F.regexp_replace(text, r"(?s)\A\s*```(?:json)?\s*\n(.*?)\n?```\s*\z", "$1")


def verdict_of(text: Column, schema: str) -> Column:
    """A verdict as a struct; null fields where it cannot be read."""
    return F.from_json(strip_json_fence(text), schema, {"mode": "PERMISSIVE"})


def tokens_at_least(text: Column) -> Column:
    """A low estimate: a quarter of the length, runs of four equal signs or more counted once."""
    return F.floor(F.length(F.regexp_replace(text, r"([^\w\s])\1{3,}|(\s)\2{3,}", "$1$2")) / 4)


def within_budget(seconds: Column, budget: float) -> Column:
    return seconds <= budget


def differing_fields(published: Column, current: Column, fields: list[str]) -> Column:
    """Names of the fields that differ between two maps; one that is missing differs."""
    return F.array_compact(F.array(*(F.when(published[f].isNull() | ~published[f].eqNullSafe(current[f]), F.lit(f)) for f in fields)))


def degenerate(text: Column) -> Column:
    """Whether text is garbled: a byte order mark, full-width forms, or signs that stand for plain letters it does not have."""
    def one(t: str | None) -> bool | None:
        if t is None:
            return None
        if any(c == "\ufeff" or 0xFF00 <= ord(c) <= 0xFFEF for c in t):
            return True
        plain = {c for c in t if c.isascii() and c.isalnum()}
        strange = {c for c in t if not c.isascii() and not unicodedata.decomposition(c).startswith(("<sub>", "<super>"))}
        return any(n.isascii() and n.isalnum() and n not in plain for c in strange for n in unicodedata.normalize("NFKC", c))

    @F.pandas_udf("boolean")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    return run(text)


def carries_terms(text: Column, groups: list[list[str]]) -> Column:
    """Whether each group has a term that stands in the text as a whole word."""
    out = F.lit(True)
    for terms in groups:
        out = out & F.lower(text).rlike(r"\b(?:" + "|".join(map(str.lower, terms)) + r")\b")
    return out


def decline(answer: Column, marker: str) -> Column:
    """Whether the first line is the marker, and what follows it."""
    first = F.trim(F.substring_index(answer, "\n", 1))
    rest = F.when(F.instr(answer, "\n") > 0, F.trim(F.substr(answer, F.instr(answer, "\n") + 1))).otherwise("")
    return F.struct((first == marker).alias("declined"), F.when(first == marker, rest).otherwise(answer).alias("text"))


def sentence_spans(text: Column, sentences: Column) -> Column:
    """[start, end) of each sentence, looked for from where the one before ends."""
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        return let(
            F.locate_from(text, s, acc["at"]) if hasattr(F, "locate_from") else F.position(s, text, acc["at"]),
            lambda p: F.when(p > 0, F.struct((p + F.length(s)).alias("at"), F.concat(acc["spans"], F.array(F.struct((p - 1).cast("int").alias("start"), (p - 1 + F.length(s)).cast("int").alias("end")))).alias("spans"))).otherwise(acc),
        )

    return F.aggregate(sentences, state, step, lambda acc: acc["spans"])


def bounded_excerpt(body: Column, context: Column) -> Column:
    """The first part of a body that its permitted context lets show; null where the context is another."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, size in EXCERPT.items():
        out = out.when(context == name, F.substring(body, 1, size))
    return out


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC by two nested hashes with padded keys; `key` has 64 bytes at most."""
    if len(key) > 64:
        raise ValueError("the key has more than 64 bytes")
    pad = lambda mask: F.unhex(F.lit(bytes(b ^ mask for b in key.ljust(64, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def client_ip(host: Column, forwarded: Column, trusted: Column) -> Column:
    first = F.nullif(F.trim(F.substring_index(forwarded, ",", 1)), F.lit(""))
    return F.coalesce(F.when(trusted, first), F.nullif(F.trim(host), F.lit("")), F.lit("unknown"))


def two_figures(value: Column, how: str = "point") -> Column:
    """A number to two significant figures in plain notation: a point rounded half up, range ends down (low) or up (high)."""
    size = F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), 1 - size)
    scaled = F.round(value * scale, 9)
    out = {"point": F.floor(scaled + 0.5), "low": F.floor(scaled), "high": F.ceil(scaled)}[how] / scale
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(out, 12))


def fact_sentence(day: Column, count: Column, label: Column) -> Column:
    number = F.call_function("format_number", count, F.lit("#,##0.##########"))
    return F.concat(F.lit("As of "), F.date_format(day, "d MMMM yyyy"), F.lit(", there were "), number, F.lit(" "), label)


def refusal_text(lines: list[str], topics: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.array(*map(F.lit, lines)), F.transform(topics, lambda t: F.concat(F.lit("- "), t))))


def looks_like_prose(text: Column) -> Column:
    return (estimate_tokens(text) >= 12) & F.rtrim(text).rlike(r"[.!?]$")


def looks_like_html(content: Column) -> Column:
    return F.lower(F.ltrim(F.substring(content, 1, 512))).rlike(r"^(<!doctype html|<html|<head|<body)")
