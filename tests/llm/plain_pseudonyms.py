"""The pseudonyms in plain Python, value by value, for comparison."""

from __future__ import annotations

import datetime
import hashlib

import regex

from tideline.llm import pseudonyms as P

ANY = regex.compile(P.ANY)
WHOLE = {k: regex.compile(rf"(?:{p})\Z") for k, p in P.KINDS.items()}


def digest(*parts, size=256):
    return hashlib.new(f"sha{size}", "/".join(map(str, parts)).encode()).hexdigest()


def feistel(digits, key):
    if len(digits) < 2:
        return digits
    a, b = digits[: len(digits) // 2], digits[len(digits) // 2 :]
    for k in range(1, P.ROUNDS + 1):
        n = int(digest(key, len(digits), k, b)[:15], 16)
        a, b = b, str((int(a) + n) % 10 ** len(a)).zfill(len(a))
    return a + b


def below(value, n, key):
    size = max(len(str(n - 1)), 2)
    for _ in range(201):
        value = int(feistel(str(value).zfill(size), key))
        if value < n:
            return value
    raise AssertionError


def stream(key, size, *parts):
    return "".join(digest(key, i, *parts, size=512) for i in range((size - 1) // 128 + 1))


def hexed(text, key):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for k in range(1, P.ROUNDS + 1):
        s = stream(key, len(a), len(text), k, b)
        a, b = b, "".join(f"{int(x, 16) ^ int(y, 16):x}" for x, y in zip(a, s))  # noqa: B905
    return a + b


def put(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in shape)


def luhn(payload):
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def day_of(m):
    for f in ("%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y"):
        try:
            return datetime.datetime.strptime(m.replace("/", "-").replace(".", "-") if f != "%Y-%m-%d" else m, f).date(), f
        except ValueError:
            pass
    return None, None


def kind(m):
    digits = "".join(c for c in m if c in "0123456789")
    whole = lambda k: WHOLE[k].match(m)
    flat = m.replace(" ", "")
    if whole("email"):
        return "email"
    if whole("secret") or whole("named") or whole("token"):
        return "secret"
    if whole("iban") and mod97(flat[4:] + flat[:4]) == 1:
        return "iban"
    if whole("ip") or (whole("ip6") and len(groups(m)) == 8):
        return "ip"
    if whole("date") and day_of(m)[0]:
        return "date"
    if whole("ssn") and not regex.search(r"^(?:000|666|9\d\d)|-00-|-0000$", m):
        return "ssn"
    if whole("card") and luhn(digits[:-1]) == digits[-1]:
        return "card"
    if whole("card") and len(digits) in (15, 16):
        return "number"
    return "phone" if whole("phone") else None


def groups(m):
    left, mark, right = m.partition("::")
    x, y = [g for g in left.split(":") if g], [g for g in right.split(":") if g]
    return x + ["0"] * (8 - len(x) - len(y) if mark else 0) + y


def stand_in(m, k, key):
    digits = "".join(c for c in m if c in "0123456789")
    if k == "card":
        p = feistel(digits[:-1], f"{key}/card")
        return put(m, p + luhn(p))
    if k == "number":
        return put(m, feistel(digits, f"{key}/number"))
    if k == "phone":
        return put(m, digits[:-7] + feistel(digits[-7:], f"{key}/phone"))
    if k == "ssn":
        a, g, s = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        i = below(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, f"{key}/ssn")
        a = i // (99 * 9999) + 1
        return f"{a + (a >= 666):03d}-{i // 9999 % 99 + 1:02d}-{i % 9999 + 1:04d}"
    if k == "ip" and ":" in m:
        h = hexed("".join(g.zfill(4) for g in groups(m.lower())), f"{key}/ip6")
        return ":".join(h[4 * i : 4 * i + 4].lstrip("0") or "0" for i in range(8))
    if k == "ip":
        o = list(map(int, m.split(".")))
        v = below(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 1 << 32, f"{key}/ip")
        return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    if k == "date":
        day, f = day_of(m)
        first = datetime.date(1900, 1, 1)
        to = first + datetime.timedelta(below((day - first).days, 73414, f"{key}/date"))
        if f == "%Y-%m-%d":
            return to.isoformat()
        short = regex.search(r"^\d[/.]|[/.]\d[/.]", m)
        parts = [to.month, to.day] if f == "%m-%d-%Y" else [to.day, to.month]
        marks = regex.sub("[0-9]", "", m)
        return f"{parts[0]:{'' if short else '02'}}{marks[0]}{parts[1]:{'' if short else '02'}}{marks[1]}{to.year}"
    if k == "iban":
        flat = m.replace(" ", "")
        b = put(flat[4:], feistel("".join(c for c in flat[4:] if c.isdigit()), f"{key}/iban"))
        out = f"{flat[:2]}{98 - mod97(b + flat[:2] + '00'):02d}{b}"
        return " ".join(out[i : i + 4] for i in range(0, len(out), 4)) if " " in m else out
    if k == "email":
        return f"user-{digest(f'{key}/email', m.lower())[:32]}@example.com"
    if k == "secret":
        first = regex.match(P.FIRST, m)[0]
        v = m[len(first) :]
        if regex.fullmatch("[0-9a-f]{2,}|[0-9A-F]{2,}", v):
            h = hexed(v.lower(), f"{key}/secret")
            return first + (h if regex.fullmatch("[0-9a-f]+", v) else h.upper())
        s = stream(f"{key}/secret", 2 * len(v), v)
        drawn = [int(s[2 * i : 2 * i + 2], 16) for i in range(len(v))]
        return first + "".join(str(d % 10) if c in "0123456789" else chr(97 + d % 26) if "a" <= c <= "z" else chr(65 + d % 26) if "A" <= c <= "Z" else c for c, d in zip(v, drawn))  # noqa: B905
    return m


def inner(m):
    cuts = regex.split(r"(?<=[ \-])", m, flags=regex.V1)
    best = None
    for a in range(len(cuts)):
        for n in range(1, len(cuts) - a + 1):
            run = regex.sub(r"[ \-]$", "", "".join(cuts[a : a + n]))
            ok = (WHOLE["card"].match(run) and luhn("".join(c for c in run if c.isdigit())[:-1]) == run[-1]) or (
                not WHOLE["card"].match(run) and WHOLE["iban"].match(run) and mod97(run.replace(" ", "")[4:] + run.replace(" ", "")[:4]) == 1
            )
            if ok and (best is None or len(run) > len(best[1])):
                before = "".join(cuts[:a])
                best = (before, run, m[len(before) + len(run) :])
    return best


def pseudonymise(text, key):
    """The new text and the kinds in it."""
    kinds = []

    def one(match):
        m = match[0]
        k, parts = kind(m), ("", m, "")
        if k is None and (WHOLE["card"].match(m) or WHOLE["iban"].match(m)):
            parts = inner(m) or parts
            k = kind(parts[1])
        if k:
            kinds.append(k)
        return parts[0] + stand_in(parts[1], k, key) + parts[2]

    return (text, kinds) if not text or not regex.search(P.HINT, text) else (ANY.sub(one, text), kinds)
