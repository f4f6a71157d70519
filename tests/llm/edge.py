"""Documents with every awkward case, and plain-Python versions of what operators count."""

from __future__ import annotations

import random
import re
from collections import Counter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


def prose(rng, n, alphabet=None):
    alphabet = alphabet or ["the", "of", "and", "tion", "ser", "lem", "ontic", "vara", "mint", "gol", "resh", "est"]
    return " ".join(rng.choice(alphabet) + rng.choice(["", "", rng.choice(alphabet)]) for _ in range(n))


def rows():
    """Null and empty texts, null columns, ties, repeated rows, a very long text, copies and near copies."""
    rng = random.Random(3)
    base = prose(rng, 200)
    near = " ".join(w if k % 60 else "changed" for k, w in enumerate(base.split()))
    out = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1), (4, None, "en", "a", None), (5, "", None, None, 0), (6, " \t\n ", "en", "b", 3),
        (7, "one two", "en", None, 7), (8, "One  TWO", "en", "b", 8), (9, prose(rng, 30000), "en", "a", 9), (10, "x\n" * 50, "de", "c", 100),
        (11, prose(rng, 90), "en", "c", 11), (11, prose(rng, 90), "en", "c", 11), (12, "Ünï 中文  é", "fr", "c", 5), (13, "| a | b | " * 40, "en", "a", 400),
    ]
    return out + [(100 + k, prose(rng, 60 + k), rng.choice(["en", "de"]), rng.choice("abc"), 60) for k in range(40)]


def groups(rows: list[tuple], width: int, percent: int) -> list[int]:
    """For each (id, text) the first row of its group, over all pairs of rows."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            low, high = sorted((len(sets[a]), len(sets[b])))
            if low and 100 * low >= percent * high and (common := len(sets[a] & sets[b])) and 100 * common >= percent * (low + high - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(rows))]


def components(rows: list[tuple], width: int, percent: int) -> list:
    """For each (id, text) the least id of its group; an id of None comes last."""
    of, least = groups(rows, width, percent), {}
    for (i, _), r in zip(rows, of, strict=True):
        least[r] = i if least.get(r) is None else min(least[r], least[r] if i is None else i)
    return [least[r] for r in of]


def quality_counts(text):
    w = words(text, lower=False)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
