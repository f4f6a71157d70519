"""Language identification by interpolated Kneser-Ney character models, one for each language.

Characters are the lower-cased letters of words (runs of letters), each word padded by a boundary. Counts of strings of up to
`ORDER` characters are interpolated down to single ones with Kneser-Ney continuation counts. A string's log probabilities
under all languages are one row of a matrix beside a sorted array of string hashes; strings that are not in it fall to their
suffix at a back-off cost kept in a second such array. A text's language is the one of the least cross-entropy per character.
The score is the share of that language in a softmax of the length-normalised entropies, whose temperature is fitted on
training texts left out of the counts; below the calibrated threshold the prediction is marked as rejected.

The models are fitted on a bounded sample of labelled rows: of each language the texts of up to `SHORT` characters that come first by
a hash of id and text, `SAMPLE` of them or as many as have `SAMPLE_CHARS` characters, `FEWEST` at least; longer ones only where there are
fewer of these. A fifth of them fits temperature and threshold. Every text is scored whole. Distinct words of a
batch are scored once.

Defined results: null texts and texts without a letter are `und` with score 0 and not rejected. Without any learned language
all are `und`. Ties go to the first language by name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .shared import remainder

ORDER = 5
#: Labelled texts of each language that the models are fitted on, and characters of them that are counted.
SAMPLE, SAMPLE_CHARS = 1500, 1_500_000
#: Length up to which a labelled text is preferred, so that no few texts use up the characters, and texts that a language has at least.
SHORT, FEWEST = 50_000, 20
#: Precision that the rejection threshold is set for.
PRECISION = 0.995

_U = np.uint64
_tables: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    """For each code point: that of its lower-cased letter, 0 for all that are no letters."""
    if not _tables:
        table = np.zeros(0x110000, np.uint32)
        for cp in [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x3FFFF)]:
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else ord(unicodedata.normalize("NFD", low)[0])
        _tables.append(table)
    return _tables[0]


def letter_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: lo, hi, letters (0 between words), starts and ends of words in them, offsets of rows in words."""
    raw, offs = H.text_buffers(column)
    table = letter_classes()
    for lo, hi in H.row_chunks(offs):
        text = bytes(raw[offs[lo] : offs[hi]]).decode("utf-8", "replace")
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = (raw[offs[lo] : offs[hi]] & 0xC0) != 0x80
        cut = np.concatenate([[0], np.cumsum(lead)])[offs[lo : hi + 1] - offs[lo]]
        letters = table[code]
        word = letters > 0
        edge = np.zeros(len(word) + 1, bool)
        edge[cut] = True
        before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
        starts = np.flatnonzero(word & (~before | edge[:-1])) if len(word) else np.zeros(0, np.int64)
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1 if len(word) else np.zeros(0, np.int64)
        yield lo, hi, letters, starts, ends, np.searchsorted(starts, cut)


def word_keys(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = H._power_tables(len(letters))
    total = np.zeros(len(letters) + 1, _U)
    np.cumsum((letters.astype(_U) + _U(1)) * power[: len(letters)], out=total[1:])
    return H.mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def grams(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the strings of 1 to ORDER symbols that end at each symbol of each word (its letters, then a boundary).

    A word is preceded by one boundary; a string that would begin before that is 0. Also the offsets of words in symbols.
    """
    length = ends - starts
    size = length + 2
    offs = np.concatenate([[0], np.cumsum(size)])
    flat = np.ones(int(offs[-1]), _U)  # 1: the boundary, no letter's code point
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    flat[np.repeat(offs[:-1] + 1, length) + inside] = letters[np.repeat(starts, length) + inside]
    place = np.arange(len(flat)) - np.repeat(offs[:-1], size)
    out, rolled = [], np.zeros(len(flat), _U)
    shifted = flat
    for n in range(1, ORDER + 1):
        rolled = rolled + (shifted + _U(7)) * _U(pow(0xD6E8FEB86659FD93, n, 1 << 64))
        full = H.mix(rolled + _U(n))
        out.append(np.where(place >= n - 1, full, _U(0)))
        shifted = np.concatenate([np.zeros(1, _U), shifted[:-1]])
    return out, offs


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by order: sorted hashes of strings
    logs: list[np.ndarray]  # natural log probabilities of the last symbol, a column for each language
    contexts: list[np.ndarray]  # by length: sorted hashes of contexts
    backs: list[np.ndarray]  # log back-off weights, a column for each language
    floor: float
    temperature: float = 1.0
    threshold: float = 0.0

    def symbols(self, strings: list[np.ndarray]) -> np.ndarray:
        """Log probability of each symbol under each language."""
        n = len(strings[0])
        out = np.zeros((n, len(self.languages)))
        open_ = np.arange(n)
        for k in range(ORDER, 0, -1):
            h = strings[k - 1][open_]
            at = np.minimum(np.searchsorted(self.keys[k - 1], h), max(len(self.keys[k - 1]) - 1, 0))
            hit = (self.keys[k - 1][at] == h) & (h != 0) if len(self.keys[k - 1]) else np.zeros(len(h), bool)
            out[open_[hit]] += self.logs[k - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            if k > 1:  # the context is the string of k - 1 symbols that ends one before
                c = strings[k - 2][open_ - 1]
                at = np.minimum(np.searchsorted(self.contexts[k - 2], c), max(len(self.contexts[k - 2]) - 1, 0))
                hit = (self.contexts[k - 2][at] == c) & (strings[k - 1][open_] != 0) if len(self.contexts[k - 2]) else np.zeros(len(c), bool)
                out[open_[hit]] += self.backs[k - 2][at[hit]]
        out[open_] += self.floor
        return out


def _counted(keys: np.ndarray, suffix: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct strings, ascending, with their suffix, context and summed counts."""
    keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return keys, suffix[first], context[first], np.bincount(inverse, n, len(keys))


def fit(samples: dict[str, pa.Array]) -> Model:
    """Interpolated Kneser-Ney models of the texts of each language."""
    languages = sorted(samples)
    counts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
    for language in languages:
        parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ORDER)]
        for _, _, letters, starts, ends, _ in letter_words(samples[language]):
            strings, offs = grams(letters, starts, ends)
            inner = np.ones(len(strings[0]), bool)
            inner[offs[:-1]] = False  # the boundary before a word is given
            for k in range(ORDER):
                suffix = strings[k - 1] if k else np.zeros_like(strings[0])
                context = np.concatenate([np.zeros(1, _U), (strings[k - 1] if k else np.zeros_like(strings[0]))[:-1]])
                use = inner & (strings[k] != 0)
                parts[k].append(_counted(strings[k][use], suffix[use], context[use], np.ones(int(use.sum()))))
        by_order = []
        for k in range(ORDER):
            whole = [np.concatenate(c) for c in zip(*parts[k], strict=True)] if parts[k] else [np.zeros(0, _U)] * 3 + [np.zeros(0)]
            by_order.append(_counted(*whole))
            parts[k] = []
        counts.append(by_order)
    symbols = max((len(c[0][0]) for c in counts), default=0) + 64
    floor = -np.log(symbols * 4.0)
    logs: list[list[dict]] = []
    for by_order in counts:
        lower: np.ndarray | None = None
        lower_keys: np.ndarray | None = None
        own = []
        for k in range(ORDER):
            keys, suffix, context, n = by_order[k]
            if k + 1 < ORDER:  # continuation counts: how many distinct symbols stand before the string
                above_keys, above_suffix, _, _ = by_order[k + 1]
                uniq, c = np.unique(above_suffix, return_counts=True)
                at = np.minimum(np.searchsorted(uniq, keys), max(len(uniq) - 1, 0))
                cont = np.where(uniq[at] == keys, c[at], 0).astype(float) if len(uniq) else np.zeros(len(keys))
                n = np.where(cont > 0, cont, n if k else np.minimum(n, 1.0))
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, n, len(ctx)), np.bincount(inverse, minlength=len(ctx))
            gamma = d * kinds / np.maximum(total, 1e-9)
            if k == 0:
                below = np.full(len(keys), np.exp(floor))
            else:
                below = lower[np.minimum(np.searchsorted(lower_keys, suffix), len(lower_keys) - 1)]
            p = np.maximum(n - d, 0) / np.maximum(total[inverse], 1e-9) + gamma[inverse] * below
            own.append({"keys": keys, "p": np.log(p), "ctx": ctx, "gamma": np.log(np.maximum(gamma, 1e-9)), "suffix": suffix, "context": context})
            lower, lower_keys = p, keys
        logs.append(own)
    model = Model(languages, [], [], [], [], floor)
    for k in range(ORDER):
        keys = np.unique(np.concatenate([o[k]["keys"] for o in logs])) if logs else np.zeros(0, _U)
        ctx = np.unique(np.concatenate([o[k]["ctx"] for o in logs])) if logs else np.zeros(0, _U)
        # Strings that a language has not seen get what its shorter ones give.
        suffix, context = np.zeros(len(keys), _U), np.zeros(len(keys), _U)
        for o in logs:
            at = np.searchsorted(keys, o[k]["keys"])
            suffix[at], context[at] = o[k]["suffix"], o[k]["context"]
        p, g = np.zeros((len(keys), len(languages)), np.float32), np.zeros((len(ctx), len(languages)), np.float32)
        for j, o in enumerate(logs):
            at = np.searchsorted(ctx, o[k]["ctx"])
            g[at, j] = o[k]["gamma"]
            back = g[np.searchsorted(ctx, context), j]
            if k:
                below = model.logs[k - 1][np.minimum(np.searchsorted(model.keys[k - 1], suffix), len(model.keys[k - 1]) - 1), j]
            else:
                below = np.full(len(keys), floor)
            p[:, j] = back + below
            p[np.searchsorted(keys, o[k]["keys"]), j] = o[k]["p"]
        model.keys.append(keys)
        model.logs.append(p)
        if k:  # the first order has one context, the empty one
            model.contexts.append(ctx)
            model.backs.append(g)
    return model


def entropies(model: Model, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: lo, hi, cross-entropy per symbol under each language, symbols (0: no letter)."""
    for lo, hi, letters, starts, ends, cut in letter_words(column):
        n = hi - lo
        total, size = np.zeros((n, len(model.languages))), np.zeros(n)
        if len(starts):
            keys = word_keys(letters, starts, ends)
            _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            strings, offs = grams(letters, starts[first], ends[first])
            per = model.symbols(strings)
            per[offs[:-1]] = 0.0
            word = np.add.reduceat(per, offs[:-1], axis=0)[inverse]
            run = np.concatenate([np.zeros((1, word.shape[1])), np.cumsum(word, axis=0)])
            total = run[cut[1:]] - run[cut[:-1]]
            length = np.concatenate([[0], np.cumsum(ends - starts + 1)])
            size = (length[cut[1:]] - length[cut[:-1]]).astype(float)
        yield lo, hi, -total / np.maximum(size, 1)[:, None], size


def confidence(entropy: np.ndarray, temperature: float) -> np.ndarray:
    z = -(entropy - entropy.min(axis=1, keepdims=True)) / temperature
    e = np.exp(z)
    return e.max(axis=1) / e.sum(axis=1)


def calibrate(model: Model, column: pa.Array, truth: list[str]) -> None:
    """Fits the temperature (by likelihood) and the threshold (the least score above which `PRECISION` are right)."""
    parts = [(e, s) for _, _, e, s in entropies(model, column)]
    if not parts:
        return
    e, s = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    index = {name: k for k, name in enumerate(model.languages)}
    y = np.array([index.get(t, -1) for t in truth])
    use = (s > 0) & (y >= 0)
    if not use.any():
        return
    e, y = e[use], y[use]

    def loss(t: float) -> float:
        z = -(e - e.min(axis=1, keepdims=True)) / t
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    model.temperature = min(np.geomspace(0.01, 3.0, 40), key=loss)
    score, right = confidence(e, model.temperature), e.argmin(axis=1) == y
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    model.threshold = float(score[order[good[-1]]]) if len(good) else 1.0


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = pa.array([*model.languages, "und"])
    for batch in batches:
        for lo, hi, e, s in entropies(model, batch.column("text")):
            n = hi - lo
            known = (s > 0) & bool(model.languages)
            best = np.where(known, e.argmin(axis=1) if model.languages else 0, len(model.languages))
            score = np.where(known, confidence(e, model.temperature), 0.0) if model.languages else np.zeros(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, n), batch.column("held_out").slice(lo, n), names.take(pa.array(best)), pa.array(score), pa.array(known & (score < model.threshold)), pa.array(s.astype(np.int64))],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected", "n_symbols"],
            )


def learn(docs: DataFrame, held_out: Column) -> Model:
    """Fits the model on rows with a text and a lang, but for `held_out` ones; see the module for the sample's bound."""
    labelled = docs.filter(~held_out & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    labelled = labelled.withColumn("long", F.length("text") > SHORT)
    sizes = labelled.groupBy("lang").agg(F.count_if(~F.col("long")).alias("n"), F.sum(F.when(~F.col("long"), F.length("text"))).alias("chars"), F.count_if("long").alias("n_long"))
    rows = sizes.orderBy("lang").collect()  # one for each language
    model_rows, check_rows, truth = {}, [], []
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    if rows:
        # Twice as many as are wanted, so that hardly ever too few come; the rest is cut below.
        short = {r["lang"]: min(1.0, 2 * SAMPLE / max(r["n"], 1), max(2 * SAMPLE_CHARS, 3 * FEWEST * SHORT) / max(r["chars"] or 0, 1)) for r in rows}
        far = {r["lang"]: min(1.0, 3 * FEWEST / max(r["n_long"], 1)) if r["n"] < FEWEST else 0.0 for r in rows}
        share = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.when(F.col("long"), F.lit(far[r["lang"]])).otherwise(F.lit(short[r["lang"]]))) for r in rows))
        sample = labelled.withColumn("draw", draw).filter(F.col("draw") < share).select("lang", "text", "long", "draw").orderBy("lang", "long", "draw", "text").toPandas()
        for lang, own in sample.groupby("lang", sort=True):
            total, n = own["text"].str.len().cumsum(), np.arange(len(own))
            own = own["text"][((n < SAMPLE) & (total <= SAMPLE_CHARS)) | (n < FEWEST)].tolist()
            seen = [t for k, t in enumerate(own) if k % 5] or own
            model_rows[lang] = pa.array(seen, pa.string())
            check_rows += own[::5]
            truth += [lang] * len(own[::5])
    model = fit(model_rows)
    if check_rows and model.languages:
        calibrate(model, pa.array(check_rows, pa.string()), truth)
    return model


def identify(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _predict(it, model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, n_symbols long")


def op2_language_id(documents: DataFrame) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 4) == 2
    return identify(documents, learn(documents, held_out), held_out)
