"""Language-model scoring by a probabilistic suffix tree over bytes, beside a word-unigram base.

A text is its lower-cased (A-Z) words, closed by a gap each and, at last, an end symbol. Candidate contexts are the byte
strings of up to `DEPTH` symbols that precede at least `LEAST` training symbols, a number that does not depend on the corpus:
so the tree grows with it. A candidate is retained where its next-symbol distribution diverges from the one of its longest
retained suffix by `GAIN` nats over all its occurrences. Distributions are smoothed towards that suffix's, which counts as
`SMOOTH` observations for each kind of symbol that followed. A position is scored by its longest retained context, and a
text's probability is the product over its symbols.

The tree has no bound, so no task and not the driver holds it. Texts are dealt into chunks of about `PIECE` bytes. Each chunk
sends its distinct words and its distinct strings of `DEPTH` + 1 symbols, with their training counts, to buckets: a string by the
three symbols before its last. A bucket so has every context that ends in these whole, builds that part of the tree, and sends to
each chunk the probabilities of the strings it asked for, in the order asked, to 1/4096 of a power of ten. Only strings of three
symbols, which the alphabet bounds, go to all. Strings travel as packed arrays, one row for each chunk and bucket.

Defined results: a null or empty text is its end token alone. With no training text, known counts are 0 and the base is
that of an empty count table. Rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .shared import hold, remainder

DEPTH = 7
#: Training symbols that a context precedes at least.
LEAST = 2
#: Divergence in nats, summed over a context's occurrences, from which it is retained.
GAIN = 2.0
#: Observations that the shorter context's distribution counts as, for each kind of next symbol.
SMOOTH = 2.0
#: Bytes of text in a chunk, about; a longer text is one of its own.
PIECE = 16 << 20
#: Bytes of text for which there is one bucket of strings and one of words.
BUCKET = 12 << 20
#: Symbols of the contexts that all tasks have.
LOW = 2
#: Steps to a power of ten in which probabilities are sent.
STEPS = 4096

END, GAP = 0xFF, 0x20
_U = np.uint64


@dataclass
class Stream:
    """Symbols of several rows: per row `DEPTH` end symbols, each word and a gap, an end. Places of rows, words and ends."""

    symbols: np.ndarray
    first: np.ndarray
    word: np.ndarray
    word_stop: np.ndarray
    end: np.ndarray


def symbol_stream(raw: np.ndarray, offs: np.ndarray) -> Stream:
    starts, ends = H._spans(raw, offs) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    cut = np.searchsorted(starts, offs)
    counts, length = np.diff(cut), ends - starts
    before = np.concatenate([[0], np.cumsum(length + 1)])
    row_size = before[cut[1:]] - before[cut[:-1]] + DEPTH + 1
    stop = np.cumsum(row_size)
    first = stop - row_size
    word = before[:-1] + np.repeat(first + DEPTH - before[cut[:-1]], counts)
    out = np.full(int(row_size.sum()), END, np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(word, length) + inside] = H.LOWER[raw[np.repeat(starts, length) + inside]]
    out[word + length] = GAP
    return Stream(out, first, word, word + length + 1, stop - 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the number of its chunk beside each row."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        _, offs = H.text_buffers(batch.column("text"))
        of = np.empty(batch.num_rows, np.int64)
        for lo, hi in H.row_chunks(offs, PIECE):
            more = int(offs[hi] - offs[lo]) + 16 * (hi - lo)
            if size and size + more > PIECE:
                chunk, size = chunk + 1, 0
            of[lo:hi], size = chunk, size + more
        yield pa.RecordBatch.from_arrays([pa.array(of), *batch.columns], names=["chunk", *batch.schema.names])


def _strings(rows: Stream) -> tuple[np.ndarray, np.ndarray]:
    """The string of `DEPTH` + 1 symbols that ends at each place from `DEPTH` on, and whether its last symbol is no padding."""
    stream = rows.symbols
    gram = np.zeros(max(len(stream) - DEPTH, 0), _U)
    for k in range(DEPTH + 1):
        gram = (gram << _U(8)) | stream[k : len(stream) - DEPTH + k]
    keep = np.ones(len(gram), bool)
    for k in range(DEPTH):
        keep[rows.first[1:] + k - DEPTH] = False
    return gram, keep


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers, best ascending ones: their steps, byte by byte of these, compressed."""
    steps = np.diff(values.view(_U), prepend=_U(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(_U).reshape(-1), dtype=_U)


def _packed_small(values: np.ndarray) -> bytes:
    """Whole numbers, mostly small, byte by byte of these, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype(_U).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked_small(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).reshape(-1)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of `LOW` + 1 symbols with their counts in training rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for learned, column in _sides(batches):
        raw, offs = H.text_buffers(column)
        for lo, hi in H.row_chunks(offs):
            gram, keep = _strings(symbol_stream(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
            keys, n = np.unique((gram[keep] & _U((1 << (8 * (LOW + 1))) - 1)).astype(np.uint32), return_counts=True)
            held.append((keys, n * learned))
        held = [_merge(held)] if len(held) > 16 else held
    if held:
        keys, n = _merge(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "n"])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Array]]:
    """The training texts of each batch, then its others."""
    for batch in batches:
        held_out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for learned in (True, False):
            yield learned, batch.column("text").take(pa.array(np.flatnonzero(held_out != learned)))


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct strings (buckets from 0) and words (from `buckets`, by hash) of each chunk with their counts in its training rows, packed by bucket."""
    held: dict[int, list] = {0: [], 1: []}
    most = [3_000_000, 3_000_000]
    at = None

    def rows(kind: int) -> pa.RecordBatch:
        keys, counts = _merge(held[kind])
        held[kind], most[kind] = [], 3_000_000
        place, order = _asked(keys, bool(kind), buckets)
        keys, counts, place = keys[order], counts[order], place[order]
        cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
        pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([at] * len(pieces), pa.int64()), pa.array([int(place[a]) + kind * buckets for a, _ in pieces], pa.int64()), pa.array([b - a for a, b in pieces], pa.int64()),
                pa.array([_packed(keys[a:b]) for a, b in pieces], pa.binary()), pa.array([_packed(counts[a:b]) for a, b in pieces], pa.binary()),
            ],
            names=["chunk", "bucket", "size", "keys", "counts"],
        )

    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if start == stop:
                continue
            if at is not None and at != chunks[start]:
                yield from (rows(0), rows(1))
            at = int(chunks[start])
            for learned, column in _sides([batch.slice(start, stop - start)]):
                raw, offs = H.text_buffers(column)
                for lo, hi in H.row_chunks(offs):
                    words, _ = H.word_hashes(raw, offs[lo : hi + 1])
                    gram, keep = _strings(symbol_stream(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                    for kind, found in ((0, gram[keep]), (1, words)):
                        keys, n = np.unique(found, return_counts=True)
                        held[kind].append((keys, n * learned))
                        if sum(len(k) for k, _ in held[kind]) > most[kind]:
                            held[kind] = [_merge(held[kind])]
                            most[kind] = max(3_000_000, 2 * len(held[kind][0][0]))
    if at is not None:
        yield from (rows(0), rows(1))


def _root(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with a class of their own, and the probability of each byte without context; all other bytes share one class."""
    share = total / max(total.sum(), 1)
    symbols = np.flatnonzero((share >= 1e-6) | np.isin(np.arange(256), (END, GAP)))
    rest = np.ones(256, bool)
    rest[symbols] = False
    size = total.sum() + 0.5 * (len(symbols) + 1)
    p = (total + 0.5) / size
    p[rest] = (total[rest].sum() + 0.5) / size / max(int(rest.sum()), 1)
    return symbols, p


def _grow(strings: np.ndarray, n: np.ndarray, below: tuple[np.ndarray, np.ndarray], lengths: range, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct strings (the last symbol after a context of the greatest length), their probabilities, and how many contexts are retained.

    `strings` ascend and hold all strings of their contexts; `below` has the strings and probabilities of the length before `lengths`.
    """
    known, p, retained = *below, 0
    for k in lengths:
        own, inverse = np.unique(strings & _U((1 << (8 * (k + 1))) - 1), return_inverse=True)
        count = np.bincount(inverse, n, len(own))
        up = p[np.searchsorted(known, own & _U((1 << (8 * k)) - 1))]
        _, context = np.unique(own >> _U(8), return_inverse=True)
        every = np.bincount(context, count)
        weight = SMOOTH * np.maximum(np.bincount(context, count > 0), 1)
        smooth = (count + weight[context] * up) / (every + weight)[context]
        # Symbols that are in no row are unseen there: each has its share of the shorter context's, in proportion.
        unseen = weight / (every + weight)
        divergence = np.bincount(context, smooth * np.log(smooth / up)) + unseen * np.maximum(1 - np.bincount(context, up), 0) * np.log(unseen)
        keeps = (every >= max(least, 1)) & (every * divergence >= GAIN)
        known, p, retained = own, np.where(keeps[context], smooth, up), retained + int(keeps.sum())
    return known, p, retained


@dataclass
class Base:
    """What the add-0.1 estimate needs beside a token's count."""

    tokens: int
    distinct: int
    texts: int

    def log(self, c: np.ndarray | int) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _total(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a bucket and their counts; asks are unpacked one after another."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    more = 0
    for n, k, c in zip(*(group[x].to_pylist() for x in ("size", "keys", "counts")), strict=True):
        held.append((_unpacked(k, n), _unpacked(c, n).view(np.int64)))
        more += n
        if more > max(2_000_000, len(held[0][0])):
            held, more = [_merge(held)], 0
    return _merge(held)


def _build(group: pa.Table, low: tuple[np.ndarray, np.ndarray], least: float, buckets: int) -> pa.Table:
    """A bucket's answers: to each chunk the total counts of its words, or the log10 probabilities of its strings, as asked; then totals of the bucket (no chunk)."""
    keys, total = _total(group)
    words = group["bucket"][0].as_py() >= buckets
    if words:
        seen = total[total > 0]
        sums, each = {"distinct": len(seen), "tokens": int(seen.sum())}, total
    else:
        _, p, retained = _grow(keys, total, low, range(LOW + 1, DEPTH + 1), least)
        sums, each = {"contexts": retained}, np.minimum(np.rint(np.log10(p) * -STEPS), 65535).astype(np.int64)
    values = [_packed_small(each[np.searchsorted(keys, _unpacked(k, n))]) for k, n in zip(group["keys"].to_pylist(), group["size"].to_pylist(), strict=True)]
    # A chunk that was read by several tasks asks several times; only there the keys go back as well.
    times = Counter(group["chunk"].to_pylist())
    own = [k if times[c] > 1 else None for c, k in zip(group["chunk"].to_pylist(), group["keys"].to_pylist(), strict=True)]
    columns = {
        "chunk": [*group["chunk"].to_pylist(), *(None for _ in sums)], "bucket": [*group["bucket"].to_pylist(), *(None for _ in sums)], "size": [*group["size"].to_pylist(), *sums.values()],
        "keys": [*own, *(None for _ in sums)], "answers": [*values, *(None for _ in sums)], "what": [*(None for _ in values), *sums],
    }
    return pa.table(columns, pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("answers", pa.binary()), ("what", pa.string())]))


def _asked(keys: np.ndarray, words: bool, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each of a chunk's distinct keys, and the order in which they are asked: by bucket, then as they are."""
    place = ((keys if words else H.mix((keys >> _U(8)) & _U((1 << (8 * (LOW + 1))) - 1))) % _U(buckets)).astype(np.int64)
    return place, np.argsort(place, kind="stable")


def _answered(keys: np.ndarray, answers: pa.Table, words: bool, buckets: int) -> np.ndarray:
    """For a chunk's distinct keys, ascending, their counts or log10 probabilities."""
    out = np.zeros(len(keys), np.int64 if words else np.float64)
    place, order = _asked(keys, words, buckets)
    cuts = np.searchsorted(place[order], np.arange(buckets + 1))
    for r in answers.to_pylist():
        if (r["bucket"] >= buckets) == words:
            at = r["bucket"] - (buckets if words else 0)
            where = order[cuts[at] : cuts[at + 1]] if r["keys"] is None else np.searchsorted(keys, _unpacked(r["keys"], r["size"]))
            value = _unpacked_small(r["answers"], r["size"])
            out[where] = value if words else value / -STEPS
    return out


def _score(rows: pa.Table, answers: pa.Table, base: Base, buckets: int) -> pa.Table:
    """The scores of a chunk's rows."""
    raw, offs = H.text_buffers(pa.concat_arrays([c.cast(pa.large_string()) for c in rows["text"].chunks]))
    pieces = []
    for lo, hi in H.row_chunks(offs):
        own, cut = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        words, wo = H.word_hashes(own, cut)
        stream = symbol_stream(own, cut)
        gram, keep = _strings(stream)
        grams, place = np.unique(gram[keep], return_inverse=True)
        pieces.append((H.distinct(words), grams, place.astype(np.int32), keep, stream, words, wo))
    hashes, grams = (H.distinct(np.concatenate([*(p[k] for p in pieces), np.zeros(0, _U)])) for k in (0, 1))
    counts, logs = _answered(hashes, answers, True, buckets), _answered(grams, answers, False, buckets)
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for _, own, place, keep, stream, words, wo in pieces:
        c = counts[np.searchsorted(hashes, words)] if len(words) else np.zeros(0, np.int64)
        each = np.zeros(len(stream.symbols) + 1)
        each[np.flatnonzero(keep) + DEPTH + 1] = logs[np.searchsorted(grams, own)][place]
        run = np.cumsum(each)
        plain, seen = (x[wo[1:]] - x[wo[:-1]] for x in (np.concatenate([[0.0], np.cumsum(v)]) for v in (base.log(c), c > 0)))
        for part, x in zip(parts, (np.diff(wo) + 1, seen.astype(np.int64) + int(base.texts > 0), plain + base.log(base.texts), run[stream.end + 1] - run[stream.first]), strict=True):
            part.append(x)
    out = [np.concatenate(x) if x else np.zeros(0) for x in parts]
    return pa.table(
        {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": pa.array(out[0].astype(np.int64)), "n_known": pa.array(out[1].astype(np.int64)), "base_score": pa.array(out[2]), "score": pa.array(out[3])}
    )


def score_texts(docs: DataFrame, held_out, least: float = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_contexts for each row of `docs` (doc_id, text).

    `held_out` is a boolean expression; the other rows are learned from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = hold(rows.mapInArrow(_deal, "chunk long, doc_id long, held_out boolean, text string"), "chunks")
    size = rows.agg(F.count_if(~F.col("held_out")).alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    texts, buckets = size["texts"], max((size["bytes"] or 0) // BUCKET, 64)

    ends = rows.select("held_out", "text").mapInArrow(_ends, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")  # bounded by the alphabet
    last, count = ends["key"].to_numpy(np.int64).view(_U), ends["n"].to_numpy(np.int64)
    _, start = _root(np.bincount((last & _U(255)).astype(np.int64), count, 256))
    *low, retained = _grow(last, count, (np.arange(256, dtype=_U), start), range(1, LOW + 1), least)

    counted = rows.select("chunk", "held_out", "text").mapInArrow(lambda it: _count(it, buckets), "chunk long, bucket long, size long, keys binary, counts binary")
    asked = counted.groupBy("bucket").applyInArrow(lambda g: _build(g, tuple(low), least, buckets), "chunk long, bucket long, size long, keys binary, answers binary, what string")
    answers = hold(asked, "answers")
    sums = {r.what: r.n for r in answers.filter("what is not null").groupBy("what").agg(F.sum("size").alias("n")).collect()}
    base = Base(sums.get("tokens", 0) + texts, sums.get("distinct", 0) + (texts > 0), texts)
    contexts = 1 + retained + sums.get("contexts", 0)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    asked_by = answers.filter("what is null").select("chunk", "bucket", "size", "keys", "answers")
    scored = rows.groupBy("chunk").cogroup(asked_by.groupBy("chunk")).applyInArrow(lambda a, b: _score(a, b, base, buckets), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(base.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.lit(contexts).cast("long").alias("n_contexts"))


def op1_suffix_tree(documents: DataFrame) -> DataFrame:
    return score_texts(documents, remainder(F.col("doc_id"), 10) == 0)
