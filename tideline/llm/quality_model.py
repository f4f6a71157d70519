"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Words (runs of letters, runs of digits, single other characters; case is kept) are hashed into `ROWS` rows. Each row has a
fixed sparse index vector of +1 and -1; a row's word vector is the sum of the index vectors of its neighbours within `REACH`
words, over all texts, scaled to length 1. A document is the mean vector of its words, the mean vector of its distinct words,
and how long and how varied it is. The network (one hidden layer) learns from a bounded sample of labelled rows, a fifth of
which sets the temperature that calibrates its probabilities.

Defined results: null, empty and white-space texts have zero vectors and get the score of those. Labels that are null or
of unknown ids are ignored; a doc_id labelled more than once counts each time. Without labels of both kinds the score is the
share of label 1 among them, or 0.5. Rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .shared import remainder, tidy

ROWS, DIMS, MARKS, REACH = 1 << 15, 32, 2, 2
#: Text bytes and words worked on at once, and rows of the table of word vectors in a batch: executors have little room beside their heap.
CHUNK, STEP, BATCH = 1 << 18, 1 << 16, 1 << 10
#: Labelled rows that the network learns from, at most in expectation.
SAMPLE = 20_000
HIDDEN, EPOCHS = 32, 120
THRESHOLD = 0.7

_U = np.uint64
#: Byte classes: 0 white space, 1 letter or any byte of a multi-byte character, 2 digit, 3 other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row: the `MARKS` places of its index vector that are not 0, and their signs."""
    rows = np.arange(ROWS, dtype=_U)
    draws = np.stack([H.mix(rows * _U(31) + _U(k + 1)) for k in range(MARKS)], 1)
    return (draws % _U(DIMS)).astype(np.int64), np.where(draws >> _U(63), 1, -1).astype(np.int64)


def word_rows(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word of each text, and the offsets of the texts in them."""
    if not len(raw):
        return np.zeros(0, np.uint16), np.zeros(len(offs), np.int64)
    kind = _KIND[raw]
    new = np.ones(len(raw), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    new[offs[:-1][offs[:-1] < len(raw)]] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(starts, append=len(raw))
    power = np.full(sizes.max(), H._BASE, _U)
    power[0] = 1
    power = np.cumprod(power)[np.arange(len(raw)) - np.repeat(starts, sizes)]
    sums = np.add.reduceat((raw.astype(_U) + _U(1)) * power, starts)
    use = kind[starts] > 0
    return (H.mix(sums[use] + sizes[use].astype(_U)) % _U(ROWS)).astype(np.uint16), np.searchsorted(starts[use], offs)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text of any length in pieces of about `CHUNK` bytes, cut between words; a longer word is whole."""
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw):
            kind = _KIND[raw[at : end + 1]]
            edges = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] % 3 == 0))
            if len(edges):
                end = at + int(edges[-1]) + 1
                break
            end = min(2 * end - at, len(raw))
        yield raw[at:end]
        at = end


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offs = H.text_buffers(batch.column("text"))
    for lo, hi in H.row_chunks(offs, CHUNK):
        if hi - lo > 1:
            yield lo, hi, *word_rows(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        else:
            parts = [word_rows(piece, np.array([0, len(piece)]))[0] for piece in _pieces(raw[offs[lo] : offs[hi]])]
            rows = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
            yield lo, hi, rows, np.array([0, len(rows)])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(ROWS * DIMS, np.int64)
    for batch in batches:
        for _, _, rows, cut in _chunks(batch):
            for at in range(0, len(rows), STEP):
                part = rows[at : at + STEP + REACH].astype(np.int64)
                text = np.searchsorted(cut, np.arange(at, at + len(part)), "right")
                for reach in range(1, REACH + 1):
                    n = min(STEP, len(part) - reach)
                    if n > 0:
                        same = text[reach : reach + n] == text[:n]
                        left, right = part[:n][same], part[reach : reach + n][same]
                        for a, b in ((left, right), (right, left)):
                            for k in range(MARKS):
                                np.add.at(total, a * DIMS + place[b, k], sign[b, k])
    wide = total.reshape(ROWS, DIMS)
    used = np.flatnonzero(wide.any(axis=1))
    for at in range(0, len(used), BATCH):
        own = used[at : at + BATCH]
        yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(wide[own, k]) for k in range(DIMS))], names=["row", *(f"v{k}" for k in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIMS float32 from all texts: a table of fixed size, summed on the executors before it is collected."""
    names = [f"v{k}" for k in range(DIMS)]
    sums = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(_contexts), "row long, " + ", ".join(f"{n} long" for n in names))
    table = sums.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    out = np.zeros((ROWS, DIMS), np.float32)
    if len(table):
        values = table[names].to_numpy(np.float64)
        out[table["row"].to_numpy()] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    return out


def _features(rows: np.ndarray, cut: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(cut) - 1, 2 * DIMS), np.float32)
    for d in range(len(out)):
        own = rows[cut[d] : cut[d + 1]]
        if len(own):
            kinds, count = np.unique(own, return_counts=True)
            v = vectors[kinds]
            out[d, :DIMS] = (count / len(own)) @ v
            out[d, DIMS:] = v.mean(axis=0)
    return out


def _pool(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, rows, cut in _chunks(batch):
            out = _features(rows, cut, vectors)
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("quality").slice(lo, hi - lo), lists], names=["doc_id", "quality", "features"])


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """A network with one hidden layer by Adam on the logistic loss; the temperature by likelihood on a fifth left out."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    if len(x) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = rng.permutation(len(x))
    held, seen = order[: len(x) // 5], order[len(x) // 5 :]
    if y[seen].min() == y[seen].max():
        held, seen = order[:0], order
    mean, scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-6
    z, t = (x[seen] - mean) / scale, y[seen].astype(float)
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(z)), max(len(z) // 256, 1)):
            a = np.tanh(z[part] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -60, 60))) - t[part]) / len(part)
            back = np.outer(e, p[2]) * (1 - a * a)
            grads = [z[part].T @ back + 1e-4 * p[0], back.sum(axis=0), a.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(held):
        logit, t = net.logit(x[held]), y[held]

        def loss(temperature: float) -> float:
            q = np.clip(logit / temperature, -60, 60)
            return float((np.logaddexp(0, q) - t * q).mean())

        net.temperature = float(min(np.geomspace(0.25, 20, 80), key=loss))
    return net


def _predict(batches: Iterator[pa.RecordBatch], vectors: np.ndarray, net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, rows, cut in _chunks(batch):
            score = net.probability(_features(rows, cut, vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted for each row of `docs`; `held_out` rows teach no label.

    Texts are pooled where they are scored, and those of the sample once more before: no table of all pooled texts is kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    vectors = word_vectors(rows)
    usable = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~held_out)
    share = min(1.0, SAMPLE / max(usable.count(), 1))
    sample = usable.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id", "quality"), F.lit(1_000_000)) < share * 1_000_000)
    known = rows.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), "text")
    taught = known.mapInArrow(tidy(lambda it: _pool(it, vectors)), "doc_id long, quality long, features array<float>").toPandas().sort_values(["doc_id", "quality"])  # `SAMPLE` rows; sorted here, as a sort in Spark would pool them twice
    x = np.array(taught["features"].tolist(), float).reshape(len(taught), 2 * DIMS)
    net = train(x, taught["quality"].to_numpy(int))
    return rows.mapInArrow(tidy(lambda it: _predict(it, vectors, net)), "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_model(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(documents, labels, remainder(F.col("doc_id"), 4) == 2)
