"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals make document scores and spans.

Tokens are runs of letters, A-Z as a-z, each text one chain. A token's score for the tag T (toxic, against O) adds up hashed weights of the word, of
its first 3 to 6 bytes, its last 3 and 4, of a beginning of 5 or 6 that several words of the chain share, and of its two neighbours; tags have transition and start weights. Forward and backward
products of 2 x 2 matrices are taken in blocks of tokens whose products are then combined by doubling, so a batch of chains of any
lengths is a few whole-array steps.

Labelled tokens: labels mark documents, so a token of a toxic document is T if its word, or a beginning or end of it, occurs in so
many more toxic than clean documents that no such form of the sample is expected to by chance (binomial bound, divided by their number); every other token is O.
The field learns from these by likelihood on four fifths of a bounded sample of labelled documents; on the last fifth, weighted back to the shares
of all labelled documents, a logistic curve turns a document's largest marginal and expected number of T into its score.

Defined results: null, empty and wordless texts have no T and the score of that. A text of more than 2 MiB is several chains, cut at white space; its words all
count. Null labels and labels of null or unknown ids are ignored; several labels of an id count as one, 1 before 0, and of rows that share a labelled id one teaches. Without labels of both
kinds nothing is tagged and the score is the share of label 1 among them (0 without any). Each row is scored, also where ids repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .shared import hold, remainder

#: Labelled documents that the field learns from, and bytes of their texts, at most: toxic, clean.
SAMPLE, BYTES = (1000, 4000), (3 << 20, 8 << 20)
#: Texts up to this length are taken first.
ORDINARY = 50_000
ROWS = 1 << 18
THRESHOLD, TAGGED = 0.5, 0.5
EPOCHS, BATCH, RATE, DECAY = 6, 96, 0.15, 2e-5

_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Forms of a token: the word, beginnings, ends, shared beginnings. Its neighbours come after these.
_STARTS, _ENDS = (3, 4, 5, 6), (3, 4)
#: Beginnings that count once more where words of the chain differ after them: an inflected stem, not a chance word.
_VARIED = (5, 6)
FORMS = 1 + len(_STARTS) + len(_ENDS) + len(_VARIED)
FEATURES = FORMS + 2
_BLOCK = 32


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of `raw`, which `offs` cuts into chains, the offsets of the chains in them, and their features (32-bit hashes)."""
    letter = _LETTER[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    before, after = np.zeros_like(letter), np.zeros_like(letter)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | cut[:-1]))
    ends = np.flatnonzero(letter & (~after | cut[1:])) + 1
    own = np.searchsorted(starts, offs)
    power, inverse = H._power_tables(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((H.LOWER[raw].astype(_U) + _U(1)) * power[: len(raw)], out=total[1:])
    out = np.zeros((len(starts), FEATURES), np.uint32)

    def hashed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        return (H.mix((total[b] - total[a]) * inverse[a] + _U(kind << 40)) >> _U(32)).astype(np.uint32)

    out[:, 0] = hashed(starts, ends, 1)
    for k, n in enumerate(_STARTS):
        out[:, 1 + k] = hashed(starts, np.minimum(starts + n, ends), 2 + n)
    for k, n in enumerate(_ENDS):
        out[:, 1 + len(_STARTS) + k] = hashed(np.maximum(ends - n, starts), ends, 20 + n)
    chain = np.repeat(np.arange(len(own) - 1, dtype=_U), np.diff(own))
    for k, n in enumerate(_VARIED):
        varied = _shared(chain << _U(32) | out[:, 1 + _STARTS.index(n)].astype(_U), out[:, 0])
        out[:, FORMS - len(_VARIED) + k] = np.where(varied, out[:, 1 + _STARTS.index(n)] * np.uint32(7), 0)
    first = np.zeros(len(starts) + 1, bool)
    first[own] = True
    if len(starts):
        word = out[:, 0]
        out[1:, FORMS] = np.where(first[1:-1], 0, word[:-1] * np.uint32(3))
        out[:-1, FORMS + 1] = np.where(first[1:-1], 0, word[1:] * np.uint32(5))
    return starts, ends, own, out


def _shared(group: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether different words have each row's group."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.argsort(group)
    group, word = group[order], word[order]
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    several = np.maximum.reduceat(word, edge) != np.minimum.reduceat(word, edge)
    out = np.empty(len(group), bool)
    out[order] = np.repeat(several, np.diff(np.append(edge, len(group))))
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices in the last two axes, scaled to a largest entry of 1."""
    out = np.empty(np.broadcast_shapes(a.shape, b.shape))
    for i in (0, 1):
        for j in (0, 1):
            out[..., i, j] = a[..., i, 0] * b[..., 0, j] + a[..., i, 1] * b[..., 1, j]
    return out / out.max(axis=(-1, -2), keepdims=True)


def running(m: np.ndarray) -> np.ndarray:
    """For each k the row vector (1, 1) m[0] ... m[k], scaled; m is n x 2 x 2."""
    n = len(m)
    blocks = -(-n // _BLOCK)
    inner = np.broadcast_to(np.eye(2), (blocks * _BLOCK, 2, 2)).copy()
    inner[:n] = m
    inner = inner.reshape(blocks, _BLOCK, 2, 2)
    for k in range(1, _BLOCK):
        inner[:, k] = _times(inner[:, k - 1], inner[:, k])
    whole, step = inner[:, -1].copy(), 1
    while step < blocks:
        whole[step:] = _times(whole[:-step], whole[step:])
        step *= 2
    ahead = np.ones((blocks, 1, 2))
    ahead[1:, 0] = whole[:-1].sum(axis=1)
    out = (ahead[..., None] * inner).sum(axis=2).reshape(-1, 2)[:n]
    return out / out.sum(axis=1, keepdims=True)


@dataclass
class Chain:
    """The field: weights of hashed features for T, its bias, transitions (log, from by to) and starts (log)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(ROWS))
    bias: np.ndarray = field(default_factory=lambda: np.array([-4.0]))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(2))
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0]))

    def scores(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.bias[0])
        for k in range(features.shape[1]):
            total += self.weights[features[:, k] & np.uint32(ROWS - 1)]
        return np.clip(total, -30, 30)

    def steps(self, scores: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The matrices of each token; at a chain's first one, what comes before has no effect."""
        m = np.empty((len(scores), 2, 2))
        m[:] = np.exp(self.moves)
        m[own[:-1][own[:-1] < own[1:]]] = np.exp(self.starts)
        m[:, :, 1] *= np.exp(scores)[:, None]
        return m

    def marginals(self, scores: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(T) of each token, and of each token's pair (tag before, tag) the probabilities."""
        if not len(scores):
            return np.zeros(0), np.zeros((0, 2, 2))
        m = self.steps(scores, own)
        ahead = running(m)
        back = np.ones_like(m)
        back[1:] = np.swapaxes(m[:0:-1], 1, 2)
        behind = running(back)[::-1]
        both = ahead * behind
        before = np.ones_like(ahead)
        before[1:] = ahead[:-1]
        pairs = before[:, :, None] * m * behind[:, None, :]
        return both[:, 1] / both.sum(axis=1), pairs / pairs.sum(axis=(1, 2), keepdims=True)

    def probability(self, largest: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_aggregates(largest, expected) @ self.curve, -40, 40)))


def _aggregates(largest: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(largest), largest, np.log1p(expected)], axis=1)


def token_labels(features: np.ndarray, own: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each token is T: in a toxic document, with a form that stands in too many of these to do so by chance."""
    doc = np.repeat(np.arange(len(own) - 1, dtype=_U), np.diff(own))
    share = toxic.mean()
    keys, counts = [], []
    for k in range(FORMS):
        pairs = H.distinct(doc << _U(32) | features[:, k].astype(_U))
        form, bad = pairs & _U(0xFFFFFFFF), toxic[(pairs >> _U(32)).astype(np.int64)]
        order = np.argsort(form, kind="stable")
        form, bad = form[order], bad[order]
        edge = np.flatnonzero(np.concatenate([[True], form[1:] != form[:-1]])) if len(form) else np.zeros(0, np.int64)
        keys.append(form[edge])
        counts.append(np.stack([np.add.reduceat(bad.astype(np.int64), edge), np.diff(np.append(edge, len(form)))]) if len(form) else np.zeros((2, 0), np.int64))
    tests = sum(int((c[1] > 1).sum()) for c in counts)
    found = np.zeros(len(features), bool)
    for k in range(FORMS):
        bad, seen = counts[k]
        q = np.clip(bad / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
        evidence = seen * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))
        sure = (q > (1 + share) / 2) & (evidence > np.log(max(tests, 1)) + 2)
        found |= np.isin(features[:, k].astype(_U), keys[k][sure])
    return found & toxic[doc.astype(np.int64)]


def learn(features: np.ndarray, own: np.ndarray, tags: np.ndarray, seed: int = 3) -> Chain:
    """A field by Adam on the likelihood of `tags`, in batches of chains, with decaying weights."""
    chain, rng = Chain(), np.random.default_rng(seed)
    p = [chain.weights, chain.bias, chain.moves, chain.starts]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(own) - 1), max((len(own) - 1) // BATCH, 1)):
            rows = np.concatenate([np.arange(own[d], own[d + 1]) for d in part])
            cut = np.concatenate([[0], np.cumsum(own[part + 1] - own[part])])
            x, y = features[rows] & np.uint32(ROWS - 1), tags[rows].astype(np.int64)
            if not len(rows):
                continue
            likely, pairs = chain.marginals(chain.scores(x), cut)
            gap = likely - y
            far = np.abs(gap) > 1e-6
            seen = np.zeros_like(pairs)
            seen[np.arange(len(y)), np.concatenate([[0], y[:-1]]), y] = 1
            first = np.zeros(len(y), bool)
            first[cut[:-1][cut[:-1] < cut[1:]]] = True
            grads = [
                np.bincount(x[far].ravel(), np.repeat(gap[far], FEATURES), ROWS), np.array([gap.sum()]), (pairs - seen)[~first].sum(axis=0),
                (pairs - seen)[first].sum(axis=(0, 1)),
            ]
            step += 1
            for k, g in enumerate(grads):
                g = g / len(part) + (DECAY * p[k] if k == 0 else 0)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)
    return chain


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        slope = x.T @ (weight * (q - y)) + ridge @ b
        b = b - np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + ridge, slope)
        b = np.clip(b, -60, 60)
    return b


def fit(texts: pd.DataFrame, totals: tuple[int, int]) -> Chain:
    """A field and its curve from columns text and toxic; totals: all labelled documents, clean and toxic."""
    if min(totals) == 0 or texts["toxic"].nunique() < 2:
        share = totals[1] / sum(totals) if sum(totals) else 0.0
        return Chain(curve=np.array([np.log(share / (1 - share)) if 0 < share < 1 else 40.0 * np.sign(share - 0.5), 0.0, 0.0]))
    toxic = texts["toxic"].to_numpy() == 1
    raw, offs = H.text_buffers(pa.array(texts["text"], pa.string()))
    features, sizes = [], []
    for lo, hi in H.row_chunks(offs):
        _, _, own, x = tokens(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        features.append(x)
        sizes.append(np.diff(own))
    features, own = np.concatenate(features), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    tags = token_labels(features, own, toxic)
    held = np.arange(len(toxic)) % 5 == 0
    if toxic[held].all() or not toxic[held].any():
        held[:] = True
    teach = np.flatnonzero(~held) if not held.all() else np.arange(len(toxic))
    rows = np.concatenate([np.arange(own[d], own[d + 1]) for d in teach])
    chain = learn(features[rows], np.concatenate([[0], np.cumsum(np.diff(own)[teach])]), tags[rows])
    likely, _ = chain.marginals(chain.scores(features), own)
    largest, expected = _per_chain(likely, own)
    weight = np.where(toxic, totals[1] / toxic.sum(), totals[0] / (~toxic).sum())
    weight = (weight / weight[held].mean())[held]
    chain.curve = _logistic(_aggregates(largest[held], expected[held]), toxic[held].astype(float), weight)
    return chain


def _per_chain(likely: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value and the sum of each chain."""
    n = len(own) - 1
    chain = np.repeat(np.arange(n), np.diff(own))
    largest = np.zeros(n)
    np.maximum.at(largest, chain, likely)
    return largest, np.bincount(chain, likely, n)


def _segments(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows, those of more than 2 MiB cut at white space (or, where there is none for 1 MiB, at a character), and the row of each piece."""
    cuts = [offs]
    for r in np.flatnonzero(np.diff(offs) > 2 * H.CHUNK):
        at, end = int(offs[r]) + H.CHUNK, int(offs[r + 1])
        own = []
        while at < end:
            near = raw[at : min(at + H.CHUNK, end)]
            blank = np.flatnonzero(H._BLANK[near])
            if not len(blank):
                blank = np.flatnonzero((near & 0xC0) != 0x80)
            at += int(blank[0]) if len(blank) else len(near)
            own.append(at)
            at += H.CHUNK
        cuts.append(np.array([c for c in own if c < end], np.int64))
    whole = np.sort(np.concatenate(cuts), kind="stable")
    row = np.empty(len(whole) - 1, np.int64)
    # Empty rows keep a piece of their own: pieces are dealt to rows in order.
    pieces = np.array([1] * (len(offs) - 1))
    k = 1
    for r in np.flatnonzero(np.diff(offs) > 2 * H.CHUNK):
        pieces[r] += len(cuts[k])
        k += 1
    row[:] = np.repeat(np.arange(len(offs) - 1), pieces)
    return whole, row


def _tag(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        raw, offs = H.text_buffers(batch.column("text"))
        cuts, row = _segments(raw, offs)
        largest, expected, points = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        spans: list[list] = [[] for _ in range(n)]
        for lo, hi in H.row_chunks(cuts):
            part = raw[cuts[lo] : cuts[hi]]
            starts, ends, own, x = tokens(part, cuts[lo : hi + 1] - cuts[lo])
            likely, _ = chain.marginals(chain.scores(x), own)
            of = np.repeat(row[lo:hi], np.diff(own))
            np.maximum.at(largest, of, likely)
            expected += np.bincount(of, likely, n)
            hot = likely >= TAGGED
            lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            if hot.any():
                chained = np.zeros(len(hot), bool)
                chained[1:] = hot[1:] & hot[:-1] & (of[1:] == of[:-1])
                first = np.flatnonzero(hot & ~chained)
                last = np.flatnonzero(hot & ~np.append(chained[1:], False))
                for a, b in zip(first, last, strict=True):
                    seg = int(np.searchsorted(own, a, "right")) - 1
                    base = int(points[of[a]]) - int(lead[cuts[lo + seg] - cuts[lo]])
                    spans[of[a]].append({"start": base + int(lead[starts[a]]), "end": base + int(lead[ends[b]]), "weight": float(likely[a : b + 1].mean())})
            points += np.bincount(row[lo:hi], np.diff(lead[cuts[lo : hi + 1] - cuts[lo]]), n).astype(np.int64)
        score = chain.probability(largest, expected)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(expected), pa.array(spans, _SPANS)], names=["doc_id", "held_out", "score", "predicted", "expected", "spans"]
        )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))


def sample(rows: DataFrame, labels: DataFrame, held_out: Column) -> tuple[pd.DataFrame, tuple[int, int]]:
    """Texts of labelled rows that are not held out, with `toxic`, within SAMPLE and BYTES; and how many such labels there are, clean and toxic."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(~held_out)
    usable = hold(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labelled")
    found = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = (found.get(0, 0), found.get(1, 0))
    # Half as many again as are wanted, as some ids may have no document.
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, 1.5 * SAMPLE[0] / max(totals[1], 1)))).otherwise(min(1.0, 1.5 * SAMPLE[1] / max(totals[0], 1)))
    drawn = usable.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    near = rows.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))
    near = hold(near, "drawn")
    one = near.groupBy("doc_id", "toxic").agg(F.min(F.struct("h", "size")).alias("r")).select("doc_id", "toxic", "r.h", "r.size").toPandas()  # 1.5 * sum(SAMPLE) rows
    one["late"] = one["size"] > ORDINARY
    one["order"] = (one["h"].to_numpy(np.int64) ^ one["doc_id"].to_numpy(np.int64) * 7919) & 0x7FFFFFFFFFFFFFFF
    chosen = []
    for toxic, most, size in ((1, SAMPLE[0], BYTES[0]), (0, SAMPLE[1], BYTES[1])):
        own = one[one["toxic"] == toxic].sort_values(["late", "order", "doc_id"]).head(most)
        fits = own[own["size"].cumsum() <= size]
        chosen.append(fits if len(fits) else own.nsmallest(1, "size"))
    keys = pd.concat(chosen)[["doc_id", "h"]].astype("int64")
    wanted = F.broadcast(rows.sparkSession.createDataFrame(keys, "doc_id long, h long"))
    texts = near.join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "toxic", "text").toPandas()
    return texts.sort_values("doc_id", ignore_index=True), totals


def tag(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted, expected (number of toxic words), spans (start, end in code points, mean marginal) for each row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    chain = fit(*sample(rows, labels, held_out))
    return rows.mapInArrow(lambda it: _tag(it, chain), "doc_id long, held_out boolean, score double, predicted int, expected double, spans array<struct<start:bigint,end:bigint,weight:double>>")


def op11_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return tag(documents, labels, remainder(F.col("doc_id"), 5) == 0)
