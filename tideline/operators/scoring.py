"""Scores of stored rows against a block of queries, as whole-array steps in each task.

Stored rows stay where they lie. A block of queries of bounded size goes to every task, which scores its batches of rows against
the whole block and passes on the best few for each query; so what is shuffled is a few rows for each query and batch, never the pairs, and no key is
hot, whatever term or profile most rows share. More queries than a block holds are dealt into several by a hash. Ties go to the lesser item.

* Dense: matrix products of unit vectors.
* Sparse: rows of falling norm, as long as norm times the query's norm reaches its k-th best so far; no row of the best k is lost. Terms that many queries
  have are a matrix product, the others an inverted index of the rows.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import held

#: Bytes of vectors and (query, term) rows in a block, at most in the mean.
BLOCK_BYTES, BLOCK_TERMS = 64 << 20, 500_000
#: Scores held at once.
AT_ONCE = 1 << 22
#: Sparse: rows, and scores or entries, worked on at once; columns of the matrix of common terms; kinds of rows in which floors are looked for.
ROWS, CELLS, COMMON, KINDS = 1024, 1 << 19, 512, 64
#: Bytes of a group of held rows.
GROUP_BYTES = 1 << 20
#: Half a unit of the sixth digit, to which scores are rounded: bounds are loosened by it.
_SLACK = 1e-6


def ranked(scored: DataFrame, k: int, by: str = "query", item: str = "item") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), item)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def in_blocks(queries: DataFrame, key: str, blocks: int, one: Callable[[pa.Table], DataFrame]) -> DataFrame:
    """The union of `one` over tables of queries dealt by a hash of `key`; each is brought to the driver, within the block's bound."""
    if blocks <= 1:
        return one(queries.toArrow())
    dealt = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.unionByName, [one(queries.filter(dealt == b).toArrow()) for b in range(blocks)])


def units(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column scaled to length 1, and their rows; null, empty and zero vectors, and those of other lengths than the first, are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if not len(size) or not size.max():
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    rows = np.flatnonzero(size == size[size > 0][0])
    flat = pc.fill_null(pc.cast(pc.list_flatten(column.take(pa.array(rows))), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    m = flat.reshape(len(rows), -1)
    length = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return m[good] / length[good, None], rows[good]


def _firsts(which: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of each `which`, in order, the k highest scores, ties to the lower place."""
    order = np.lexsort((place, -score, which))
    own = which[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def raise_tops(tops: np.ndarray, which: np.ndarray, score: np.ndarray) -> None:
    """Takes new scores, k at most for each `which` in order, into the falling k best of each."""
    some, begin, count = np.unique(which, return_index=True, return_counts=True)
    fresh = np.full((len(some), tops.shape[1]), -np.inf)
    fresh[np.repeat(np.arange(len(some)), count), np.arange(len(which)) - np.repeat(begin, count)] = score
    tops[some] = -np.sort(-np.concatenate([tops[some], fresh], axis=1), axis=1)[:, : tops.shape[1]]


def dense_topk(items: DataFrame, queries: DataFrame, k: int, allowed: Column | None = None) -> DataFrame:
    """query, item, score, rank: the `k` items of the highest cosine (to six digits) for each query, of (item, vector) and (query, vector).

    Only items that are `allowed` are ranked. Vectors that are null, empty, zero or not finite have no cosine and no row.
    """
    query, item = dict(queries.dtypes)["query"], dict(items.dtypes)["item"]
    asked, stored = queries.select("query", "vector"), (items if allowed is None else items.filter(allowed)).select("item", "vector")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = -(-(size["n"] * max(size["d"] or 0, 1) * 8) // BLOCK_BYTES)

    def one(block: pa.Table) -> DataFrame:
        q, rows = units(block["vector"])
        ids = block["query"].combine_chunks().take(pa.array(rows)) if len(rows) else block["query"].combine_chunks().slice(0, 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops = np.full((len(q), k), -np.inf)  # of this task so far; what is below isn't passed on
            for batch in batches:
                batch = pa.Table.from_batches([batch]).sort_by("item")
                v, at = units(batch["vector"])
                if not len(at) or not len(q) or v.shape[1] != q.shape[1]:
                    continue
                step = max(min(AT_ONCE, CELLS) // len(at), 1)
                for lo in range(0, len(q), step):
                    scores = q[lo : lo + step] @ v.T
                    floor = tops[lo : lo + step, -1]
                    if len(at) > k and not np.isfinite(floor).all():
                        floor = np.maximum(floor, np.partition(scores, len(at) - k, axis=1)[:, len(at) - k])
                    which, place = np.nonzero(scores >= floor[:, None] - _SLACK)
                    value = np.round(scores[which, place], 6)
                    keep = _firsts(which, place, value, k)
                    which, place, value = which[keep] + lo, place[keep], value[keep]
                    if len(which):
                        raise_tops(tops, which, value)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), batch["item"].combine_chunks().take(pa.array(at[place])), pa.array(value)], names=["query", "item", "score"])

        return stored.mapInArrow(run, f"query {query}, item {item}, score double")

    return ranked(in_blocks(asked, "query", blocks, one), k)


class Index:
    """An inverted index of one batch: for each term the places and weights of the rows that have it."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, n_terms: int):
        order = np.argsort(terms, kind="stable")
        self.n, self.rows, self.weights = n_rows, rows[order], weights[order]
        self.cut = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, terms, weights)
        self.signed = bool(len(weights)) and weights.min() < 0
        self.by_row = np.searchsorted(rows, np.arange(n_rows + 1))
        self.terms, self.own = terms, weights  # in the order of rows

    def postings(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = [slice(self.cut[t], self.cut[t + 1]) for t in terms]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate([self.rows[s] for s in spans]), np.concatenate([self.weights[s] * w for s, w in zip(spans, weights, strict=True)])

    def scores(self, terms: np.ndarray, weights: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that share a term and their scores; rows below `floor` may be missing."""
        bound = weights * self.most[terms]
        late = np.zeros(len(terms), bool)
        if floor > 0 and not self.signed and (weights >= 0).all():
            order = np.argsort(bound)
            late[order[np.cumsum(bound[order]) < floor - _SLACK]] = True
        rows, part = self.postings(terms[~late], weights[~late])
        if not late.any():
            met = np.flatnonzero(np.bincount(rows, minlength=self.n))
            return met, np.bincount(rows, part, self.n)[met]
        total = np.bincount(rows, part, self.n)
        met = np.flatnonzero((total > 0) & (total + bound[late].sum() >= floor - _SLACK))
        rest = np.zeros(len(self.most))
        rest[terms[late]] = weights[late]
        each = [self.own[a:b] @ rest[self.terms[a:b]] for a, b in zip(self.by_row[met], self.by_row[met + 1], strict=True)]
        return met, total[met] + np.array(each)


def _held(df: DataFrame, name: str) -> DataFrame:
    """`df` held in order of norm and in small groups of rows, so that a filter on the norm passes over the others."""
    return held(df.sortWithinPartitions("norm"), name, **{"parquet.block.size": GROUP_BYTES})


def _by_row(df: DataFrame, key: str) -> DataFrame:
    """A row for each `key`: terms, weights (of terms that repeat, their sum), norm, and the term of the greatest weight as `kind`."""
    summed = df.select(key, "term", F.col("weight").cast("double").alias("weight")).dropna().groupBy(key, "term").agg(F.sum("weight").alias("weight"))
    return summed.groupBy(key).agg(
        F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.max(F.struct("weight", "term"))["term"].alias("kind")
    )


def _flat(table: pa.Table, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, term numbers and weights of the entries whose term is in the vocabulary."""
    terms = table["terms"].combine_chunks()
    number = pc.fill_null(pc.index_in(pc.list_flatten(terms), vocabulary), -1).to_numpy()
    place, weight = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy()), pc.list_flatten(table["weights"].combine_chunks()).to_numpy()
    known = number >= 0
    return place[known], number[known], weight[known]


def _heads(rows: DataFrame, k: int) -> pa.Table:
    """Rows of great norm of the commonest kinds, BLOCK_TERMS terms at most: what most queries find good matches in."""
    kinds = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(KINDS)
    w = Window.partitionBy("kind").orderBy(F.desc("norm"), "item")
    first = rows.select("kind", "item", "norm", F.size("terms").alias("size")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 4 * k).join(F.broadcast(kinds), "kind").toArrow()
    order = np.lexsort((first["place"].to_numpy(), -first["n"].to_numpy(), (first["place"].to_numpy() - 1) // k))
    order = order[np.cumsum(first["size"].to_numpy()[order]) <= BLOCK_TERMS]
    chosen = rows.sparkSession.createDataFrame(first.take(pa.array(order)).select(["item"]), rows.select("item").schema)
    return rows.select("item", "terms", "weights").join(F.broadcast(chosen), "item", "left_semi").toArrow()


def _with_floor(asked: DataFrame, heads: pa.Table, k: int) -> DataFrame:
    """`asked` with the k-th best score among the heads, null where fewer than k of them share a term."""
    vocabulary = pc.unique(pc.list_flatten(heads["terms"].combine_chunks()))
    rows, terms, weights = _flat(heads, vocabulary)
    index = Index(rows, terms, weights, heads.num_rows, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own, weight = _flat(pa.Table.from_batches([batch]), vocabulary)
            cut = np.searchsorted(at, np.arange(batch.num_rows + 1))
            found = (index.scores(own[a:b], weight[a:b], 0.0)[1] for a, b in zip(cut, cut[1:], strict=False))
            floor = [float(-np.sort(-np.round(x, 6))[k - 1]) if len(x) >= k else None for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor, pa.float64())], names=[*batch.schema.names, "floor"])
        _give_back()

    kinds = dict(asked.dtypes)
    return asked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in asked.columns) + ", floor double")


class Block:
    """Queries of one block, those that need the fewest rows last, against batches of rows; `pruned`: each has a floor above 0."""

    def __init__(self, block: pa.Table, k: int, pruned: bool):
        self.k, self.pruned, self.ids, self.norm = k, pruned, block["query"].combine_chunks(), block["norm"].to_numpy()
        self.floor = block["floor"].to_numpy() if pruned else np.full(block.num_rows, -np.inf)
        self.vocabulary = pc.unique(pc.list_flatten(block["terms"].combine_chunks()))
        self.at, self.terms, self.weights = _flat(block, self.vocabulary)

    def least(self) -> float:
        """The norm below which a row is among the best of no query here."""
        return float((_low(self.floor) / self.norm).min())

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = None
        for batch in batches:
            if not batch.num_rows:
                continue
            task = task or _Scorer(self)
            rank = np.empty(batch.num_rows, np.int64)
            rank[pc.sort_indices(batch["item"]).to_numpy()] = np.arange(batch.num_rows)
            norm, size = batch["norm"].to_numpy(), pc.list_value_length(batch["terms"]).to_numpy()
            order, hits = np.argsort(-norm, kind="stable"), []
            for part in _pieces(order, size):
                which, row, score = task.scores(batch.select(["terms", "weights"]).take(pa.array(part)), norm[part], rank[part])
                hits.append((which, part[row], score))
            which, row, score = (np.concatenate(x) for x in zip(*hits, strict=True))
            keep = _firsts(which, rank[row], score, self.k)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(which[keep])), batch["item"].take(pa.array(row[keep])), pa.array(score[keep])], names=["query", "item", "score"])
        del task
        _give_back()


class _Scorer:
    """A block within a task: its terms as a matrix and the rest, and the best scores so far."""

    def __init__(self, block: Block):
        self.block, n = block, len(block.ids)
        self.floor, self.tops = block.floor.copy(), np.full((n, block.k), -np.inf)
        # A product doesn't show whether a row shares a term, which counts where there is no floor.
        size = min(COMMON, AT_ONCE // max(n, 1)) if block.pruned else 0
        top = np.argsort(-np.bincount(block.terms, minlength=len(block.vocabulary)), kind="stable")[:size]
        self.column = np.full(len(block.vocabulary), -1, np.int32)
        self.column[top] = np.arange(len(top))
        column = self.column[block.terms]
        common = column >= 0
        self.matrix = np.zeros((n, len(top)))
        self.matrix[block.at[common], column[common]] = block.weights[common]
        self.rare = block.at[~common], block.terms[~common], block.weights[~common]

    def scores(self, piece: pa.RecordBatch, norm: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of the rows of a piece, in order of falling norm, that may be among the best."""
        block, n, found = self.block, len(norm), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        need = np.flatnonzero(~(norm[0] * block.norm < _low(self.floor)))
        if not len(need):
            return found[0]
        active = need[-1] + 1
        rows, terms, weights = _flat(pa.Table.from_batches([piece]), block.vocabulary)
        matrix, (at, own, by), column = (self.matrix, self.rare, self.column[terms]) if np.isfinite(norm).all() else (self.matrix[:, :0], (block.at, block.terms, block.weights), np.full(len(terms), -1))
        dense = np.zeros((n, matrix.shape[1]))
        dense[rows[column >= 0], column[column >= 0]] = weights[column >= 0]
        rest = np.flatnonzero(column < 0)
        rest = rest[np.argsort(terms[rest], kind="stable")]
        rows, weights, start = rows[rest], weights[rest], np.searchsorted(terms[rest], np.arange(len(block.vocabulary) + 1))
        end = np.searchsorted(at, active)
        count = start[own[:end] + 1] - start[own[:end]]
        met = np.flatnonzero(count)
        at, first, by, count = at[met], start[own[met]], by[met], count[met]
        work = np.concatenate([[0], np.cumsum(np.bincount(at, count, active) + n)])
        a = 0
        while a < active:
            b = max(a + 1, int(np.searchsorted(work, work[a] + CELLS, "right")) - 1)
            score = matrix[a:b] @ dense.T
            x = slice(*np.searchsorted(at, [a, b]))
            posting = np.arange(count[x].sum()) + np.repeat(first[x] - np.cumsum(count[x]) + count[x], count[x])
            cell = np.repeat((at[x] - a) * n, count[x]) + rows[posting]
            np.add.at(score.reshape(-1), cell, weights[posting] * np.repeat(by[x], count[x]))
            good = score >= _low(self.floor[a:b])[:, None]
            if not block.pruned:
                shares = np.zeros(score.size, bool)
                shares[cell] = True
                good &= shares.reshape(score.shape)
            which, row = np.nonzero(good)
            if len(which):
                value = np.round(score[which, row], 6)
                keep = _firsts(which, rank[row], value, block.k)
                found.append((which[keep] + a, row[keep], value[keep]))
                raise_tops(self.tops, which[keep] + a, value[keep])
                self.floor[a:b] = np.maximum(self.floor[a:b], self.tops[a:b, -1])
            a = b
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _low(floor: np.ndarray) -> np.ndarray:
    return floor - np.abs(floor) * 1e-9 - 2 * _SLACK


def _pieces(order: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """`order` in pieces of ROWS rows and about CELLS entries at most."""
    end, a = np.cumsum(size[order]), 0
    while a < len(order):
        b = min(a + ROWS, max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + CELLS, "right"))))
        yield order[a:b]
        a = b


def _give_back() -> None:
    """Workers outlive their tasks, beside a heap that needs the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sparse_topk(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, item, score, rank by the sum of weight products over shared terms; both tables have (item or query, term, weight).

    Null ids, terms and weights are left out; weights of a term that repeats add up. Rows of terms are made once and held, then read by each block. A query's floor is its k-th
    best score among some rows; as no score is above the product of norms, rows of a norm below floor / norm of the query can't be among its best. Queries of like floors make
    a block, and a block reads the rows that one of them may need. What is passed on reaches the floor, so it doesn't grow with the number of batches.
    """
    query, item = dict(queries.dtypes)["query"], dict(items.dtypes)["item"]
    spark = items.sparkSession
    rows = _held(_by_row(items, "item"), "rows")
    asked = _held(_with_floor(_by_row(queries, "query").drop("kind"), _heads(rows, k), k), "asked")
    finite = (F.col("norm") > 0) & (F.col("norm") < float("inf")) & (F.col("floor") > 0) & (F.col("floor") < float("inf"))
    level = F.when(finite, F.greatest(F.lit(-60), F.floor(2 * F.log2(F.col("floor") / F.col("norm")))).cast("int"))
    sizes = asked.groupBy(level.alias("level")).agg(F.sum(F.size("terms")).alias("n")).collect()
    stored = rows.groupBy(F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.floor(2 * F.log2("norm"))).alias("level")).agg(F.sum(F.size("terms")).alias("n")).collect()

    def one(found: DataFrame, pruned: bool) -> DataFrame:
        table = found.select("query", "terms", "weights", "norm", "floor").toArrow()
        if pruned:
            table = table.take(pa.array(np.argsort(table["floor"].to_numpy() / table["norm"].to_numpy(), kind="stable")))
        block = Block(table, k, pruned)
        near = rows.select("item", "terms", "weights", "norm")
        if pruned:
            least = block.least()
            n = sum(r["n"] for r in stored if r["level"] is None or least <= 0 or r["level"] >= math.floor(2 * math.log2(least)))
            near = near.filter(F.col("norm") >= least).coalesce(n // BLOCK_TERMS + 1)  # a task costs more than the few rows of a file that are left
        return near.mapInArrow(block.run, f"query {query}, item {item}, score double")

    groups: list[tuple[list[int], int]] = []  # neighbouring levels that together fill a block, and their terms
    for r in sorted((r for r in sizes if r["level"] is not None), key=lambda r: -r["level"]):
        if groups and groups[-1][1] + r["n"] <= BLOCK_TERMS:
            groups[-1] = groups[-1][0] + [r["level"]], groups[-1][1] + r["n"]
        else:
            groups.append(([r["level"]], r["n"]))
    parts = [(asked.filter(level.isin(levels)), n, True) for levels, n in groups] + [(asked.filter(level.isNull()), r["n"], False) for r in sizes if r["level"] is None]
    found = []
    for part, n, pruned in parts:
        blocks = -(-n // BLOCK_TERMS)
        dealt = F.pmod(F.xxhash64("query"), F.lit(blocks))
        found += [one(part.filter(dealt == b), pruned) for b in range(blocks)]
    if not found:
        return spark.createDataFrame([], f"query {query}, item {item}, score double, rank int")
    return ranked(reduce(DataFrame.unionByName, found), k)


def nearest_by_tokens(catalogue: DataFrame, requests: DataFrame, limit: int = 3) -> DataFrame:
    """request, id, overlap, place: the entries that share most word tokens with each request, ties by id, never none.

    `catalogue` is a table of entries (id, text) of distinct ids. Its blocks go to the requests as an index of tokens; entries without a shared token fill up, in the order of
    ids. Null requests and texts have no token.
    """
    token = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0)))
    entries = catalogue.select("id", F.explode_outer(token(F.col("text"))).alias("term"))
    asked = requests.select("request", token(F.col("text")).alias("terms"))
    request, ident = dict(requests.dtypes)["request"], dict(catalogue.dtypes)["id"]
    blocks = -(-entries.count() // BLOCK_TERMS)

    def one(block: pa.Table) -> DataFrame:
        ids = pc.unique(block["id"]).sort()
        some = block.filter(pc.is_valid(block["term"]))
        vocabulary = pc.unique(some["term"])
        entry, term = pc.index_in(some["id"], ids).to_numpy(), pc.index_in(some["term"], vocabulary).to_numpy()
        order = np.lexsort((term, entry))
        index = Index(entry[order], term[order], np.ones(len(entry)), len(ids), len(vocabulary))
        first = np.arange(min(limit, len(ids)))

        def nearest(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows, _ = index.postings(own, np.ones(len(own)))
            met, shared = np.unique(rows, return_counts=True)
            more = np.setdiff1d(np.arange(min(limit + len(met), len(ids))), met)[:limit] if len(met) < limit else first[:0]
            met, shared = np.concatenate([met, more]), np.concatenate([shared, np.zeros(len(more), np.int64)])
            top = np.lexsort((met, -shared))[:limit]
            return met[top], shared[top]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                sizes = pc.list_value_length(batch.column("terms")).to_numpy()
                terms = pc.fill_null(pc.index_in(pc.list_flatten(batch.column("terms")), vocabulary), -1).to_numpy()
                found = [nearest(own[own >= 0]) for own in np.split(terms, np.cumsum(sizes)[:-1])]
                which = np.repeat(np.arange(len(found)), [len(m) for m, _ in found])
                place, shared = np.concatenate([m for m, _ in found]), np.concatenate([s for _, s in found])
                yield pa.RecordBatch.from_arrays([batch.column("request").take(pa.array(which)), ids.take(pa.array(place)), pa.array(shared.astype(np.int32))], names=["request", "id", "overlap"])

        return asked.mapInArrow(run, f"request {request}, id {ident}, overlap int")

    w = Window.partitionBy("request").orderBy(F.col("overlap").desc(), "id")
    scored = in_blocks(entries, "id", blocks, one)
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def cache_match(entries: DataFrame, questions: DataFrame, threshold: float = 0.99) -> DataFrame:
    """question, entry, cosine: the best entry of equal version and veto profile, from the threshold on.

    The first in recency order wins among equals. Vectors without a cosine match nothing, nor do null versions or profiles. Entries stay where they lie, however many share a profile.
    """
    same = F.struct(F.col("version").cast("string"), F.col("profile").cast("string"))
    keyed = lambda df, *c: df.dropna(subset=["version", "profile"]).select(*c, F.to_json(same).alias("kind"))
    asked, stored = keyed(questions, "question", "vector"), keyed(entries, "entry", F.col("recency").cast("double").alias("recency"), "entry_vector")
    question, entry = dict(questions.dtypes)["question"], dict(entries.dtypes)["entry"]
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = -(-(size["n"] * max(size["d"] or 0, 1) * 8) // BLOCK_BYTES)

    def one(block: pa.Table) -> DataFrame:
        q, rows = units(block["vector"])
        block = block.take(pa.array(rows)).combine_chunks()
        ids, kinds = block["question"].combine_chunks(), pc.unique(block["kind"])
        kind = pc.index_in(block["kind"], kinds).to_numpy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # The first of equals in a row of scores is the most recent one.
                batch = pa.Table.from_batches([batch]).sort_by([("recency", "ascending"), ("entry", "descending")])
                v, at = units(batch["entry_vector"])
                if not len(at) or not len(q) or v.shape[1] != q.shape[1]:
                    continue
                own = pc.fill_null(pc.index_in(batch["kind"], kinds), -1).to_numpy()[at]
                which, place, values = [], [], []
                for c in np.unique(own[own >= 0]):
                    mine, theirs = np.flatnonzero(kind == c), np.flatnonzero(own == c)
                    step = max(AT_ONCE // len(theirs), 1)
                    for lo in range(0, len(mine), step):
                        scores = np.round(q[mine[lo : lo + step]] @ v[theirs].T, 6)
                        top = scores.argmax(axis=1)
                        value = scores[np.arange(len(top)), top]
                        hit = value >= threshold
                        which.append(mine[lo : lo + step][hit])
                        place.append(at[theirs[top[hit]]])
                        values.append(value[hit])
                if not which:
                    continue
                place = pa.array(np.concatenate(place))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.concatenate(which))), batch["entry"].combine_chunks().take(place), batch["recency"].combine_chunks().take(place), pa.array(np.concatenate(values))], names=["question", "entry", "recency", "cosine"]
                )

        return stored.mapInArrow(run, f"question {question}, entry {entry}, recency double, cosine double")

    hits = in_blocks(asked, "question", blocks, one)
    found = hits.groupBy("question").agg(F.max(F.struct("cosine", (-F.col("recency")).alias("r"), "entry")).alias("x"))
    return found.select("question", "x.entry", "x.cosine")
