"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification and union-find grouping.

A signature component is the least value, over a document's shingles, of (rank of the component in the shingle's own
random permutation) + (a random fraction). The ranks of one shingle are all different, which lowers the variance
against independent minima. They are dealt rank by rank to all shingles of a batch, and a document leaves the batch as
soon as each of its components has a value, since later ranks can only be larger.

Documents with equal shingle sets are one class. Classes that share a band are candidates: first against the most
central member of their bucket, then, in buckets that still hold several components, across components: a few members beside the
main component meet all of the bucket, and where there are many, pairs are made by prefixes instead. (Of two sets at the threshold,
the few rarest shingles of one meet those of the other.) Candidates are confirmed on the full sets, read again
from the texts. A large group of copies so costs as many pairs as it has members, and a large group that is alike below the threshold few.

Defined results: null, empty and white-space texts have no shingles and are linked with nothing. A text with fewer
words than a shingle is one shingle. Repeated rows of a doc_id give one row each; where they differ in text, each is linked by its own.
Null ids are allowed: a group has the least id that is not null, if any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .components import connected
from .shared import hold, sized, tidy

#: Length of a signature, of which each document has two. The first `BANDS * BAND` components of the first one make the bands:
#: 24 of 4 miss a pair at similarity 0.8 with probability 0.5904 ** 24 = 3e-6.
COMPONENTS, BANDS, BAND = 256, 24, 4
#: Four bits of each of the 512 components go into the fingerprint, 16 components to a word. Components of a pair at
#: similarity s differ with probability (1 - s) * 15 / 16. At 0.8, that is 96 of 512 with a deviation of 9 (less, by the
#: correlated ranks), and 18 with one of 3.8 among the first six words; these bounds are five deviations above.
WORDS = 2 * COMPONENTS // 16
MOST_DIFFERENT, FIRST_WORDS, MOST_FIRST = 140, 6, 38
#: Members of a bucket beside its main component up to which they are paired with all of it as they are: what a member costs is so many
#: comparisons of fingerprints at most, a millisecond or so.
BESIDE = 2048

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def signatures(hashes: np.ndarray, offs: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """One row of `m` values for each set; `hashes[offs[d]:offs[d + 1]]` are its distinct shingles. Empty sets stay unset."""
    n = len(offs) - 1
    sig = np.full((n, m), _NONE, _U)
    flat = sig.reshape(-1)
    x = hashes
    doc = np.repeat(np.arange(n), np.diff(offs))
    perm = None
    for rank in range(m):
        if not len(x):
            break
        z = H.mix(x + _U((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = rank + (((z & _U(0xFFFF)) * _U(m - rank)) >> _U(16)).astype(np.int64)
        value = (z >> _U(16)) | _U(rank << 48)
        if rank == 0:
            slot = at
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(x), 1))
                rows = np.arange(len(x))
                perm[rows, first], perm[:, 0] = 0, first
            rows = np.arange(len(x))
            slot = perm[rows, at].astype(np.int64)
            perm[rows, at] = perm[:, rank]
            perm[rows, rank] = slot
        np.minimum.at(flat, doc * m + slot, value)
        open_ = (sig == _NONE).any(axis=1)
        stay = open_[doc]
        if not stay.all():
            x, doc, at = x[stay], doc[stay], at[stay]
            if perm is not None:
                perm = perm[stay]
        first = at
    return sig


def distinct_shingles(words: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending."""
    sh, so = H.shingles(words, offs, width)
    parts = [H.distinct(sh[so[d] : so[d + 1]]) for d in range(len(so) - 1)]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), out


def _sketch_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("fp", pa.list_(pa.int64()))])
    for batch in batches:
        raw, offs = H.text_buffers(batch.column("text"))
        for lo, hi in H.row_chunks(offs):
            sh, so = distinct_shingles(*H.word_hashes(raw, offs[lo : hi + 1]), width)
            sig = np.concatenate([signatures(sh, so), signatures(H.mix(sh ^ _U(0xA0761D6478BD642F)), so)], axis=1)
            n = np.diff(so)
            key = np.zeros((hi - lo, BANDS), _U)
            for k in range(BAND):
                key = key * _U(0xD6E8FEB86659FD93) + sig[:, : BANDS * BAND].reshape(-1, BANDS, BAND)[:, :, k]
            key = H.mix(key + np.arange(BANDS, dtype=_U))
            four = (H.mix(sig) & _U(15)).reshape(-1, WORDS, 16)
            fp = np.bitwise_or.reduce(four << (_U(4) * np.arange(16, dtype=_U)), axis=2)
            sums = [np.concatenate([np.zeros(1, _U), np.cumsum(f(sh))]) for f in (lambda v: v, lambda v: H.mix(v ^ _U(0x5851F42D4C957F2D)))]
            d1, d2 = ((s[so[1:]] - s[so[:-1]]).view(np.int64) for s in sums)
            fixed = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "h")), pa.array(n), pa.array(d1), pa.array(d2), fixed(key), fixed(fp)], schema=schema)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h (hash of the text), n (distinct shingles), d1 and d2 (sums over the set: equal sets have equal ones), band keys and fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(tidy(lambda it: _sketch_batches(it, width)), "doc_id long, h long, n long, d1 long, d2 long, bands array<long>, fp array<long>")


def _verify_batches(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, keep = [], []
        for side in ("text_a", "text_b"):
            raw, offs = H.text_buffers(batch.column(side))
            sets.append((raw, offs))
        last: tuple[object, np.ndarray | None] = (None, None)
        ids = batch.column("a").to_pylist()
        for k in range(batch.num_rows):
            if last[0] != ids[k] or last[1] is None:
                last = (ids[k], distinct_shingles(*H.word_hashes(sets[0][0], sets[0][1][k : k + 2]), width)[0])
            other = distinct_shingles(*H.word_hashes(sets[1][0], sets[1][1][k : k + 2]), width)[0]
            common = len(np.intersect1d(last[1], other, assume_unique=True))
            union = len(last[1]) + len(other) - common
            keep.append(union > 0 and 100 * common >= percent * union)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _texts(docs: DataFrame, classes: DataFrame, cids: DataFrame) -> DataFrame:
    """cid and text, once for each class in the table `cids` (cid)."""
    wanted = sized(hold(classes.join(cids.distinct(), "cid", "left_semi").select("cid", "rep"), "wanted"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("h") == F.col("rep.h"))).select("cid", "text")
    return found.dropDuplicates(["cid"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the held table `pairs` (a, b; classes) whose full shingle sets have 100 * intersection >= percent * union."""
    side = lambda c: _texts(docs, classes, pairs.select(F.col(c).alias("cid"))).select(F.col("cid").alias(c), F.col("text").alias(f"text_{c}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(tidy(lambda it: _verify_batches(it, width, percent)), "a long, b long")


def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = H.text_buffers(batch.column("text"))
        for lo, hi in H.row_chunks(offs):
            sh, so = distinct_shingles(*H.word_hashes(raw, offs[lo : hi + 1]), width)
            yield pa.RecordBatch.from_arrays([batch.column("cid").slice(lo, hi - lo), pa.ListArray.from_arrays(so.astype(np.int32), pa.array(sh.view(np.int64)))], names=["cid", "shingles"])


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """cid and keys, the rarest shingles of each of `sets` (cid, shingles): as many as make two sets at the threshold share one."""
    tokens = sets.select("cid", F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    ranked = tokens.join(counts, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("all"))
    n = F.size("all")
    head = F.slice("all", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    return ranked.select("cid", F.filter(head, lambda x: x["times"] > 1)["token"].alias("keys"))


def _differing(x: Column, y: Column) -> Column:
    """How many of 16 components differ between two words of fingerprints."""
    z = x.bitwiseXOR(y)
    any_bit = z
    for k in (1, 2, 3):
        any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(z, k))
    return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))


def _alike(percent: int) -> Column:
    """What pairs at the threshold meet: set sizes, exactly, and fingerprints, but for a negligible share.

    The bounds on fingerprints hold for similarities of 0.8 and more; below that only sizes are compared.
    """
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sizes = 100 * low >= percent * high
    if percent < 80:
        return sizes
    first = reduce(lambda p, q: p + q, (_differing(F.get("fp_a", F.lit(k)), F.get("fp_b", F.lit(k))) for k in range(FIRST_WORDS)))
    every = F.aggregate(F.zip_with("fp_a", "fp_b", _differing), F.lit(0), lambda acc, x: acc + x)
    return sizes & (first <= MOST_FIRST) & (every <= MOST_DIFFERENT)


def _beside(placed: DataFrame) -> DataFrame:
    """`placed` (key, cid, root) with the component that most members of a bucket are in, and how many are in others."""
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    most = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    return placed.join(most.select("key", F.col("most.root").alias("main"), (F.col("n") - F.col("most.n")).alias("beside")), "key")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, h (hash of the text), n, component and top (hash of the text that stands for the group) for each row of `docs`."""
    sketch = hold(sketches(docs, width), "sketch")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep")
    classes = sketch.filter("n > 0").groupBy("d1", "d2").agg(rep, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    classes = hold(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    banded = classes.select("cid", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = hold(banded.join(shared, "key"), "members")
    # The member that shares the largest buckets is the likely origin of the others.
    central = members.groupBy("cid").agg(F.sum("size").alias("weight"))
    ranked = members.join(central, "cid").select("key", "cid", F.struct("weight", (-F.col("cid")).alias("low")).alias("rank"))
    centres = ranked.groupBy("key").agg((-F.max("rank")["low"]).alias("centre"))
    tall = classes.select("cid", "n", "fp")
    side = lambda c: tall.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("fp").alias(f"fp_{c}"))

    spokes = members.join(centres, "key").filter("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    candidates = hold(spokes.join(side("b"), "b").join(side("a"), "a").filter(_alike(percent)).select("a", "b"), "candidates")
    links = hold(verified(candidates, docs, classes, width, percent), "links")
    found = connected(links)

    # Buckets that still hold several components: their centre has met all, members of different components have not.
    placed = members.select("key", "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    left = _beside(hold(placed.join(mixed, "key"), "open"))
    few = left.filter(F.col("beside") <= BESIDE).select("key", "cid", "root").join(classes.select("cid", F.col("bands").alias("keys")), "cid")
    many = hold(left.filter(F.col("beside") > BESIDE).select("cid", "root").distinct(), "many")
    sets = _texts(docs, classes, many.select("cid")).mapInArrow(tidy(lambda it: _set_batches(it, width)), "cid long, shingles array<long>")
    by_prefix = prefixes(hold(sets, "sets"), percent).join(many, "cid").select(F.explode("keys").alias("key"), "cid", "root", "keys")
    spread = hold(_beside(few.unionByName(by_prefix)).filter("beside > 0").join(tall, "cid"), "spread")
    names = (("cid", ""), ("root", "root_"), ("n", "n_"), ("fp", "fp_"), ("keys", "keys_"))
    half = lambda rows, c: rows.select("key", "main", *(F.col(old).alias(f"{new}{c}") for old, new in names))
    # A pair is made once in a bucket, and in the first bucket that it shares.
    apart = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("a") < F.col("b")))
    once = F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0)) == F.col("key")
    met = half(spread.filter("root <> main"), "a").join(half(spread, "b").drop("main"), "key").filter(apart & _alike(percent) & once)
    pair = lambda t: t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    untried = hold(pair(met).distinct().join(pair(candidates), ["a", "b"], "left_anti"), "untried")
    more = hold(verified(untried, docs, classes, width, percent), "more")
    if not more.isEmpty():
        found = connected(links.unionByName(more))

    # The group of a class: the least id and, of that id, the text that stays.
    roots = found.withColumnRenamed("node", "cid").unionByName(found.select(F.col("root").alias("cid"), "root").distinct())
    named = hold(classes.select("cid", "d1", "d2", "rep").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "named")
    tops = named.groupBy("root").agg(F.min("rep").alias("top"))
    groups = named.join(tops, "root").select("d1", "d2", "top")
    out = sketch.select("doc_id", "h", "n", "d1", "d2").join(groups, ["d1", "d2"], "left")
    linked = F.col("n") > 0
    return out.select("doc_id", "h", "n", F.when(linked, F.col("top.doc_id")).otherwise(F.col("doc_id")).alias("component"), F.when(linked, F.col("top.h")).alias("top"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Shingles are `width` words in lower case (A-Z); sets with 100 * intersection >= percent * union are linked.
    """
    rows = _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with its columns, of which one stays for each group: of its least id, of these the least text hash, of equal rows any.

    Rows without a shingle are in no group and stay.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.struct("*").alias("row"))
    rows = _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent)
    stays = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("h") == F.col("top")))
    kept = rows.filter(stays).groupBy("doc_id", "h").agg(((F.max("n") > 0) & (F.count(F.lit(1)) > 1)).alias("again"))
    kept = sized(hold(kept.select(F.col("doc_id").alias("id"), F.col("h").alias("text_hash"), "again"), "kept"))
    chosen = whole.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash"))).select("doc_id", "h", "row", "again")
    # Most texts occur once with their id; only others are shuffled to leave one.
    repeated = chosen.filter("again").dropDuplicates(["doc_id", "h"])
    return chosen.filter("not again").select("row.*").unionByName(repeated.select("row.*"))
