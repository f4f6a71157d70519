"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingle sets.

Items are partitioned by their number of shingles (powers of two). An item of n shingles that is contained at the
threshold lacks at most n - ceil(t * n) of them in the document, so of its k least hash values (k depends on the
partition, and exceeds that number) at least k minus that number are met. Only those minima are looked up among the
document's shingle hashes: no document is paired with an item that it shares none of them with, and no contained item
is missed, however long the document. Candidates are confirmed by the shingles themselves, as strings.

Everything is DataFrame expressions. The table of minima and the items are broadcast within a counted size, else
shuffled.

Defined results: words are runs of letters and digits in lower case. Null, empty and wordless texts or items match
nothing. An item of fewer than `width` words is one shingle of all its words, found where they stand in a row.
Items of equal text are reported each. In `contained_items` rows that repeat a doc_id count as one document with the highest containment, and
rows without one are left out; `decontaminate` judges each row by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hold, sized

NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _each(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(n: Column, width: int) -> Column:
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, width: int) -> Column:
    """Hashes of all windows of `width` words, in order."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _each(hashed, lambda h: F.transform(_starts(F.size(h), width), lambda i: F.xxhash64(F.lit(width), *(F.get(h, i + k) for k in range(width)))))


def shingle_texts(words: Column, width: int) -> Column:
    return _each(words, lambda w: F.array_distinct(F.transform(_starts(F.size(w), width), lambda i: F.array_join(F.slice(w, i + 1, width), " "))))


def item_table(items: DataFrame, width: int) -> DataFrame:
    """item_id, width (of its shingles), shingles and hashes (both distinct), n."""
    t = items.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    t = t.withColumn("width", F.least(F.size("w"), F.lit(width)))
    return t.select("item_id", "width", _by_width(shingle_texts, width).alias("shingles"), F.array_distinct(_by_width(shingle_hashes, width)).alias("hashes")).withColumn("n", F.size("shingles"))


def _by_width(make, width: int) -> Column:
    """`make(words, width)` for the width that the row's `width` column names."""
    return F.coalesce(*(F.when(F.col("width") == k, make(F.col("w"), k)) for k in range(1, width + 1)))


def minima(items: DataFrame, percent: int) -> DataFrame:
    """hash, item_id, must: the least hash values of each item, and how many of them a document must hold."""
    part = F.floor(F.log2(F.col("n"))).cast("int")
    largest = F.pow(F.lit(2.0), part + 1) - 1
    missing = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int")
    k = F.least(F.col("n"), F.floor(largest * (100 - percent) / 100).cast("int") + 2)
    kept = items.withColumn("low", F.slice(F.sort_array("hashes"), F.lit(1), k))
    return kept.select("item_id", (F.size("low") - missing).alias("must"), F.explode("low").alias("hash"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found, containment: items of which `percent` of the shingles are in the document. Rows without an id are left out."""
    return _search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null"), items, width, percent)


def _search(docs: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame:
    """`contained_items` for a doc_id of any type that is never null."""
    index = hold(item_table(items, width), "items")
    widths = [r[0] for r in index.select("width").distinct().collect()]  # `width` values at most
    probes = sized(hold(minima(index, percent), "minima"))
    hashes = F.concat(*(shingle_hashes(F.col("w"), k) for k in sorted(widths))) if widths else F.array().cast("array<long>")
    seen = docs.select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.explode(hashes).alias("hash"))
    found = seen.join(probes, "hash").select("doc_id", "item_id", "must", "hash").distinct()
    candidates = found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("met"), F.min("must").alias("must")).filter("met >= must").select("doc_id", "item_id")
    candidates = hold(candidates, "candidates")
    hit = sized(hold(candidates.select("doc_id").distinct(), "hit"))
    texts = docs.join(hit, "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("w"))
    pairs = candidates.join(texts, "doc_id").join(sized(index, 10_000, "shingles"), "item_id")
    own = _by_width(shingle_texts, width)
    exact = pairs.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.size(F.array_intersect("shingles", own)).cast("long").alias("n_found"))
    exact = exact.filter(100 * F.col("n_found") >= percent * F.col("n_shingles"))
    best = exact.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return best.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with its columns, that contain no item. Each row is judged by its own text (told apart by SHA-256), whatever its id: null and repeated ids stay or go by row."""
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    bad = hold(_search(docs.select(key.alias("doc_id"), "text"), items, width, percent).select(F.col("doc_id").alias("__bad")).distinct(), "bad")
    return docs.join(sized(bad), key == F.col("__bad"), "left_anti")
