"""Filter interaction audit: what every order of a set of filters removes, from one count for each set of failures.

A document's mask has a bit for every filter that it fails. Counted by part and mask, these counts pass through a subset-zeta
transform, after which entry m holds the documents whose failures all lie within m; the survivors of a subset F of filters
are entry (all - F). What a step of an order removes is the difference between two neighbouring subsets, and so is what it
costs in labelled documents. No order is ever run: 32 counts a part answer all 120 of them.

`duplicate` (filter E) is a row whose text stands in a row of a smaller id. Its rows are those of all rows less the first ones,
and first ones are found by an equality on (digest of the text, least id): no group of copies is gathered anywhere.

Defined results: a null text is empty, and an empty text has no words. A null source is the part ''. A row without an id is never
a duplicate and makes none; rows that repeat the least id of a text are all first. Several labels of an id count as one, with 1
before 0; null labels and labels of unknown ids count as none. An empty table has no part, so no row. Texts are told apart by SHA-256.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hold, sized, words

#: A filter's letter and the condition under which a document fails it, over `text`, `w` (its words) and the counts of both.
FAILS: dict[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_points",
    "D": "text rlike '[#$%&*|]'",
}
DUPLICATE = "E"
COUNTS = ("rows", "good", "toxic")


def masks(docs: DataFrame, labels: DataFrame, fails: dict[str, str] = FAILS) -> DataFrame:
    """doc_id, part, digest, mask (of the filters in `fails`), good, toxic: one narrow row for each row of `docs`."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("w", words(F.col("text"))).select("doc_id", "part", "text", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))
    rows = rows.withColumns({"n_capitals": F.regexp_count("text", F.lit("[A-Z]")), "n_points": F.length("text")})
    mask = sum((F.expr(f"if({condition}, {1 << k}, 0)") for k, condition in enumerate(fails.values())), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    marked = labels.select(F.col("doc_id").cast("long").alias("of"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("of is not null and (good or toxic)")
    marked = hold(marked.groupBy("of").agg(*(F.coalesce(F.max(c), F.lit(False)).cast("int").alias(c) for c in ("good", "toxic"))), "marked")
    joined = rows.join(sized(marked), F.col("doc_id") == F.col("of"), "left")
    return joined.select("doc_id", "part", "digest", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("rows"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def failure_counts(rows: DataFrame, bit: int) -> DataFrame:
    """part, mask, rows, good, toxic: `rows` counted by part and mask, with `bit` set in the masks of duplicates."""
    least = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least")).withColumnRenamed("digest", "of")
    first = rows.join(least, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("least"))).select(rows.columns)
    first = _counted(first.unionByName(rows.filter("doc_id is null")))
    signed = first.unionByName(_counted(rows).withColumn("mask", F.col("mask") + bit))
    signed = signed.unionByName(first.select("part", (F.col("mask") + bit).alias("mask"), *((-F.col(c)).alias(c) for c in COUNTS)))
    return signed.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _adding(step: int):
    return lambda v: F.transform(v, lambda x, m: x + F.when(m.bitwiseAND(step) > 0, F.get(v, m - step)).otherwise(0))


def zeta(values: Column, bits: int) -> Column:
    """Entry m of the result is the sum of the entries of `values` whose index is a subset of m."""
    for b in range(bits):
        values = F.get(F.transform(F.array(values), _adding(1 << b)), F.lit(0))
    return values


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of `letters` and step, from `failure_counts`; bit k of a mask is letter k."""
    bits, full = len(letters), (1 << len(letters)) - 1
    spread = [F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(full + 1))).alias(c) for c in COUNTS]
    parts = counts.groupBy("part").agg(*spread)
    for c in COUNTS:
        parts = parts.withColumn(c, zeta(F.col(c), bits))

    def survivors(of: str, removed_by: Column) -> Column:
        return F.get(F.col(of), full - removed_by)

    steps = []
    for order in permutations(range(bits)):
        name, before = "".join(letters[k] for k in order), 0
        for n, k in enumerate(order):
            steps.append(f"('{name}', {n + 1}, {before}, {1 << k})")
            before |= 1 << k
    table = counts.sparkSession.sql(f"select * from values {', '.join(steps)} as t(filter_order, step, before, bit)")
    listed = table.agg(F.collect_list(F.struct("filter_order", "step", "before", "bit")).alias("steps"))
    out = parts.join(F.broadcast(listed)).select("part", *COUNTS, F.inline("steps"))
    lost = lambda of, before: survivors(of, before) - survivors(of, before.bitwiseOR(F.col("bit")))
    # In so many orders exactly the filters of s come before another one.
    weighed = [(factorial(s.bit_count()) * factorial(bits - 1 - s.bit_count()), s) for s in range(full)]
    shapley = sum((F.when(F.col("bit").bitwiseAND(s) == 0, w * lost("rows", F.lit(s))).otherwise(0) for w, s in weighed), F.lit(0))
    removed = lost("rows", F.col("before"))
    return out.select(
        "part", "filter_order", "step",
        survivors("rows", F.col("before").bitwiseOR(F.col("bit"))).alias("kept"), removed.alias("removed"), (lost("rows", F.lit(0)) - removed).alias("redundant"),
        lost("rows", F.lit(full) - F.col("bit")).alias("unique_fails"), lost("good", F.col("before")).alias("good_lost"), lost("toxic", F.col("before")).alias("toxic_lost"), shapley.cast("long").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, fails: dict[str, str] = FAILS) -> DataFrame:
    """The audit of the filters `fails` and, last, of `duplicate`, for each source of `docs`."""
    rows = hold(masks(docs, labels, fails), "masks")
    return audit(hold(failure_counts(rows, 1 << len(fails)), "failures"), "".join(fails) + DUPLICATE)


def op13_filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return audit_filters(documents, labels)
