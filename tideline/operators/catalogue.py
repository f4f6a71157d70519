"""Manifests as tables: field checks, pack membership, blocked pairs, what may be offered, and what may be shipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = r"^[a-z0-9][a-z0-9._-]{0,63}$"
SHA = r"^[0-9a-f]{64}$"


def required(column: str) -> Column:
    return F.when(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "", F.lit(f"{column}: missing"))


def one_of(column: str, words: Sequence[str]) -> Column:
    """An unknown word is a violation, never a default."""
    return F.when(~F.coalesce(F.col(column).isin(*words), F.lit(False)), F.concat(F.lit(f"{column}: unknown value "), F.coalesce(F.col(column), F.lit("null"))))


def matches(column: str, pattern: str) -> Column:
    return F.when(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)), F.lit(f"{column}: not of its form"))


def is_date(column: str) -> Column:
    return F.when(F.try_to_date(F.col(column), "yyyy-MM-dd").isNull(), F.lit(f"{column}: no date"))


def violations(df: DataFrame, checks: Sequence[Column], key: str = "id") -> DataFrame:
    """Adds `violations`: all that is wrong with each row, each once, in order; an id that repeats is wrong in each of its rows."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    joined = df.join(repeated, key, "left")
    again = F.when(F.col("__n").isNotNull(), F.lit(f"{key}: repeated"))
    return joined.withColumn("violations", F.array_distinct(F.array_compact(F.array(*checks, again)))).drop("__n")


def refuse(df: DataFrame) -> DataFrame:
    """Raises with all violations where there are any (one job; a report of a thousand rows at most), else the rows."""
    bad = df.filter(F.size("violations") > 0).select("violations").limit(1000).collect()
    if bad:
        raise ValueError("; ".join(v for r in bad for v in r["violations"]))
    return df.drop("violations")


def pack_members(datasets: DataFrame) -> DataFrame:
    return datasets.filter(F.col("in_chart_pack").eqNullSafe(F.lit(True)))


def blocked_pairs(pairs: DataFrame, pack: DataFrame) -> DataFrame:
    """pair and reason for pairs with a member outside the pack."""
    inside = pack.select("id")
    out = None
    for side in ("first", "second"):
        missing = pairs.join(inside, pairs[side] == inside["id"], "left_anti").select("pair", F.concat(F.lit("not in the pack: "), F.col(side)).alias("reason"))
        out = missing if out is None else out.unionByName(missing)
    return out.groupBy("pair").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))


def offered(datasets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets of the pack in an open context, and pairs of which both members are among them."""
    own = pack_members(datasets).filter("permitted_context = 'open'")
    ids = own.select("id")
    both = pairs.join(ids, pairs["first"] == ids["id"], "left_semi")
    return own, both.join(ids, both["second"] == ids["id"], "left_semi")


def unshipped(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Prepared files that no document declares as open."""
    declared = documents.filter("permitted_context = 'open' and redistributable").select("path")
    return files.join(declared, "path", "left_anti")


def launch_check(documents: DataFrame, flag: str) -> Column:
    """An aggregate: whether any document that will be ingested carries the flag."""
    return F.coalesce(F.bool_or(F.col("ingest") & F.col(flag)), F.lit(False))


def agreed_version(votes: DataFrame) -> DataFrame:
    """key, label: the licence and its version where exactly one agreeing source states one."""
    by = votes.groupBy("key", "token").agg(F.collect_set("version").alias("v"))
    version = F.when(F.size("v") == 1, F.concat(F.lit(" "), F.get("v", F.lit(0)))).otherwise("")
    return by.select("key", F.concat("token", version).alias("label"))


def coverage_union(members: DataFrame) -> DataFrame:
    return members.groupBy("pair").agg(F.min("start").alias("start"), F.max("end").alias("end"))
