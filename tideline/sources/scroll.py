"""Reading a large table page by page, in the order of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import scratch

#: An id of `monotonically_increasing_id` has the partition above so many bits and the row in it below.
_ROW_BITS = 33


def scroll(df: DataFrame, key: str, size: int, after: object = None) -> DataFrame:
    """The `size` rows that follow `after` by a key without ties or nulls; each task keeps `size` rows of its own, and the bound reaches the scan."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Adds `number`, from 0, by `keys`. Rows are dealt into ranges of the keys and sorted there; what lies before a range is a sum over ranges, so no task sees all rows. Rows alike in `keys` come in any order."""
    path = scratch(df.sparkSession, "numbered")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__part", F.shiftright("__at", _ROW_BITS))
    sizes = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each range
    before = [(part, sum(n for p, n in sizes if p < part)) for part, _ in sizes]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "__part long, __start long"))
    place = F.col("__start") + F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    return rows.join(starts, "__part").select(*df.columns, place.alias("number"))


def paged(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """Adds `page`, from 0: so many rows each, by `keys`."""
    return numbered(df, *keys).withColumn("page", F.floor(F.col("number") / size)).drop("number")
