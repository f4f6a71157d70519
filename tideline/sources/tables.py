"""Readers of the star-schema tables, as long series and as logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_number(ts: Column | str) -> Column:
    return F.datediff(F.col(ts) if isinstance(ts, str) else ts, F.lit("1970-01-01").cast("date"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (event type), x (day), value (mean)."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), day_number("ts").cast("long").alias("x")).agg(F.avg("value").alias("value"))


def monthly(spark: SparkSession, sf_dir: str, name: str, date: str, value: str) -> DataFrame:
    """x (months since year 0), value (mean) of a table by month."""
    month = F.year(date) * 12 + F.month(date) - 1
    return table(spark, sf_dir, name).groupBy(month.cast("long").alias("x")).agg(F.avg(value).alias("value"))
