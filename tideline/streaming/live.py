"""The log analytics as streams: spend by day, sliding request limits, retention of state and incremental index feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as they come, with event time as a timestamp (a stream needs one with a zone)."""
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_spend(events: DataFrame, amount: str, late: str = "1 day") -> DataFrame:
    """day, event_type, spent for days that the watermark has passed."""
    day = F.window("ts", "1 day")
    sums = events.withWatermark("ts", late).groupBy(day.alias("w"), "event_type").agg(F.sum(F.col(amount).cast("decimal(18,6)")).alias("spent"))
    return sums.select(F.to_date("w.start").alias("day"), "event_type", "spent")


def distinct_exchanges(events: DataFrame, key: str, keep: str = "7 days") -> DataFrame:
    """Each key once while its state is kept; older keys' state expires with the watermark."""
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark([key])


def sliding_limits(events: DataFrame, key: str, seconds: int, most: int, idle_minutes: int = 60) -> DataFrame:
    """key, ts, in_window, allowed for each request as it comes: those of the key in the last `seconds` count, refused ones too.

    The state of a key is the times within its window; a key that stays idle loses it.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(t for b in batches for t in b["ts"]):
            at = int(t.timestamp())
            times = [x for x in times if x > at - seconds] + [at]
            out.append((k[0], t, len(times), len(times) <= most))
        state.update((times,))
        state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame(out, columns=[key, "ts", "in_window", "allowed"])

    schema = f"{key} {dict(events.dtypes)[key]}, ts timestamp, in_window long, allowed boolean"
    return events.select(key, "ts").groupBy(key).applyInPandasWithState(step, schema, "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_sink(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each batch to `merge` with its number, so that one that comes again can be told; starts the query."""
    return stream.writeStream.foreachBatch(lambda df, n: merge(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
