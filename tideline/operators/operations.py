"""Spend, rate limits, retention, feedback and energy over logs of exchanges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dollars for a million input and output tokens by model family, and multipliers.
RATES = {"claude-haiku": (1.0, 5.0), "claude-sonnet": (3.0, 15.0), "claude-opus": (5.0, 25.0)}
BATCH, CACHE_READ, CACHE_WRITE = 0.5, 0.1, 1.25

#: Fixed values: (low, central, high). Wh for 1000 tokens, share of a cached read, watts of a CPU, overhead, grams of CO2e for a kWh.
WH_OUT, WH_IN, CACHED = (0.1, 0.5, 1.5), (0.005, 0.02, 0.07), (0.05, 0.08, 0.20)
WATTS, OVERHEAD = (0.7, 2.2, 3.8), (1.1, 1.13, 1.2)
GRAMS_API, GRAMS_LOCAL = (287.0, 384.0, 450.0), 363.0
TEA_WH, CAR_GRAMS_METRE, STREAM_GRAMS_HOUR = 31.0, 0.25, 36.0
BOUNDS = ("low", "central", "high")


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column, mode: Column, cache_read: Column | None = None, cache_write: Column | None = None) -> Column:
    """Dollars of a call. A model of no known family is an error when the row is read."""
    zero = F.lit(0.0)
    unknown = F.raise_error(F.concat(F.lit("unknown model "), F.coalesce(model, F.lit("null")))).cast("double")
    rate_in = rate_out = unknown
    for family, (a, b) in RATES.items():
        rate_in = F.when(model.startswith(family), a).otherwise(rate_in)
        rate_out = F.when(model.startswith(family), b).otherwise(rate_out)
    cached = (cache_read if cache_read is not None else zero) * CACHE_READ + (cache_write if cache_write is not None else zero) * CACHE_WRITE
    return ((tokens_in + cached) * rate_in + tokens_out * rate_out) / 1_000_000 * F.when(mode == "batch", BATCH).otherwise(1.0)


def running_total(df: DataFrame, amount: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Adds `total`: exact running sums in order."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(F.col(amount).cast("decimal(18,6)")).over(w))


def daily_and_week(df: DataFrame, amount: str, day: Column, by: Sequence[str]) -> DataFrame:
    """For each day: its sum, and that of the seven days that end with it."""
    days = df.groupBy(*by, day.alias("day")).agg(F.sum(F.col(amount).cast("decimal(18,6)")).alias("spent"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    return days.withColumn("week", F.sum("spent").over(Window.partitionBy(*by).orderBy(number).rangeBetween(-6, 0)))


def spend_mode(spent: Column, cap: float) -> Column:
    """paused from the cap on, and where the sum is unknown."""
    return F.when(spent < cap, "normal").otherwise("paused")


def sliding_rate(df: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Adds `in_window` (requests of the key in the last `seconds`, this and refused ones included) and `allowed`."""
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__at").rangeBetween(-(seconds - 1), 0)
    counted = df.withColumn("__at", at).withColumn("in_window", F.count(F.lit(1)).over(w))
    return counted.withColumn("allowed", F.col("in_window") <= most).drop("__at")


def retained(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows less than `days` old."""
    return df.filter(F.col(ts).cast("timestamp") > now - F.make_dt_interval(F.lit(days)))


def latest_feedback(exchanges: DataFrame, feedback: DataFrame, key: str = "exchange", seq: str = "seq", verdict: str = "verdict") -> DataFrame:
    """Each exchange with its last verdict; verdicts of unknown exchanges go."""
    last = feedback.groupBy(key).agg(F.max_by(verdict, seq).alias(verdict))
    return exchanges.join(last, key, "left")


def triage(df: DataFrame, by: Sequence[str], verdict: str = "verdict", seq: str = "seq") -> DataFrame:
    """Adds `place`: those marked down first, each part in its order."""
    order = Window.partitionBy(*by).orderBy(F.col(verdict).eqNullSafe(F.lit("down")).desc(), seq)
    return df.withColumn("place", F.row_number().over(order))


def energy_wh(tokens_in: Column, tokens_out: Column, cache_read: Column, multiplier: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """A struct of low, central and high Wh of one exchange."""
    return F.struct(
        *(
            (((tokens_out * o) + (tokens_in * i) + cache_read * i * c) / 1000 * m).cast("double").alias(b)
            for o, i, c, m, b in zip(WH_OUT, WH_IN, CACHED, multiplier, BOUNDS, strict=True)
        )
    )


def local_wh(cpu_seconds: Column) -> Column:
    return F.struct(*((cpu_seconds * w / 3600 * o).cast("double").alias(b) for w, o, b in zip(WATTS, OVERHEAD, BOUNDS, strict=True)))


def grams_co2e(wh: Column, per_kwh: tuple[float, float, float] = GRAMS_API) -> Column:
    return F.struct(*((wh[b] * g / 1000).alias(b) for g, b in zip(per_kwh, BOUNDS, strict=True)))


def sum_range(column: str) -> Column:
    return F.struct(*(F.sum(F.col(column)[b]).alias(b) for b in BOUNDS))


def tea_mugs(wh: Column) -> Column:
    return F.struct(*((wh[b] / TEA_WH).alias(b) for b in BOUNDS))


def exchanges_in_a_mug(wh: Column) -> Column:
    """How many exchanges make one mug: the bounds change places."""
    return F.struct((TEA_WH / wh["high"]).alias("low"), (TEA_WH / wh["central"]).alias("central"), (TEA_WH / wh["low"]).alias("high"))


def once(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def least_recently_used(df: DataFrame, used: str, tie: str, most: int, by: Sequence[str]) -> DataFrame:
    """The `most` entries that were used last."""
    w = Window.partitionBy(*by).orderBy(F.col(used).desc(), F.col(tie))
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most).drop("__k")


def salt_period(ts: Column, seconds: int) -> Column:
    """The number of the period whose salt holds."""
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds)


def merge_usage(a: Column, b: Column) -> Column:
    """Counters added key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
