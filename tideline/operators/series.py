"""Transforms of time series in long form: (series, x, value), where x is a year or any ordered number.

Each works on all series at once, with windows partitioned by series, so no plan needs one task for all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Year before which ages "before present" count.
EPOCH = 1950.0

#: Factors between units.
CONVERSIONS = {("Mt CO2/yr", "Gt CO2/yr"): 1e-3, ("degC_anomaly", "degF_anomaly"): 1.8}


class SeriesError(ValueError):
    """A transform was asked for something that it refuses."""


def _window_of(series: Sequence[str]) -> Window:
    return Window.partitionBy(*series)


def bp_to_ce(df: DataFrame, age: str = "age_bp", year: str = "year_ce") -> DataFrame:
    """Ages before present as calendar years."""
    return df.withColumn(year, F.lit(EPOCH) - F.col(age).cast("double")).drop(age)


def resample_rows(df: DataFrame, width: int, series: Sequence[str] = ("series",), x: str = "x", value: str = "value") -> DataFrame:
    """Means of x and value over runs of `width` rows from the first; a last run that is not full is dropped.

    Rows of equal x are ordered by value.
    """
    if width < 1:
        raise SeriesError("a window has at least one row")
    order = _window_of(series).orderBy(x, value)
    run = df.withColumn("__run", F.floor((F.row_number().over(order) - 1) / width))
    means = run.groupBy(*series, "__run").agg(F.avg(x).alias(x), F.avg(value).alias(value), F.count(F.lit(1)).alias("__n"))
    return means.filter(F.col("__n") == width).select(*series, x, value)


def rolling_mean_complete(df: DataFrame, width: int, series: Sequence[str] = ("series",), x: str = "x", value: str = "value") -> DataFrame:
    """Mean of the rows whose x lies within (width - 1) / 2 of the row's own, where these are `width` rows."""
    if width < 1:
        raise SeriesError("a window has at least one member")
    keys = ", ".join(f"`{s}`" for s in series)
    half = (width - 1) / 2
    frame = f"(PARTITION BY {keys} ORDER BY cast(`{x}` AS double) RANGE BETWEEN {half}D PRECEDING AND {half}D FOLLOWING)"
    means = df.withColumns({"__n": F.expr(f"count(*) OVER {frame}"), "__mean": F.expr(f"avg(`{value}`) OVER {frame}")})
    return means.filter(F.col("__n") == width).select(*series, x, F.col("__mean").alias(value))


def clip(df: DataFrame, low: float, high: float, x: str = "x") -> DataFrame:
    """Rows from `low` to `high`, both included."""
    return df.filter(F.col(x).between(low, high))


def anomaly(df: DataFrame, series: Sequence[str] = ("series",), value: str = "value") -> DataFrame:
    """Values less the mean of their whole series."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(_window_of(series)))


def rebaseline(df: DataFrame, low: float, high: float, series: Sequence[str] = ("series",), x: str = "x", value: str = "value", strict: bool = True) -> DataFrame:
    """Values less their series' mean over x from `low` to `high`.

    A series without a value there is an error when the row is read (`strict`), or gives null.
    """
    mean = F.avg(F.when(F.col(x).between(low, high), F.col(value))).over(_window_of(series))
    if strict:
        mean = F.coalesce(mean, F.raise_error(F.lit(f"no value from {low} to {high} to align on")).cast("double"))
    return df.withColumn(value, F.col(value) - mean)


def convert_units(df: DataFrame, source: str, target: str, value: str = "value") -> DataFrame:
    if source == target:
        return df
    if (source, target) not in CONVERSIONS:
        raise SeriesError(f"no conversion from {source!r} to {target!r}")
    return df.withColumn(value, F.col(value) * CONVERSIONS[source, target])


def splice(older: DataFrame, newer: DataFrame, at: float, x: str = "x", older_name: str = "paleo", newer_name: str = "instrumental", check: bool = False) -> DataFrame:
    """Rows of `older` before `at` and of `newer` from `at` on, with the columns that both have, and their `segment`.

    With `check`, either side left empty is an error (that takes a job for each).
    """
    common = [c for c in older.columns if c in newer.columns]
    if x not in common:
        raise SeriesError(f"both sides need {x!r}")
    left = older.filter(F.col(x) < at).select(F.lit(older_name).alias("segment"), *common)
    right = newer.filter(F.col(x) >= at).select(F.lit(newer_name).alias("segment"), *common)
    if check:
        for side, name in ((left, older_name), (right, newer_name)):
            if side.isEmpty():
                raise SeriesError(f"the {name} side of the splice is empty")
    return left.unionByName(right)


def outer_merge(frames: dict[str, DataFrame], x: str = "x", value: str = "value") -> DataFrame:
    """One row for each x of any frame, one column for each frame; null where it has no value.

    Done as one aggregate over the union, which shuffles once for any number of frames. A repeated x within a frame is
    an error.
    """
    long = None
    for name, frame in frames.items():
        one = frame.select(F.col(x).cast("double").alias(x), F.lit(name).alias("__of"), F.col(value).cast("double").alias("__v"))
        long = one if long is None else long.unionByName(one)

    def column(name: str) -> Column:
        own = F.col("__of") == name
        once = F.when(F.count_if(own) > 1, F.raise_error(F.lit(f"{name} repeats a key")).cast("double"))
        return once.otherwise(F.max(F.when(own, F.col("__v")))).alias(name)

    return long.groupBy(x).agg(*(column(n) for n in frames))


def extents(df: DataFrame, series: Sequence[str] = ("series",), value: str = "value") -> DataFrame:
    return df.groupBy(*series).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def coverage(df: DataFrame, series: Sequence[str] = ("series",), x: str = "x") -> DataFrame:
    """First and last x, rounded half to even."""
    return df.groupBy(*series).agg(F.bround(F.min(x)).cast("long").alias("start"), F.bround(F.max(x)).cast("long").alias("end"))


def trend(df: DataFrame, series: Sequence[str] = ("series",), x: str = "x", value: str = "value", epsilon: float = 1e-9) -> DataFrame:
    """rises, falls or is unchanged, by the values at the first and last x."""
    ends = df.groupBy(*series).agg(F.min_by(value, x).alias("first"), F.max_by(value, x).alias("last"))
    change = F.col("last") - F.col("first")
    return ends.withColumn("trend", F.when(change > epsilon, "rises").when(change < -epsilon, "falls").otherwise("is unchanged"))


def select_entity(df: DataFrame, entity: str | None, column: str = "entity") -> DataFrame:
    """The rows of one entity. Without a name, a frame of several entities is refused."""
    if column not in df.columns:
        if entity is not None:
            raise SeriesError(f"no column {column!r} to select {entity!r} from")
        return df
    if entity is None:
        if df.select(column).distinct().limit(2).count() > 1:
            raise SeriesError("several entities and none is configured")
        return df
    return df.filter(F.col(column) == entity)


def band(df: DataFrame, before: float | None = None, x: str = "x", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Uncertainty bounds, of rows before a splice only where one is given."""
    rows = df if before is None else df.filter(F.col(x) < before)
    return rows.filter(F.col(lower).isNotNull() & F.col(upper).isNotNull()).select(x, lower, upper)
