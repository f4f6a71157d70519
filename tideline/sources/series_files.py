"""Readers of published climate series files, with exact headers, as (columns named, typed) frames.

Each reader takes a path that Spark can open. Headers are checked on the first line that is no comment; then one scan with
a fixed schema reads the file, pruned to the columns that are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A file is not of the shape that its reader states."""


def data_lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(n, line): lines in order without the leading run of # lines, blank ones and `skip` titles; BOM and CR are gone."""
    whole = spark.read.text(path, wholetext=True)
    clean = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    body = F.regexp_replace(clean, r"\A(?:[ \t]*\n|#[^\n]*(?:\n|\z))+", "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    return whole.select(F.posexplode(lines).alias("n", "line")).filter(F.col("n") >= skip).withColumn("n", F.col("n") - skip)


def read_delimited(spark: SparkSession, path: str, expected: Sequence[str], sep: str = ",", skip: int = 0, exact: bool = True) -> DataFrame:
    """All columns of the file as strings, in file order (`n`). The header must equal `expected`, or hold it where not `exact`."""
    lines = data_lines(spark, path, skip)
    first = lines.filter("n = 0").first()
    if first is None:
        raise SourceError(f"{path} holds no data")
    header = [h.strip() for h in first["line"].split(sep)]
    if (exact and header != list(expected)) or not set(expected) <= set(header):
        raise SourceError(f"{path} has the columns {header}, not {list(expected)}")
    parts = F.from_csv("line", ", ".join(f"`{h}` string" for h in header), {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return lines.filter("n > 0").select("n", parts.alias("r")).select("n", *(F.col(f"r.`{h}`").alias(h) for h in header))


def number(column: str, missing: Sequence[str] = ()) -> Column:
    """A double; a missing sign or blank is null, anything else that is no number an error."""
    text = F.nullif(F.trim(F.col(f"`{column}`")), F.lit(""))
    for sign in missing:
        text = F.nullif(text, F.lit(sign))
    return text.cast("double")


def year(column: str) -> Column:
    return F.nullif(F.trim(F.col(f"`{column}`")), F.lit("")).cast("bigint")


def gistemp(spark: SparkSession, path: str) -> DataFrame:
    header = "Year Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec J-D D-N DJF MAM JJA SON".split()
    rows = read_delimited(spark, path, header, skip=1)
    return rows.select(year("Year").alias("year_ce"), number("J-D", ["***"]).alias("temp_anomaly_c")).dropna().orderBy("year_ce")


def hadcrut5(spark: SparkSession, path: str) -> DataFrame:
    names = ["Time", "Anomaly (deg C)", "Lower confidence limit (2.5%)", "Upper confidence limit (97.5%)"]
    rows = read_delimited(spark, path, names)
    return rows.select(year(names[0]).alias("year_ce"), *(number(n).alias(a) for n, a in zip(names[1:], ("temp_anomaly_c", "lower", "upper"), strict=True))).orderBy("year_ce")


def gml_co2(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, ["year", "mean", "unc"]).select(year("year").alias("year_ce"), number("mean").alias("co2_ppm")).orderBy("year_ce")


def bereiter(spark: SparkSession, path: str) -> DataFrame:
    names = ["age_gas_calBP", "co2_ppm", "co2_1s_ppm"]
    return read_delimited(spark, path, names, sep="\t").select(number(names[0]).alias("age_bp"), number("co2_ppm").alias("co2_ppm")).orderBy("age_bp")


def kaufman(spark: SparkSession, path: str) -> DataFrame:
    names = {"global_median": "temp_anomaly_c", "global_5": "lower", "global_95": "upper"}
    rows = read_delimited(spark, path, ["ages", *names], exact=False)
    return rows.select(number("ages").alias("age_bp"), *(number(n).alias(a) for n, a in names.items())).orderBy("age_bp")


def owid(spark: SparkSession, path: str) -> DataFrame:
    rows = read_delimited(spark, path, ["country", "year", "iso_code", "co2"], exact=False)
    kept = rows.select(F.col("country").alias("entity"), year("year").alias("year_ce"), F.col("iso_code"), number("co2").alias("co2_mt"))
    return kept.filter("co2_mt is not null").orderBy("entity", "year_ce")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (gistemp, hadcrut5, gml_co2, bereiter, kaufman, owid)}


def reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in READERS:
        raise SourceError(f"no reader {name!r}")
    return READERS[name]


def drop_partial_year(df: DataFrame, retrieved: str, x: str = "year_ce") -> DataFrame:
    """Years before the one of the retrieval date."""
    kept = df.filter(F.col(x) < int(retrieved[:4]))
    if kept.isEmpty():
        raise SourceError("no full year is left")
    return kept


def check_coverage(df: DataFrame, start: int, end: int, x: str) -> None:
    low, high = df.agg(F.bround(F.min(x)), F.bround(F.max(x))).first()
    if (low, high) != (start, end):
        raise SourceError(f"the data span {low} to {high}, not {start} to {end}")


def load_pack(spark: SparkSession, entries: dict[str, dict], folder: str) -> DataFrame:
    """All series of a pack in long form: dataset, entity, x (calendar years), value, lower, upper."""
    out = None
    for name, entry in sorted(entries.items()):
        df = reader(entry["reader"])(spark, f"{folder}/{entry['file']}")
        if "age_bp" in df.columns:
            df = df.withColumn("year_ce", 1950.0 - F.col("age_bp"))
        if entry.get("partial_years") == "drop":
            df = drop_partial_year(df, entry["retrieved_at"])
        pick = lambda c, kind="double", df=df: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
        one = df.select(F.lit(name).alias("dataset"), pick("entity", "string").alias("entity"), F.col("year_ce").cast("double").alias("x"), F.col(entry["value"]).alias("value"), pick("lower").alias("lower"), pick("upper").alias("upper"))
        out = one if out is None else out.unionByName(one)
    return out
