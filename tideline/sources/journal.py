"""Append-only logs and small artefacts: JSON lines, ledgers, manifests, verified downloads."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .appends import append, read

LEDGER = T.StructType().add("ts", "timestamp").add("mode", "string").add("model", "string").add("activity", "string").add("tokens_in", "long").add("tokens_out", "long").add("cost_usd", T.DecimalType(18, 6))
EXCHANGE_KEYS = (
    "exchange_id", "timestamp", "route", "question", "answer_text", "retrieved_chunk_ids", "citations", "validation", "usage", "exclude_from_harvest", "cached_from", "feedback",
)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of exactly this schema; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    unknown = set(df.columns) ^ set(LEDGER.names)
    if unknown:
        raise ValueError(f"a ledger row has other columns: {sorted(unknown)}")
    df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER)).write.mode("append").parquet(path)


def verified_files(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """name, pinned, actual, ok for each pinned file (name, sha256); a file that is not there is not ok."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    return pins.select("name", F.col("sha256").alias("pinned")).join(files, "name", "left").withColumn("ok", F.coalesce(F.col("pinned") == F.col("actual"), F.lit(False)))


def forbidden_paths(schema: T.DataType, forbidden: set[str], at: str = "") -> list[str]:
    """Every place in a nested schema whose name is forbidden."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in ([f"{at}{f.name}"] if f.name.lower() in forbidden else []) + forbidden_paths(f.dataType, forbidden, f"{at}{f.name}.")]
    if isinstance(schema, T.ArrayType):
        return forbidden_paths(schema.elementType, forbidden, f"{at}[].")
    if isinstance(schema, T.MapType):
        return forbidden_paths(schema.valueType, forbidden, f"{at}{{}}.")
    return []


def harvest(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """Exchanges that may be reused, as their known columns; a forbidden name anywhere is an error."""
    bad = forbidden_paths(df.schema, forbidden)
    if bad:
        raise ValueError(f"forbidden names: {bad}")
    return df.filter(~F.coalesce("exclude_from_harvest", F.lit(True))).select(*(c for c in EXCHANGE_KEYS if c in df.columns))


def run_record(rows: DataFrame, order: list[str], most: int = 10_000) -> str:
    """A small result as sorted, indented JSON, the same on every run; more than `most` rows are no record but a table, and an error."""
    found = rows.orderBy(*order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write them as a table")
    return json.dumps([r.asDict(recursive=True) for r in found], sort_keys=True, indent=2, default=str) + "\n"


def write_atomically(path: str, data: bytes) -> None:
    """A small file on the driver's disk, whole or not at all."""
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON-line logs, and the broken last lines of files (file, line): writes cut off. A broken line before a file's last is an error when rows are read.

    Files are split like any text: a line's place in its file is the start of its block and its order in the task, so the last line of a file is a
    maximum that each task takes of its own blocks. Lines of white space count as none.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("at"), F.col("value").alias("line")).filter(F.col("line").rlike(r"\S"))
    parsed = F.from_json("line", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    marked = lines.withColumn("r", parsed).withColumn("broken", F.col("r._broken").isNotNull())
    bad = F.col("broken")
    tails = marked.groupBy("file").agg(F.max("at").alias("last"), F.max(F.when(bad, F.struct("at", "line"))).alias("cut"), F.count_if(bad).alias("broken")).filter("broken > 0")
    tails = tails.withColumn("torn", F.col("cut.at") == F.col("last"))
    stop = F.raise_error(F.concat(F.lit("a broken line before the last in "), F.col("file"))).cast("boolean")
    nothing = tails.filter(F.when(F.col("broken") > F.col("torn").cast("int"), stop).otherwise(False)).select(F.lit(None).cast(marked.schema["r"].dataType).alias("r"))
    rows = marked.filter(~bad).select("r").unionByName(nothing).select("r.*").drop("_broken")
    return rows, tails.filter("torn").select("file", "cut.line")


def append_log(records: DataFrame, path: str, batch: str, forbidden: set[str] = frozenset()) -> bool:
    """Adds records to a log as lines of JSON, once for each name of a batch. A forbidden name at any depth refuses the whole batch before anything is written."""
    if bad := forbidden_paths(records.schema, set(forbidden)):
        raise ValueError(f"forbidden names: {bad}")
    return append(records, path, batch, "json")


def read_appended_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of all committed batches; a broken line is an error, as a committed file is whole."""
    return read(spark, path, schema, form="json", mode="FAILFAST")


def read_ledger_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV ledger with # comments; other columns than those stated are an error."""
    return spark.read.schema(columns).option("header", True).option("comment", "#").option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def put_specs(specs: DataFrame, store: str) -> None:
    """Adds specifications (hash, spec) that the store does not hold; the same one again changes nothing."""
    new = specs.filter(F.col("hash").rlike("^[0-9a-f]{64}$")).dropDuplicates(["hash"])
    spark = specs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new = new.join(spark.read.parquet(store).select("hash"), "hash", "left_anti")
    new.write.mode("append").parquet(store)


def get_one(df: DataFrame, key: str, value: str) -> dict:
    """The row of a key; none is an error. The filter reaches the scan."""
    row = df.filter(F.col(key) == value).first()
    if row is None:
        raise KeyError(value)
    return row.asDict(recursive=True)


def remaining(planned: DataFrame, journal: DataFrame, key: str = "item") -> DataFrame:
    """Planned items that the journal does not have yet."""
    return planned.join(journal.select(key), key, "left_anti")


def event_frames(text: Column) -> Column:
    """The frames of a server-sent stream: an array of event and data."""
    frames = F.filter(F.split(text, "\n\n"), lambda f: F.trim(f) != "")
    return F.transform(frames, lambda f: F.struct(F.regexp_extract(f, r"(?m)^event: ?(.*)$", 1).alias("event"), F.array_join(F.regexp_extract_all(f, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n").alias("data")))


def event_text(event: Column, data: Column) -> Column:
    """A frame of a server-sent stream: the event's name on one line (its line ends become spaces), each line of the data behind its own mark, and the blank line that ends it."""
    name = F.regexp_replace(event, r"\r\n|\r|\n", " ")
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(data, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.concat(F.lit("data: "), x))
    return F.concat(F.when(name.isNotNull() & (name != ""), F.concat(F.lit("event: "), name, F.lit("\n"))).otherwise(""), F.array_join(lines, "\n"), F.lit("\n\n"))


def gate_report(gates: DataFrame) -> str:
    """A gate table (a few rows) as Markdown, in the order of names."""
    lines = ["| gate | status | result | threshold |", "|---|---|---|---|"]
    for r in gates.orderBy("name").collect():
        lines.append(f"| {r['name']} | {r['status']} | {r['numerator']}/{r['denominator']} | {'' if r['threshold'] is None else f'{r["threshold"]:g}'} |")
    return "\n".join(lines) + "\n"
