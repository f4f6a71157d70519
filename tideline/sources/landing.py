"""Pinned files: hashed in pieces on the executors, and landed all or none.

A pin names a source address, a target address and the SHA-256 that the file must have. Each task streams its files piece by piece, so a file may be of
any size. `land` writes each copy beside its target, looks at all results, and only then moves the copies into place; one wrong or missing file, and
none is. A task that runs again writes a copy under a name of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes read at once.
PIECE = 8 << 20


class Mismatch(ValueError):
    """A file is missing or has another hash than its pin; nothing was landed."""


def opened(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address (file, hdfs, s3, gs) or plain path, and the path in it."""
    if address.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(address) if "://" in address else (pafs.LocalFileSystem(), address)


def _stream(source: str, target: str | None) -> tuple[str | None, int]:
    """The hash and size of a file, copied to `target` on the way; a null hash where it can't be read."""
    files, path = opened(source)
    digest, size = hashlib.sha256(), 0
    try:
        with files.open_input_stream(path) as stream:
            out = None
            if target is not None:
                there, place = opened(target)
                there.create_dir(place.rpartition("/")[0], recursive=True)
                out = there.open_output_stream(place)
            try:
                while piece := stream.read(PIECE):
                    digest.update(piece)
                    size += len(piece)
                    if out is not None:
                        out.write(piece)
            finally:
                if out is not None:
                    out.close()
    except FileNotFoundError:
        return None, 0
    return digest.hexdigest(), size


_SCHEMA = "name string, source string, target string, sha256 string, actual string, bytes long, copy string"


def _checked(pins: DataFrame, landing: bool, files_per_task: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                copy = f"{row['target'].rpartition('/')[0]}/.{row['target'].rpartition('/')[2]}.{uuid.uuid4().hex}" if landing else None
                actual, size = _stream(row["source"], copy)
                yield pa.RecordBatch.from_pylist([row | {"actual": actual, "bytes": size, "copy": copy if actual else None}], schema=_ARROW)

    rows = pins.select("name", "source", F.col("target") if "target" in pins.columns else F.lit(None).cast("string").alias("target"), F.lower("sha256").alias("sha256"))
    tasks = max(-(-rows.count() // files_per_task), 1)
    return rows.repartition(tasks, "name").mapInArrow(run, _SCHEMA)


_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _SCHEMA.split(", ")])


def verified(pins: DataFrame, files_per_task: int = 1) -> DataFrame:
    """name, sha256, actual, bytes, ok for each pin (name, source, sha256); a file that is not there has no hash and is not ok."""
    return _checked(pins, False, files_per_task).select("name", "sha256", "actual", "bytes", F.coalesce(F.col("actual") == F.col("sha256"), F.lit(False)).alias("ok"))


def land(pins: DataFrame, journal: str, files_per_task: int = 1) -> DataFrame:
    """Lands all files of `pins` (name, source, target, sha256), or raises with what is wrong and leaves nothing; returns the table of what was landed.

    `journal` is where that table is written before anything is moved, so a run that dies while it moves is finished by moving what the table names.
    """
    spark = pins.sparkSession
    _checked(pins, True, files_per_task).write.parquet(journal)
    staged = spark.read.schema(_SCHEMA).parquet(journal)
    wrong = staged.filter("actual is null or actual != sha256")
    if bad := wrong.select("name", "sha256", "actual").orderBy("name").limit(100).collect():
        _each(staged.filter("copy is not null"), _drop)
        raise Mismatch("; ".join(f"{r["name"]}: {r["actual"] or "missing"}, pinned {r["sha256"]}" for r in bad))
    finish(staged)
    return staged.select("name", "target", "sha256", "bytes")


def finish(staged: DataFrame) -> None:
    """Moves copies to their targets; what is already moved stays."""
    _each(staged, _move)


def _each(staged: DataFrame, act) -> None:
    def run(rows) -> None:
        for row in rows:
            act(row)

    staged.select("copy", "target").foreachPartition(run)


def _drop(row) -> None:
    files, path = opened(row["copy"])
    if files.get_file_info(path).type != pafs.FileType.NotFound:
        files.delete_file(path)


def _move(row) -> None:
    files, path = opened(row["copy"])
    if files.get_file_info(path).type != pafs.FileType.NotFound:
        files.move(path, opened(row["target"])[1])
