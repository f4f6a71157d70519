"""Appends that a retry doesn't repeat and a crash doesn't tear.

A table is a folder: each attempt at a batch writes a folder of its own below `data`, and a small file in `commits`, named after the batch,
then says which attempt counts. The file is written under another name and renamed, through the Hadoop file system of the path; rows that no
file in `commits` names are never read. So a batch that is tried again adds nothing, writers of different batches share no file, and of
two writers of one batch one counts. `compact` puts many batches into one; `vacuum` deletes what no reader can see.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,200}")


class Store:
    """The files below one path, by whatever file system it names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """Files and folders in `folder`, with the milliseconds of their last change."""
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._at(folder)))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def put(self, name: str, data: bytes, replace: bool = False) -> bool:
        """Writes a small file, whole or not at all; False where it is there and may not be replaced."""
        if not replace and self.exists(name):
            return False
        folder, _, last = name.rpartition("/")
        part = f"{folder}/.{last}.{uuid.uuid4().hex}" if folder else f".{last}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(part), True)
        try:
            stream.write(bytearray(data))
            stream.hflush()
        finally:
            stream.close()
        if replace and self.exists(name):
            self.delete(name)
        if not replace and self.exists(name) or not self._fs.rename(self._at(part), self._at(name)):
            self.delete(part)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def commits(store: Store) -> dict[str, dict]:
    """What is known of each committed batch: attempt, rows, metrics, and the batches that it replaces."""
    return {name: json.loads(store.read(f"commits/{name}")) for name, _ in store.names("commits") if not name.startswith(".")}


def _live(known: dict[str, dict]) -> dict[str, dict]:
    gone = {b for c in known.values() for b in c["replaces"]}
    return {b: c for b, c in known.items() if b not in gone}


def append(df: DataFrame, path: str, batch: str, form: str = "parquet", metrics: dict[str, Column | int] | None = None, replaces: list[str] | None = None) -> bool:
    """Adds the rows of `df` as `batch`, with its row count and `metrics` (numbers, or aggregates over it) in the commit. False, and nothing added, if the batch is there."""
    if not NAME.fullmatch(batch):
        raise ValueError(f"no name of a batch: {batch!r}")
    store = Store(df.sparkSession, path)
    if store.exists(f"commits/{batch}"):
        return False
    attempt, seen, metrics = f"{batch}-{uuid.uuid4().hex}", Observation(), metrics or {}
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in metrics.items() if isinstance(m, Column)))
    counted.write.format(form).save(f"{store.path}/data/attempt={attempt}")
    found = dict(seen.get)
    commit = {"attempt": attempt, "rows": found.pop("rows"), "metrics": {k: found.get(k, m) for k, m in metrics.items()}, "replaces": replaces or []}
    store.put(f"commits/{batch}", json.dumps(commit, sort_keys=True, default=str).encode())
    if json.loads(store.read(f"commits/{batch}"))["attempt"] == attempt:
        return True
    store.delete(f"data/attempt={attempt}")
    return False


def read(spark: SparkSession, path: str, schema: str, batches: list[str] | None = None, form: str = "parquet", **options: str) -> DataFrame:
    """The committed rows, or those of some batches; none where nothing is committed."""
    store = Store(spark, path)
    live = _live(commits(store))
    if batches is not None and (unknown := [b for b in batches if b not in live]):
        raise KeyError(f"not committed: {unknown}")
    folders = [f"{store.path}/data/attempt={c['attempt']}" for b, c in sorted(live.items()) if batches is None or b in batches]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.format(form).schema(schema).options(**options).load(folders)


def totals(spark: SparkSession, path: str) -> dict[str, int]:
    """rows and metrics summed over the commits, without reading a row."""
    out: dict[str, int] = {}
    for c in _live(commits(Store(spark, path))).values():
        for k, v in {"rows": c["rows"], **c["metrics"]}.items():
            out[k] = out.get(k, 0) + (v or 0)
    return out


def compact(spark: SparkSession, path: str, schema: str, batch: str, files: int = 1, form: str = "parquet") -> bool:
    """All live batches as one, of so many files; their names stay taken."""
    store = Store(spark, path)
    live = _live(commits(store))
    if len(live) < 2:
        return False
    names = {k for c in live.values() for k in c["metrics"]}
    metrics = {k: sum(c["metrics"].get(k) or 0 for c in live.values()) for k in sorted(names)}
    return append(read(spark, path, schema, list(live), form).repartition(files), path, batch, form, metrics, sorted(live))


def vacuum(spark: SparkSession, path: str, older_s: float = 86_400) -> list[str]:
    """Deletes attempts that don't count and have not changed for so long (an attempt still at work is younger); returns their names."""
    store = Store(spark, path)
    live = {c["attempt"] for c in _live(commits(store)).values()}
    old = [name for name, at in store.names("data") if name.removeprefix("attempt=") not in live and at <= (time.time() - older_s) * 1000]
    for name in old:
        store.delete(f"data/{name}")
    return old
