"""A folder for tables that an application writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under `spark.checkpoint.dir`, which driver and executors share; gone when the application ends. Only a local master may do without that setting."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder")
        _folders[app] = f"{(root or 'file://' + tempfile.mkdtemp(prefix='tideline-')).rstrip('/')}/tideline-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex[:12]}"


def held(df: DataFrame, name: str, **options: object) -> DataFrame:
    """`df`, written and read again."""
    path = scratch(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
