"""Pages to blocks to passages, batch by batch, so that a run that was killed goes on where it stopped.

A batch is a group of input files, named by a hash of their names. Each stage's rows of a batch are an append (`sources.appends`):
blocks, then chunks, then the record of each document, which reads the two from what is committed. A batch whose records are
committed is not even read again; one with committed blocks is not parsed again. Documents that an earlier batch has recorded, with the same
content, are left out by an anti join.

A document that can't be ingested is a record with a reason, not an end of the run: no id, no content, no HTML, nothing in it, or another
content under its id in the same batch (the least hash counts). Rows alike in id and content are one document. A gate over all of the input may refuse the
whole run before anything is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_html
from ..operators.blocks import collected, exploded, html_blocks, mark_boilerplate
from ..operators.chunking import CHUNK_DDL, Limits, chunk_documents
from ..sources import appends

BLOCKS = "doc string, title string, pos int, type string, text string, level int, caption string, container string, reason string"
CHUNKS = CHUNK_DDL
DOCUMENTS = "page_id long, content string, doc string, status string, reason string, n_blocks long, n_dropped long, n_chunks long, n_oversized long"


class Refused(ValueError):
    """The gate found something wrong; nothing was written."""


@dataclass(frozen=True)
class Config:
    limits: Limits = Limits()
    files_per_batch: int = 64
    #: Input rows to violations (a column `violation`); any refuses the run.
    gate: Callable[[DataFrame], DataFrame] | None = None


def batches(spark: SparkSession, source: str, config: Config) -> dict[str, list[str]]:
    """Names of batches and their files; the names don't change while the files don't."""
    files = sorted(spark.read.parquet(source).inputFiles())
    groups = [files[k : k + config.files_per_batch] for k in range(0, len(files), config.files_per_batch)]
    return {"b" + hashlib.sha256("\n".join(g).encode()).hexdigest()[:24]: g for g in groups}


def _judged(pages: DataFrame) -> DataFrame:
    """page_id, html, content (hash), doc, reason: each document of a batch once; reason is null for those to be parsed."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("content", F.sha2("html", 256)).dropDuplicates(["page_id", "content"])
    # Rows without an id lie apart from each other, by content.
    first = F.min("content").over(Window.partitionBy("page_id", F.when(F.col("page_id").isNull(), F.col("content")))) == F.col("content")
    reason = (
        F.when(F.col("page_id").isNull(), "no id").when(F.trim("html") == "", "no content").when(~looks_like_html(F.col("html")), "no html").when(~first, "another content of this id")
    )
    return rows.withColumns({"doc": F.concat_ws(":", F.col("page_id").cast("string"), F.substring("content", 1, 16)), "reason": reason})


def _batch(spark: SparkSession, files: list[str], name: str, out: str, config: Config) -> None:
    earlier = appends.read(spark, f"{out}/documents", DOCUMENTS).select("page_id", "content")
    rows = _judged(spark.read.parquet(*files)).join(earlier, ["page_id", "content"], "left_anti")
    parsed = exploded(html_blocks(rows.filter("reason is null").select("doc", "html"), "doc"), "doc")
    marked = mark_boilerplate(parsed, "doc")
    appends.append(marked.select(*(c.split()[0] for c in BLOCKS.split(", "))), f"{out}/blocks", name, metrics={"dropped": F.count_if(F.col("reason").isNotNull())})
    blocks = appends.read(spark, f"{out}/blocks", BLOCKS, [name])
    kept = collected(blocks.filter("reason is null"), "doc").withColumnRenamed("doc", "doc_id")
    appends.append(chunk_documents(kept, config.limits), f"{out}/chunks", name, metrics={"oversized": F.count_if("oversized")})
    chunks = appends.read(spark, f"{out}/chunks", CHUNKS, [name])
    counted = blocks.groupBy("doc").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("reason").isNotNull()).alias("n_dropped"))
    passages = chunks.groupBy(F.col("doc_id").alias("doc")).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("oversized").alias("n_oversized"))
    known = rows.drop("html").join(counted, "doc", "left").join(passages, "doc", "left").fillna(0, ["n_blocks", "n_dropped", "n_chunks", "n_oversized"])
    reason = F.coalesce("reason", F.when(F.col("n_blocks") == 0, "nothing in it"), F.when(F.col("n_chunks") == 0, "no passage"))
    records = known.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ingested").otherwise("quarantined"))
    appends.append(
        records.select(*(c.split()[0] for c in DOCUMENTS.split(", "))), f"{out}/documents", name,
        metrics={"ingested": F.count_if(F.col("status") == "ingested"), "quarantined": F.count_if(F.col("status") == "quarantined")},
    )


def ingest(spark: SparkSession, source: str, out: str, config: Config = Config()) -> dict[str, int]:
    """Ingests the Parquet pages (page_id, html) of `source` into `out`, as far as that is not done; returns the totals of all runs."""
    if config.gate is not None:
        wrong = [r[0] for r in config.gate(spark.read.parquet(source)).select("violation").limit(100).collect()]
        if wrong:
            raise Refused("; ".join(map(str, wrong)))
    done = appends.commits(appends.Store(spark, f"{out}/documents"))
    for name, files in batches(spark, source, config).items():
        if name not in done:
            _batch(spark, files, name, out, config)
    return run_record(spark, out)


def run_record(spark: SparkSession, out: str) -> dict[str, int]:
    """What the commits say: documents and their states, blocks and dropped ones, chunks and oversized ones. No row is read."""
    found = {f"{stage}_{k}": v for stage in ("documents", "blocks", "chunks") for k, v in appends.totals(spark, f"{out}/{stage}").items()}
    return dict(sorted(found.items()))


def documents(spark: SparkSession, out: str) -> DataFrame:
    return appends.read(spark, f"{out}/documents", DOCUMENTS)


def blocks(spark: SparkSession, out: str) -> DataFrame:
    return appends.read(spark, f"{out}/blocks", BLOCKS)


def chunks(spark: SparkSession, out: str) -> DataFrame:
    return appends.read(spark, f"{out}/chunks", CHUNKS)


def run_items(items: DataFrame, out: str, plan: Callable[[DataFrame], DataFrame], schema: str, batch: str, key: str = "item") -> DataFrame:
    """Plans the items (`key`, blocked) that are neither blocked nor done, as one batch of the journal `out`, and returns what all runs have planned.

    `plan` maps such items to rows of `schema`, which has `key`. A batch's name is used once: a run that died before its commit is made anew, one that was committed is not.
    """
    spark = items.sparkSession
    done = appends.read(spark, out, schema).select(key)
    waiting = items.filter(~F.coalesce("blocked", F.lit(False))).join(done, key, "left_anti")
    appends.append(plan(waiting), out, batch)
    return appends.read(spark, out, schema)
