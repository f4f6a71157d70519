"""Gates between stages: what retrieval may serve, what sources may be shown, and records that must be whole before anything relies on them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.appends import Store
from .answers import exempt_by_marker, provenance_envelope
from .scoring import ranked


class GateError(ValueError):
    """A record that is not whole."""


# ---- retrieval -----------------------------------------------------------------------------------------------------


def checked_candidates(candidates: DataFrame, permitted: Sequence[str]) -> DataFrame:
    """Candidates (query, item, source_type, score) as they are; a row whose type is not permitted, or whose score is null, NaN or infinite, is an error when it is read.

    Nothing is trimmed: a store that hands back what it was not asked for is broken, and a score that compares false with any threshold opens the gate.
    """
    score = F.col("score").cast("double")
    wrong = (
        F.when(~F.coalesce(F.col("source_type").isin(*permitted), F.lit(False)), F.concat(F.lit("type "), F.coalesce("source_type", F.lit("null"))))
        .when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "no finite score")
    )
    stop = F.raise_error(F.concat(F.lit("candidate "), F.col("item").cast("string"), F.lit(": "), wrong)).cast("boolean")
    return candidates.filter(F.when(wrong.isNull(), F.lit(True)).otherwise(stop))


def served(queries: DataFrame, candidates: DataFrame, cut: int, threshold: float | None = None) -> DataFrame:
    """query, outcome, top_score, partial_support, passages: what each query is answered from, or refused.

    The `cut` best by score stay. A query without candidates is refused whatever the threshold, one whose best is below it too (then no passages are
    served); without a threshold every other query is answered. Support is partial where the best clears the threshold and another passage that is served does not.
    """
    clears = F.lit(True) if threshold is None else F.col("score") >= threshold
    top = ranked(candidates, cut).withColumn("clears", clears)
    listed = top.groupBy("query").agg(F.max("score").alias("top_score"), F.bool_and("clears").alias("all"), F.array_sort(F.collect_list(F.struct("rank", "item", "score", "clears"))).alias("found"))
    all_ = queries.select("query").distinct().join(listed, "query", "left")
    answered = F.col("top_score").isNotNull() & (F.lit(True) if threshold is None else F.col("top_score") >= threshold)
    passages = F.when(answered, F.col("found")).otherwise(F.array().cast(listed.schema["found"].dataType))
    return all_.select("query", F.when(answered, "passages").otherwise("refusal").alias("outcome"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), (answered & ~F.col("all")).alias("partial_support"), passages.alias("passages"))


# The label of a source by what its licence permits.
TIERS = {"open": "A", "non-commercial-educational": "B", "permission-on-file": "C"}


def sources_event(passages: DataFrame) -> DataFrame:
    """answer and its `sources`, one entry for each passage in the order of `place`.

    `passages` has answer, place, doc_id, chunk_id, title, attribution, url, source_type, context (what its licence permits) and body. An entry holds a part of the body of the length that its context
    allows, or none where the context is unknown, null or spelt otherwise; no other field holds text of the source.
    """
    tier = F.lit(None).cast("string")
    for context, label in TIERS.items():
        tier = F.when(F.col("context") == context, label).otherwise(tier)
    body = F.coalesce("body", F.lit(""))
    excerpt = T.bounded_excerpt(body, F.col("context"))
    title = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("title", "attribution")), F.col("doc_id").cast("string"))
    entry = F.struct(
        "doc_id", "chunk_id", title.alias("title"), "attribution", "url", "source_type", tier.alias("tier"), "context", excerpt.alias("excerpt"), F.coalesce(F.length(excerpt) < F.length(body), F.lit(False)).alias("truncated"),
    )
    rows = passages.withColumn("__e", entry).groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("place", F.col("__e").alias("e")))).alias("s"))
    return rows.select("answer", F.transform("s", lambda x: x["e"]).alias("sources"))


def document_blocks(passages: DataFrame, most: int) -> DataFrame:
    """answer and its `documents`: title, text (the body alone, which may be cited) and context (what may be read and not cited). More than `most` passages of an answer are an error when it is read."""
    names = {"chunk_id": "chunk_id", "section": "header", "source_type": "source_type", "consensus_position": "consensus", "parse_backend": "backend", "degraded_fallback": "degraded", "needs_hand_review": "review"}
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("false" if c in ("degraded", "review") else ""))) for label, c in names.items()]
    block = F.struct("place", F.col("attribution").alias("title"), F.col("body").alias("text"), F.concat_ws("\n", *lines).alias("context"))
    rows = passages.groupBy("answer").agg(F.array_sort(F.collect_list(block)).alias("b"))
    stop = F.raise_error(F.concat(F.lit("passages of answer "), F.col("answer").cast("string"), F.lit(f" beyond {most}"))).cast(rows.schema["b"].dataType)
    return rows.select("answer", F.transform(F.when(F.size("b") <= most, F.col("b")).otherwise(stop), lambda x: x.dropFields("place")).alias("documents"))


# ---- addresses -----------------------------------------------------------------------------------------------------


def quoted_doi(doi: Column) -> Column:
    """A DOI for the path of an address, percent-encoded but for its slashes; null for what is no DOI."""
    out = F.url_encode(doi)
    for code, sign in (("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.when(T.is_doi(doi), F.replace(out, F.lit("*"), F.lit("%2A")))


def https_only(url: Column) -> Column:
    """The address where its scheme is https, whatever its case; else null."""
    return F.when(F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)) == "https", url)


# ---- records that must be whole ------------------------------------------------------------------------------------

# Answers that say nothing, and the least lengths of a name and a note.
RUBBER_STAMPS = ("y", "n", "yes", "no", "ok", "okay", ".")
WHO_LENGTH, NOTE_LENGTH = 2, 15


def plausible_signoff(who: Column, note: Column) -> Column:
    """Whether a sign-off names someone and says what was checked: not too short, no mere yes, and the note no repetition of the name."""
    name, said = F.trim(F.coalesce(who, F.lit(""))), F.trim(F.coalesce(note, F.lit("")))
    real = lambda t, least: (F.length(t) >= least) & ~F.lower(t).isin(*RUBBER_STAMPS)
    return real(name, WHO_LENGTH) & real(said, NOTE_LENGTH) & (name != said)


def audit_status(packet: Column, field: str = "owner_severity_audit") -> Column:
    """pending or complete, as the first line of that field says; a packet without one, or with another word, is an error when it is read."""
    word = F.regexp_extract(F.coalesce(packet, F.lit("")), rf"(?m)^{field}:\s*(\S+)", 1)
    return F.when(word.isin("pending", "complete"), word).otherwise(F.raise_error(F.concat(F.lit(f"{field} is "), word)).cast("string"))


def gold_violations(items: DataFrame, least_gate: int = 20) -> DataFrame:
    """id and violation for what is wrong with a gold set (id, category, subset, expected_route, recall_semantics, spec, refusal); no row where all is well.

    No-answer items have a known subset and route, items of several passages say how recall counts, chart items have either a specification or a refusal. The gate needs `least_gate` items that the index
    must refuse, and shares none with the calibration: that is said with a null id, or the id that is in both.
    """
    known = lambda c, *words: F.coalesce(F.col(c).isin(*words), F.lit(False))
    none, several, chart = (F.col("category") == c for c in ("no_answer", "multi_passage", "chart"))
    checks = F.array_compact(F.array(
        F.when(none & ~known("subset", "calibration", "gate"), "unknown subset"), F.when(none & ~known("expected_route", "retrieval_refusal", "canned_out_of_scope"), "unknown route"),
        F.when(several & ~known("recall_semantics", "all_gold", "any_gold"), "no recall semantics"), F.when(chart & (F.col("spec").isNotNull() == F.col("refusal").isNotNull()), "needs a specification or a refusal"),
    ))
    each = items.select("id", F.explode(checks).alias("violation"))
    refused = items.filter(none & (F.col("expected_route") == "retrieval_refusal"))
    few = refused.filter("subset = 'gate'").agg(F.countDistinct("id").alias("n")).filter(F.col("n") < least_gate)
    few = few.select(F.lit(None).cast(items.schema["id"].dataType).alias("id"), F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" items in the gate")).alias("violation"))
    both = refused.groupBy("id").agg(F.countDistinct("subset").alias("n")).filter("n > 1").select("id", F.lit("in gate and calibration").alias("violation"))
    return each.unionByName(few).unionByName(both)


def ranged(spec: Column) -> Column:
    """Whether a chart specification (JSON text) has a range of time of its own or in a panel; false for other text."""
    has = lambda text: F.coalesce(F.array_contains(F.json_object_keys(text), "time_range_ce"), F.lit(False))
    panels = F.from_json(F.get_json_object(spec, "$.panels"), "map<string,string>")
    return has(spec) | F.coalesce(F.exists(F.map_values(panels), has), F.lit(False))


def no_such_data(nearest: Column) -> Column:
    """The refusal of a chart, in words of our own: it names the nearest data sets (an array of labels) and nothing that was asked."""
    return F.concat(F.lit("There is no data here for that chart. The nearest data sets are: "), F.array_join(nearest, "; "), F.lit("."))


# Endings of files that hold data.
DATA_ENDINGS = ("csv", "tsv", "txt", "nc", "parquet", "json", "jsonl", "xlsx", "xls", "dat", "gz", "zip", "feather", "arrow")
BINARY_ENDINGS = ("nc", "parquet", "xlsx", "xls", "gz", "zip", "feather", "arrow")


def stray_data(files: DataFrame, markers: Sequence[str]) -> DataFrame:
    """The `path` of each file (path, content) with a data ending anywhere in its name that nothing exempts: a marker in its first line or, for JSON, an envelope that says where it is from. Binary and packed files have no exemption."""
    endings = F.slice(F.split(F.lower(F.element_at(F.split("path", "/"), -1)), r"\."), F.lit(2), F.lit(100))
    of = lambda some: F.arrays_overlap(endings, F.array(*map(F.lit, some)))
    content = F.col("content").cast("string")
    exempt = ~of(BINARY_ENDINGS) & (exempt_by_marker(content, tuple(markers)) | ((F.element_at(endings, -1) == "json") & provenance_envelope(content)))
    return files.filter(of(DATA_ENDINGS) & F.coalesce(~exempt, F.lit(True))).select("path")


# ---- small artefacts -----------------------------------------------------------------------------------------------


def write_calibration(spark: SparkSession, path: str, threshold: float, item_ids: Sequence[str], version: int = 1) -> None:
    folder, _, name = path.rpartition("/")
    record = {"schema_version": version, "threshold": threshold, "calibration_item_ids": list(item_ids)}
    Store(spark, folder).put(name, (json.dumps(record, indent=2, sort_keys=True, allow_nan=False) + "\n").encode(), replace=True)


def read_calibration(spark: SparkSession, path: str, version: int = 1) -> tuple[float, list[str]]:
    """threshold and item ids of a calibration file; another version, a threshold outside (0, 1), any other shape and no file are errors, and there is no default."""
    folder, _, name = path.rpartition("/")
    store = Store(spark, folder)
    if not store.exists(name):
        raise GateError(f"{path} is missing")
    try:
        found = json.loads(store.read(name))
    except ValueError as e:
        raise GateError(f"{path} is no JSON: {e}") from e
    threshold, ids = (found.get("threshold"), found.get("calibration_item_ids")) if isinstance(found, dict) else (None, None)
    if not isinstance(found, dict) or found.get("schema_version") != version:
        raise GateError(f"{path} is no calibration of version {version}")
    if isinstance(threshold, bool) or not isinstance(threshold, int | float) or not 0 < threshold < 1:  # NaN and infinities fail this too
        raise GateError(f"{path} has the threshold {threshold!r}")
    if not isinstance(ids, list) or not all(isinstance(i, str) for i in ids):
        raise GateError(f"{path} lists no item ids")
    return threshold, ids


def index_version(meta: DataFrame) -> str:
    """The corpus version that an index recorded (one row with `corpus_version`); none, or several, is an error."""
    found = [r[0] for r in meta.select("corpus_version").distinct().limit(2).collect()]
    if len(found) != 1 or not found[0]:
        raise GateError(f"the index records the versions {found}")
    return found[0]


def gold_snapshot(chunks: DataFrame, path: str) -> None:
    """The distinct chunk ids in order, one to a line, in one file of the folder `path`: the same bytes for the same chunks."""
    w = chunks.select(F.col("chunk_id").alias("value")).filter("value is not null").distinct()
    w.repartition(1).sortWithinPartitions("value").write.mode("overwrite").text(path)
