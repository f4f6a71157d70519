"""Validation of answers' citations as records and as the gates over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation as E


def validation_records(outcomes: DataFrame, sentences: DataFrame, citations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """answer, validated, factual, supported, sentences, verdicts, degraded_reason: one record of each outcome (answer, validated, degraded_reason).

    `sentences` has answer, n, paragraph, factual; `citations` answer, sentence; `verdicts` answer, pair, sentence, document, supported. A sentence is attached where a citation names it. `supported` counts factual
    sentences with a supporting verdict. An outcome that was not validated keeps its sentences, supports none and shows no verdict; one that was shows no reason.
    """
    attached = citations.select("answer", F.col("sentence").alias("n")).distinct().withColumn("attached", F.lit(True))
    held_up = verdicts.filter("supported").select("answer", F.col("sentence").alias("n")).distinct().withColumn("held_up", F.lit(True))
    known = sentences.join(attached, ["answer", "n"], "left").join(held_up, ["answer", "n"], "left").fillna(False, ["attached", "held_up"])
    said = known.groupBy("answer").agg(
        F.count_if("factual").alias("factual"), F.count_if(F.col("factual") & F.col("held_up")).alias("supported"), F.array_sort(F.collect_list(F.struct("n", "paragraph", "factual", "attached"))).alias("sentences")
    )
    judged = verdicts.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("pair", "sentence", "document", "supported"))).alias("verdicts"))
    both = outcomes.join(said, "answer", "left").join(judged, "answer", "left")
    none = lambda c: F.array().cast(both.schema[c].dataType)
    ok = F.coalesce("validated", F.lit(False))
    return both.select(
        "answer", ok.alias("validated"), F.coalesce("factual", F.lit(0)).alias("factual"), F.when(ok, F.coalesce("supported", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("supported"), F.coalesce("sentences", none("sentences")).alias("sentences"),
        F.when(ok, F.coalesce("verdicts", none("verdicts"))).alias("verdicts"), F.when(~ok, F.col("degraded_reason")).alias("degraded_reason"),
    )


def entailed(records: DataFrame) -> DataFrame:
    """answer, n: sentences with a supporting verdict, of validated records."""
    return records.filter("validated").select("answer", F.explode("verdicts").alias("v")).filter("v.supported").select("answer", F.col("v.sentence").alias("n")).distinct()


def invariants(records: DataFrame, spans: DataFrame, declined: DataFrame) -> DataFrame:
    """answer, what: each breach of what must always hold: a citation span (answer, start, end) has a width, and an answer that is no refusal has an entailed citation.

    Spans without offsets are let be; `declined` has the answers that generation refused. A degraded record has no verdict, so it is a breach.
    """
    flat = spans.filter("start is not null and start = end").select("answer", F.lit("span of no width").alias("what"))
    bare = records.select("answer").join(declined.select("answer"), "answer", "left_anti").join(entailed(records).select("answer").distinct(), "answer", "left_anti")
    return flat.unionByName(bare.select("answer", F.lit("no entailed citation").alias("what")))


NAMES = ("citation_entailment_precision", "uncited_factual_rate", "verified_claim_group_coverage", "citation_invariants")


def gate_family(records: DataFrame, spans: DataFrame, declined: DataFrame) -> DataFrame:
    """name, status, numerator, denominator, threshold of the four citation gates; all are blocked where no record exists, for what was not measured has not passed.

    Precision is over verdicts, the uncited rate over factual sentences, coverage over runs of factual sentences of a paragraph (verified where one of them is entailed), and the invariants allow no breach. Answers
    that generation refused count in none of the first three.
    """
    answered = records.join(declined.select("answer"), "answer", "left_anti")
    sentences = answered.select("answer", "validated", F.explode("sentences").alias("s")).select("answer", "s.*")
    verdicts = answered.filter("validated").select("answer", F.explode("verdicts").alias("v")).select("answer", "v.*")
    groups = E.claim_groups(sentences, "answer", "n")
    held_up = entailed(answered)
    found = groups.join(held_up, (groups["answer"] == held_up["answer"]) & held_up["n"].between(groups["first"], groups["last"]), "left_semi").select(groups["answer"], "group").withColumn("verified", F.lit(True))
    marked = groups.join(found, ["answer", "group"], "left").fillna(False, ["verified"])
    breaches = invariants(records, spans, declined).agg(F.count(F.lit(1)).alias("numerator"))
    answers = records.agg(F.count(F.lit(1)).alias("denominator"))
    whole = breaches.join(F.broadcast(answers), F.lit(True)).select(F.lit(NAMES[3]).alias("name"), F.when(F.col("numerator") == 0, "passed").otherwise("failed").alias("status"), "numerator", "denominator", F.lit(0.0).alias("threshold"))
    gates = [
        E.entailment_gate(verdicts, F.lit(True), F.col("supported")), E.uncited_gate(sentences, F.col("factual"), F.col("attached")), E.group_coverage_gate(marked, F.col("verified")).withColumn("name", F.lit(NAMES[2])), whole,
    ]
    all_ = reduce(DataFrame.unionByName, gates)
    some = F.broadcast(records.agg((F.count(F.lit(1)) > 0).alias("measured")))
    return all_.join(some, F.lit(True)).select("name", F.when(F.col("measured"), F.col("status")).otherwise("blocked").alias("status"), "numerator", "denominator", "threshold")


def chips(entries: DataFrame, badges: DataFrame) -> DataFrame:
    """answer, place, sentence, document, number, badged for each citation of a cached answer (answer, place, sentence, document): its number is its sentence's, from 1, and it is badged where an event says so of that sentence and document."""
    marks = badges.filter("event = 'badge'").select("answer", "sentence", "document").distinct().withColumn("b", F.lit(True))
    return entries.join(marks, ["answer", "sentence", "document"], "left").select("answer", "place", "sentence", "document", (F.col("sentence") + 1).alias("number"), F.coalesce("b", F.lit(False)).alias("badged"))
