"""Retrieval metrics, release gates, calibration and grouping of judged answers, all as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the gates.
REFUSAL_ABOVE, FALSE_REFUSAL_BELOW = 0.90, 0.05
ENTAILMENT_FROM, UNCITED_TO, GROUP_COVERAGE_FROM, SEVERITY_FROM = 0.95, 0.35, 0.75, 0.90


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """query, n_gold, recall_any, recall_all, mrr, ndcg for each query with gold.

    `ranked` has query, item, rank (from 1, whole list); `gold` has query, item. With `asked` (query, group), `gold` has item, group instead: a query's gold are the items that share a
    group with it, and they are counted, never paired with queries. nDCG is binary, its ideal has min(gold, k) hits. Reciprocal rank looks at the whole list, the others at the first `k`.
    """
    if asked is None:
        each = gold.select("query", "item").distinct()
        sizes, hits = each.groupBy("query").agg(F.count(F.lit(1)).alias("n_gold")), each.join(ranked.select("query", "item", "rank"), ["query", "item"])
    else:
        sizes, hits = _group_sizes(gold, asked), _group_hits(ranked, gold, asked)
    within = F.col("rank") <= k
    found = hits.groupBy("query").agg(F.count_if(within).alias("__in"), F.min("rank").alias("__first"), F.sum(F.when(within, 1 / F.log2(F.col("rank") + 1))).alias("__dcg"))
    inside = F.coalesce("__in", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1))
    return sizes.join(found, "query", "left").select(
        "query", "n_gold", (inside > 0).alias("recall_any"), (inside == F.col("n_gold")).alias("recall_all"), F.coalesce(1 / F.col("__first"), F.lit(0.0)).alias("mrr"), (F.coalesce("__dcg", F.lit(0.0)) / ideal).alias("ndcg")
    )


def _group_sizes(gold: DataFrame, asked: DataFrame) -> DataFrame:
    """query, n_gold. Items and queries of the same groups count together, so that nothing is as large as a group; an item that shares several groups with a query counts once."""
    groups = lambda df, key, name: df.select(key, "group").dropna().groupBy(key).agg(F.sort_array(F.collect_set("group")).alias(name))
    stored = groups(gold, "item", "theirs").groupBy("theirs").agg(F.count(F.lit(1)).alias("n"))
    own = groups(asked, "query", "own")
    pairs = own.select("own").distinct().withColumn("group", F.explode("own")).join(stored.withColumn("group", F.explode("theirs")), "group").select("own", "theirs", "n").distinct()
    return own.join(pairs.groupBy("own").agg(F.sum("n").alias("n_gold")), "own").select("query", "n_gold")


def _group_hits(ranked: DataFrame, gold: DataFrame, asked: DataFrame) -> DataFrame:
    """query, rank of the ranked items that share a group with their query."""
    rows = ranked.select("query", "item", "rank").join(asked.select("query", "group").distinct(), "query")
    return rows.join(gold.select("item", "group").distinct(), ["item", "group"]).select("query", "item", "rank").distinct()


def rerank_benchmark(candidates: DataFrame, scores: DataFrame, gold: DataFrame, cut: int, k: int, asked: DataFrame | None = None) -> DataFrame:
    """model and the means of `retrieval_metrics` when each model's scores (model, query, item, score) put the candidates (query, item, rank) in order, and the `cut` best stay.

    All models and queries are ranked in one pass. A candidate that a model has no score for comes last; ties stay in the order of `rank`.
    """
    models = F.broadcast(scores.select("model").distinct())  # one row for each model
    of = lambda df: df.withColumn("query", F.struct("model", "query"))
    each_model = lambda df, c: of(df.select("query", c).join(models, F.lit(True))).select("query", c)
    scored = candidates.join(models, F.lit(True)).join(scores, ["model", "query", "item"], "left")
    order = Window.partitionBy("model", "query").orderBy(F.col("score").desc_nulls_last(), "rank")
    kept = of(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cut)).select("query", "item", "rank")
    each = retrieval_metrics(kept, each_model(gold, "item"), k) if asked is None else retrieval_metrics(kept, gold, k, each_model(asked, "group"))
    return arm_means(each.withColumn("model", F.col("query.model")), "model")


def arm_means(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over the queries; 0 where there are none."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), mean("recall_any").alias("recall_any"), mean("recall_all").alias("recall_all"), mean("mrr").alias("mrr"), mean("ndcg").alias("ndcg"))


def gate(rows: DataFrame, name: str, hit: Column, passes, threshold: float | None, of: Column | None = None, empty: str = "blocked") -> DataFrame:
    """One row: name, status, numerator, denominator, threshold. `passes` maps the rate to a boolean column.

    `of` says which rows count. An empty denominator has the status `empty` ('failed' and 'passed' are allowed as well).
    """
    counted = F.lit(True) if of is None else F.coalesce(of, F.lit(False))
    sums = rows.agg(F.count_if(counted & F.coalesce(hit, F.lit(False))).alias("numerator"), F.count_if(counted).alias("denominator"))
    rate = F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0))
    status = F.when(F.col("denominator") == 0, empty).when(passes(rate), "passed").otherwise("failed")
    return sums.select(F.lit(name).alias("name"), status.alias("status"), "numerator", "denominator", F.lit(threshold).cast("double").alias("threshold"))


def refusal_gate(rows: DataFrame, refused: Column) -> DataFrame:
    return gate(rows, "refusal", refused, lambda r: r > REFUSAL_ABOVE, REFUSAL_ABOVE, empty="failed")


def false_refusal_gate(rows: DataFrame, refused: Column) -> DataFrame:
    return gate(rows, "false_refusal", refused, lambda r: r < FALSE_REFUSAL_BELOW, FALSE_REFUSAL_BELOW, empty="passed")


def canned_gate(rows: DataFrame, declined: Column) -> DataFrame:
    return gate(rows, "canned_out_of_scope", declined, lambda r: r == 1, None, empty="failed")


def entailment_gate(sentences: DataFrame, cited: Column, entailed: Column) -> DataFrame:
    return gate(sentences, "citation_entailment_precision", entailed, lambda r: r >= ENTAILMENT_FROM, ENTAILMENT_FROM, cited, empty="failed")


def uncited_gate(sentences: DataFrame, factual: Column, cited: Column) -> DataFrame:
    return gate(sentences, "uncited_factual_rate", ~F.coalesce(cited, F.lit(False)), lambda r: r <= UNCITED_TO, UNCITED_TO, factual, empty="passed")


def group_coverage_gate(groups: DataFrame, verified: Column) -> DataFrame:
    return gate(groups, "claim_group_coverage", verified, lambda r: r >= GROUP_COVERAGE_FROM, GROUP_COVERAGE_FROM, empty="failed")


def severity_gate(rows: DataFrame, judged: str = "judged", gold: str = "gold") -> DataFrame:
    """Grades at most one apart agree; a grade that is missing does not; one pair two apart fails the gate."""
    apart = F.abs(F.col(judged) - F.col(gold))
    sums = rows.agg(F.count_if(apart <= 1).alias("numerator"), F.count(F.lit(1)).alias("denominator"), F.coalesce(F.bool_or(apart >= 2), F.lit(False)).alias("__far"))
    passed = ~F.col("__far") & (F.col("denominator") > 0) & (F.col("numerator") >= SEVERITY_FROM * F.col("denominator"))
    return sums.select(F.lit("severity").alias("name"), F.when(passed, "passed").otherwise("failed").alias("status"), "numerator", "denominator", F.lit(SEVERITY_FROM).alias("threshold"))


def within_tolerance(actual: Column, expected: Column, tolerance: float) -> Column:
    """Relative difference, absolute where 0 is expected; a missing value is outside."""
    gap = F.abs(actual - expected) / F.when(expected == 0, 1.0).otherwise(F.abs(expected))
    return F.coalesce(gap <= tolerance, F.lit(False))


def release_verdict(gates: list[DataFrame]) -> DataFrame:
    """failed before blocked before passed, over the union of gates."""
    all_ = reduce(lambda a, b: a.unionByName(b), gates)
    failed, blocked = F.bool_or(F.col("status") == "failed"), F.bool_or(F.col("status").isin("blocked", "skipped"))
    return all_.agg(F.when(failed, "failed").when(blocked, "blocked").otherwise("passed").alias("verdict"), F.count(F.lit(1)).alias("gates"))


def claim_groups(sentences: DataFrame, run: str = "run", index: str = "index", paragraph: str = "paragraph", factual: str = "factual") -> DataFrame:
    """Maximal runs of neighbouring factual sentences of one paragraph: run, group (from 1), first, last, size."""
    order = Window.partitionBy(run).orderBy(index)
    before = (F.lag(factual).over(order), F.lag(paragraph).over(order))
    starts = F.col(factual) & (~F.coalesce(before[0], F.lit(False)) | ~before[1].eqNullSafe(F.col(paragraph)))
    marked = sentences.withColumn("group", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(factual)
    return marked.groupBy(run, "group").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("size"))


def confusion_summary(rows: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """expected, n, correct, accuracy for each class, and one row for all (null class)."""
    right = F.col(expected).eqNullSafe(F.col(predicted))
    return rows.rollup(expected).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))


def calibrate_threshold(scores: DataFrame, answerable: str = "answerable", score: str = "score") -> DataFrame:
    """max_no_answer, min_answerable, separable, threshold (midpoint; null where the two overlap), floor (half the least answerable)."""
    sums = scores.agg(F.max(F.when(~F.col(answerable), F.col(score))).alias("max_no_answer"), F.min(F.when(F.col(answerable), F.col(score))).alias("min_answerable"))
    apart = F.col("max_no_answer") < F.col("min_answerable")
    return sums.withColumns({"separable": apart, "threshold": F.when(apart, (F.col("max_no_answer") + F.col("min_answerable")) / 2), "floor": F.col("min_answerable") / 2})


def coverage_table(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by the columns, with a totals row of nulls."""
    return rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def outcome_fold(sentences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """For each answer: factual sentences, those with any supported pair, their share (null without factual ones), failing pairs, uncited ones.

    `sentences` has answer, index, factual; `verdicts` has answer, index, document, supported.
    """
    by = verdicts.groupBy("answer", "index").agg(F.bool_or("supported").alias("any_supported"), F.count_if(~F.col("supported")).alias("failing"))
    joined = sentences.join(by, ["answer", "index"], "left")
    fact = F.col("factual")
    sums = joined.groupBy("answer").agg(
        F.count_if(fact).alias("n_factual"), F.count_if(fact & F.coalesce("any_supported", F.lit(False))).alias("n_supported"),
        F.coalesce(F.sum("failing"), F.lit(0)).alias("n_failing"), F.count_if(fact & F.col("any_supported").isNull()).alias("n_uncited"),
    )
    return sums.withColumn("rate", F.col("n_supported") / F.nullif(F.col("n_factual"), F.lit(0)))


def verdict_coverage(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What is wrong with a verdict table: (pair, problem) where a pair has no verdict, several, or is unknown."""
    counted = verdicts.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select("pair", F.lit(True).alias("known")).join(counted, "pair", "full_outer")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return both.select("pair", problem.alias("problem")).filter("problem is not null")


def source_agreement(votes: DataFrame, key: str = "key", token: str = "token", least: int = 2) -> DataFrame:
    """The token that at least `least` sources state, the first by name where several do."""
    counts = votes.filter(F.col(token).isNotNull()).groupBy(key, token).agg(F.countDistinct("source").alias("sources"))
    return counts.filter(F.col("sources") >= least).groupBy(key).agg(F.min(F.struct(token, "sources")).alias("x")).select(key, f"x.{token}", "x.sources")


def cheapest_passing(arms: DataFrame) -> DataFrame:
    """The arm of the least cost among those whose gates all passed (ties by name)."""
    return arms.groupBy("arm").agg(F.bool_and("passed").alias("ok"), F.max("cost").alias("cost")).filter("ok").agg(F.min(F.struct("cost", "arm")).alias("x")).select("x.arm", "x.cost").filter("arm is not null")
