"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import containment, cube_mix, filter_audit, language_id, pseudonyms, quality_model, quality_rules, suffix_tree, superminhash, toxicity, training_order, whitening, wrappers
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op9_quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op11_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op12_whitening(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op13_filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op10_quality_rules(table(spark, sf_dir, "documents"))


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.op1_suffix_tree(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op2_language_id(table(spark, sf_dir, "documents"))


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.op4_cube_mix(table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.op5_pseudonyms(table(spark, sf_dir, "documents"), key="a key of these tables")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.sequences(table(spark, sf_dir, "documents"))


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES: dict[str, Query] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_language_id": op2_language_id,
    "op3_containment": op3_containment,
    "op4_cube_mix": op4_cube_mix,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_training_order": op6_training_order,
    "op7_wrappers": op7_wrappers,
    "op8_superminhash": op8_superminhash,
    "op9_quality_model": op9_quality_model,
    "op10_quality_rules": op10_quality_rules,
    "op11_toxicity": op11_toxicity,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
}

_STOP = ", ".join(f"'{w}', '{w.capitalize()}'" for w in quality_rules.STOP_WORDS)

ORACLES: dict[str, str] = {
    "op3_containment": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM bk) WHERE len(w) >= k),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM bk),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, round(n_found / CAST(n_shingles AS DOUBLE), 6) AS containment FROM f JOIN n USING (item_id) WHERE 100 * n_found >= 80 * n_shingles
""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], chr(1)))) AS s FROM d WHERE len(w) >= 8),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM x JOIN (SELECT doc_id, s FROM x GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, s)),
c AS (SELECT doc_id, CAST(sum(least(8, i - coalesce(p, -8))) AS BIGINT) AS n_repeat_words FROM r GROUP BY 1),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(len(w), 1) AS n, greatest(len(l), 1) AS nl,
  len(list_filter(w, lambda y: list_contains([{_STOP}], y))) AS n_stop, length(regexp_replace(t, '{quality_rules.LATIN}', '', 'g')) AS n_other, length(t) - length(replace(t, '!', '')) AS n_bang,
  len(list_filter(l, lambda y: ends_with(y, '...') OR ends_with(y, '…'))) AS n_cut FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
v AS (SELECT *, list_filter([CASE WHEN n_words < 20 THEN 'too_few_words' END, CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 'repeated_windows' END,
  CASE WHEN (word_chars / n < 2.0 OR word_chars / n > 15.0) AND 2 * n_other < word_chars THEN 'word_length' END, CASE WHEN n_symbols / n > 0.2 THEN 'symbols' END,
  CASE WHEN n_words >= 20 AND n_dup_lines / nl > 0.45 THEN 'duplicate_lines' END, CASE WHEN n_words >= 80 AND n_stop / n < 0.01 AND 2 * n_other < word_chars THEN 'stop_words' END,
  CASE WHEN n_words >= 20 AND n_bang / n > 0.3 THEN 'exclamations' END, CASE WHEN n_words >= 20 AND n_cut / nl > 0.3 THEN 'long_lines_cut' END], lambda z: z IS NOT NULL) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, len(failed) = 0 AS kept,
  CASE WHEN len(failed) > 0 THEN array_to_string(failed, ',') ELSE '' END AS failed_rules FROM v
""",
    "op13_filter_audit": r"""
WITH RECURSIVE f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o(filter_order, used) AS (SELECT CAST('' AS VARCHAR), 0 UNION ALL SELECT filter_order || letter, used + bit FROM o, f WHERE used & bit = 0),
s AS (SELECT filter_order, step, bit, CAST(coalesce((SELECT sum(g.bit) FROM f g WHERE position(g.letter IN filter_order) < step), 0) AS INTEGER) AS before
  FROM (SELECT filter_order FROM o WHERE length(filter_order) = 5), (SELECT unnest([1, 2, 3, 4, 5]) AS step), f WHERE filter_order[step] = letter),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(least < t.doc_id, false) AS INTEGER) AS mask
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
r AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
""",
}
