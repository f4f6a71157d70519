"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Defined results: a null, empty or white-space text has no words, all counts 0, and fails (`too_few_words`). Ties and
repeated rows are judged row by row. Stop words and word lengths say nothing about a text that is mostly in other letters than Latin ones. Very long texts cost O(n log n) in their words. Columns of the input whose
names clash with those added are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, words

#: Words in each window that is looked for twice.
WINDOW = 8
NO_SYMBOLS = r"[^#*$%&|<>]+"

#: What is no letter of another script than Latin (fixed values): the Latin blocks, marks, punctuation and symbols.
LATIN = r"[\x{0}-\x{36F}\x{1E00}-\x{1EFF}\x{2000}-\x{2BFF}\x{3000}-\x{303F}\x{FF00}-\x{FF65}]+"

#: Common short words of English, French, Spanish, German, Italian, Portuguese, Dutch, Polish, Czech, Swedish, Danish, Norwegian,
#: Finnish, Hungarian, Romanian, Turkish, Indonesian and Vietnamese.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "con del el es las lo los mas no para por se su una y "
    "auf das dem den der die ein eine für ist mit nicht sich und von zu "
    "che di non sono del della nel um uma não com dos das ao het een van niet dat op met te "
    "i w na się nie jest do z že je v s och att det som på er ikke og til å "
    "ja on ei että ez az egy hogy și în cu nu bir ve bu için ile yang dan di untuk dengan là và của có không"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the table: a text of `from_words` words or more fails where `measure` is not within [least, most]; if `latin`, only one mostly in Latin letters."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0
    latin: bool = False


#: Measures are the keys of `measures()`. Where `from_words` is set, shorter texts are exempt, since ratios of few words say little.
RULES = (
    Rule("too_few_words", "n_words", least=20),
    Rule("repeated_windows", "repeat_share", most=0.30),
    Rule("word_length", "mean_word_chars", least=2.0, most=15.0, latin=True),
    Rule("symbols", "symbols_per_word", most=0.20),
    Rule("duplicate_lines", "dup_line_share", most=0.45, from_words=20),
    Rule("stop_words", "stop_word_share", least=0.01, from_words=80, latin=True),
    Rule("exclamations", "exclamations_per_word", most=0.30, from_words=20),
    Rule("long_lines_cut", "ellipsis_line_share", most=0.30, from_words=20),
)

#: These two alone make up `base_failed`; they are compared in whole numbers.
BASE = ("too_few_words", "repeated_windows")


def _repeat_words(tokens: Column) -> Column:
    """Words that lie in a window of `WINDOW` words which the text holds twice or more."""
    def windows(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(h) > WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    def covered(tagged: Column) -> Column:
        twice = F.filter(
            F.transform(tagged, lambda x, k: F.when((F.get(tagged, k - 1)["h"] == x["h"]) | (F.get(tagged, k + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull(),
        )
        # Each window adds as many words as lie before the next one starts.
        return F.aggregate(
            F.sort_array(twice),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).cast("int").alias("n"), i.cast("int").alias("at")),
        )["n"]

    def count(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(tagged, covered))

    return _let(_let(F.transform(tokens, lambda w: F.xxhash64(w)), windows), count)


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the counts that the ratios need."""
    whole = F.coalesce(F.col(text), F.lit(""))
    tokens = words(F.col(text))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    counted = df.withColumn("__tokens", tokens).withColumn("__lines", lines)
    n_lines = F.size("__lines")
    return counted.withColumns(
        {
            "n_words": F.size("__tokens").cast("long"),
            "word_chars": F.char_length(F.array_join("__tokens", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole, NO_SYMBOLS, "")).cast("long"),
            "n_dup_lines": (n_lines - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("__tokens")).cast("long"),
            "n_lines": n_lines.cast("long"),
            "n_stop_words": F.size(F.filter("__tokens", lambda w: w.isin(*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)))).cast("long"),
            "n_other_letters": F.length(F.regexp_replace(whole, LATIN, "")).cast("long"),
            "n_exclamations": (F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit("")))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("__lines", lambda line: line.endswith("...") | line.endswith("…"))).cast("long"),
        }
    ).drop("__tokens", "__lines")


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "repeat_share": F.col("n_repeat_words") / n,
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "stop_word_share": F.col("n_stop_words") / n,
        "exclamations_per_word": F.col("n_exclamations") / n,
        "ellipsis_line_share": F.col("n_ellipsis_lines") / lines,
    }


def _fails(rule: Rule, by: dict[str, Column]) -> Column:
    x, bad = by[rule.measure], F.lit(False)
    if rule.name == "repeated_windows":  # in whole numbers, as its contract has it
        return 100 * F.col("n_repeat_words") > round(100 * rule.most) * F.col("n_words")
    if rule.least is not None:
        bad = bad | (x < rule.least)
    if rule.most is not None:
        bad = bad | (x > rule.most)
    bad = bad & (F.col("n_words") >= rule.from_words)
    return bad & (2 * F.col("n_other_letters") < F.col("word_chars")) if rule.latin else bad


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_other_letters", "n_exclamations", "n_ellipsis_lines")


def _settled(df: DataFrame) -> DataFrame:
    """`df` with its counts behind a one-row generator, past which a later filter does not copy their expressions."""
    others = [c for c in df.columns if c not in COUNTS]
    return df.select(*others, F.explode(F.array(F.struct(*COUNTS))).alias("__counts")).select(*others, "__counts.*")


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the counts, `base_failed`, `failed_rules` (names) and `kept` to each row, in one projection."""
    counted, by = _settled(with_counts(df, text)), measures()
    failed = F.array_compact(F.array(*(F.when(_fails(r, by), F.lit(r.name)) for r in rules)))
    base = [r for r in rules if r.name in BASE]
    verdict = counted.withColumn("failed_rules", failed)
    return verdict.withColumn("base_failed", F.arrays_overlap("failed_rules", F.array(*(F.lit(r.name) for r in base)))).withColumn(
        "kept", F.size("failed_rules") == 0
    )


def keep(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of `df` that no rule rejects, with its columns as they were, whatever their names."""
    held = df.select(F.struct("*").alias("__row"), F.col(text).alias("text"))
    return apply_rules(held, rules).filter("kept").select("__row.*")


def op10_quality_rules(documents: DataFrame) -> DataFrame:
    return apply_rules(documents.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules")
    )
