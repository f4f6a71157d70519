"""Decisions and joins over exchange, citation and licence records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Routes that answer, and those whose answer may be served again.
ROUTES = ("in_scope", "out_of_scope", "unsafe", "chart")


def cacheable(route: Column, history: Column, degraded: Column, flagged: Column, error: Column) -> Column:
    """Whether an exchange may be served again; anything unknown says no."""
    ok = (route == "in_scope") & (history == 0) & ~degraded & (flagged == 0) & ~error
    return F.coalesce(ok, F.lit(False))


def decide_route(label: Column, rewrite: Column, raw: Column) -> Column:
    """action and query of a classified question; an empty rewrite falls back to the raw question, an unknown label is an error."""
    text = F.coalesce(F.nullif(F.trim(rewrite), F.lit("")), raw)
    action = F.when(label == "in_scope", "retrieve").when(label == "chart", "chart").when(label.isin("out_of_scope", "unsafe"), "canned")
    known = F.when(label.isin(*ROUTES), action).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("null")))).cast("string"))
    return F.struct(known.alias("action"), F.when(label.isin("in_scope", "chart"), text).alias("query"))


def gate_document(retracted: Column, agreed: Column, page: Column, page_token: Column, negated: Column) -> Column:
    """confirmed, flagged or rejected: retraction first, then the sources' agreement, then what the publisher's page says."""
    return (
        F.when(F.coalesce(retracted, F.lit(False)), "flagged").when(agreed.isNull(), "rejected").when(page.isNull(), "flagged").when(F.coalesce(negated, F.lit(False)), "flagged")
        .when(page_token.isNotNull() & (page_token != agreed), "flagged").otherwise("confirmed")
    )


def authoritative_refusal(refused: Column, declined: Column) -> Column:
    return F.coalesce(refused, F.lit(False)) | F.coalesce(declined, F.lit(False))


def judge_kinds(category: Column, answered: Column, factual: Column, severity: Column) -> Column:
    """The judgements that an item needs, none to four."""
    return F.array_compact(
        F.array(
            F.when(category == "refusal", "refusal_quality"), F.when(answered, "answer_quality"),
            F.when(answered & (factual > 0), "citation_support"), F.when(answered & severity.isNotNull(), "severity"),
        )
    )


def planned_calls(items: DataFrame, text: str = "text", answerable: str = "answerable", kinds: str = "kinds") -> DataFrame:
    """One generation call for each answerable item and one for each judgement; tokens are a quarter of the length."""
    tokens = F.floor(F.length(text) / 4).alias("tokens")
    calls = items.filter(answerable).select("item", F.lit("generate").alias("call"), tokens)
    return calls.unionByName(items.select("item", F.explode(kinds).alias("call"), tokens))


def entailment_pairs(sentences: DataFrame, passages: DataFrame) -> DataFrame:
    """answer, pair (from 0), sentence, document, passage: cited sentences with their passage; of passages of one document the last counts."""
    last = passages.groupBy("answer", "document").agg(F.max_by("passage", F.struct("seq", "passage")).alias("passage"))
    both = sentences.join(last, ["answer", "document"])
    order = Window.partitionBy("answer").orderBy("sentence", "document")
    return both.select("answer", (F.row_number().over(order) - 1).alias("pair"), "sentence", "document", "passage")


def resolve_citations(answers: DataFrame, passages: str = "passages", indices: str = "indices") -> DataFrame:
    """Cited passages by their place (from 0); a place outside is an error when the row is read."""
    cited = answers.select("answer", passages, F.posexplode(indices).alias("n", "index"))
    inside = (F.col("index") >= 0) & (F.col("index") < F.size(passages))
    wrong = F.raise_error(F.concat(F.lit("no passage "), F.col("index").cast("string"))).cast("string")
    return cited.select("answer", "n", "index", F.when(inside, F.get(passages, F.col("index"))).otherwise(wrong).alias("passage"))


def serving_sources(servings: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Each serving with the exchange that it repeats."""
    source = exchanges.select(F.col("exchange").alias("source"), F.col("answer").alias("source_answer"))
    return servings.join(source, F.col("cached_from") == F.col("source"), "left").drop("cached_from")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def transcript_complete(events: DataFrame, terminal: tuple[str, ...] = ("done", "error")) -> DataFrame:
    """answer, complete: whether the last event of each stream ends it."""
    return events.groupBy("answer").agg(F.coalesce(F.max_by("event", "seq").isin(*terminal), F.lit(False)).alias("complete"))


def fold_events(events: DataFrame) -> DataFrame:
    """answer, text (tokens in order), n_events, ended."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "event", "data")))
    rows = events.groupBy("answer").agg(ordered.alias("e"))
    text = F.array_join(F.transform(F.filter("e", lambda x: x["event"] == "token"), lambda x: x["data"]), "")
    return rows.select("answer", text.alias("text"), F.size("e").cast("long").alias("n_events"), F.element_at("e", -1)["event"].alias("ended"))


def document_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's record; a chunk of no document is an error when the row is read."""
    joined = chunks.join(documents.withColumn("__known", F.lit(True)), "doc", "left")
    known = F.when(F.col("__known"), F.col("doc")).otherwise(F.raise_error(F.concat(F.lit("no document "), F.col("doc").cast("string"))).cast(chunks.schema["doc"].dataType))
    return joined.withColumn("doc", known).drop("__known")


def corpus_version(documents: DataFrame, *columns: str) -> DataFrame:
    """16 digits that change with any row: each row's hash is cut into four numbers, these are summed, and the sums hashed.

    Sums do not depend on the order of rows and combine in each task, so no list of all hashes comes together.
    """
    each = documents.select(F.sha2(F.to_json(F.struct(*sorted(columns))), 256).alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = each.agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), *(part(k) for k in range(4))).alias("s"))
    return sums.select(F.substring(F.sha2("s", 256), 1, 16).alias("version"))
