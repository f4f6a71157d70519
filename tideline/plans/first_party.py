"""First-party entries: checked, written as pages of one numbered section, and taken through the same ingest as any page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_sentence
from ..operators.blocks import html_blocks
from ..operators.catalogue import required
from ..operators.chunking import Limits, chunk_documents

ENTRY = (
    "id string, name string, category string, canonical_url string, one_liner string, prose string, links array<struct<label:string,url:string>>, "
    "facts array<struct<key:string,label:string,value:double,as_of:string,source_url:string>>, people array<struct<name:string,one_liner:string,link:string>>"
)
SOURCE_TYPE = "voices"


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def entry_violations(entries: DataFrame) -> DataFrame:
    """Adds `violations` to entries (`ENTRY`): what is missing, numbers that say no date, and ids that stand twice.

    A number without a date is refused, because a reader of the sentence made of it could not tell how old it is.
    """
    fields = [required(c) for c in ("id", "name", "category", "canonical_url", "one_liner", "prose")]

    def inner(column: str, name: str, by: str, checks: dict[str, Callable[[Column], Column]]) -> Column:
        found = F.transform(column, lambda x: F.concat_ws("\x1f", *(F.when(check(x), F.concat(F.lit(f"{name} "), F.coalesce(x[by], F.lit("?")), F.lit(f": {what}"))) for what, check in checks.items())))
        return F.filter(F.flatten(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.split(t, "\x1f"))), lambda t: t != "")

    facts = inner("facts", "fact", "key", {
        "label is missing": lambda x: _blank(x["label"]), "source_url is missing": lambda x: _blank(x["source_url"]), "value is no number": lambda x: x["value"].isNull() | F.isnan(x["value"]),
        "as_of is no date": lambda x: F.try_to_date(F.coalesce(x["as_of"], F.lit("")), "yyyy-MM-dd").isNull(),
    })
    people = inner("people", "person", "name", {"one_liner is missing": lambda x: _blank(x["one_liner"]), "link is missing": lambda x: _blank(x["link"])})
    links = inner("links", "link", "label", {"label is missing": lambda x: _blank(x["label"]), "url is missing": lambda x: _blank(x["url"])})
    repeated = entries.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    joined = entries.join(repeated, "id", "left")
    own = F.array_compact(F.array(*fields, F.when(F.col("__n").isNotNull(), F.lit("id: repeated"))))
    return joined.withColumn("violations", F.concat(own, facts, people, links)).drop("__n")


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def page(entries: DataFrame) -> DataFrame:
    """doc_id, title, html of each entry: everything below one numbered heading, facts as sentences with their dates."""
    paragraph = lambda t: F.concat(F.lit("<p>"), escaped(t), F.lit("</p>"))
    prose = F.filter(F.transform(F.split(F.trim("prose"), "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    none = F.array().cast("array<string>")
    facts = F.transform("facts", lambda f: fact_sentence(F.to_date(f["as_of"]), f["value"], f["label"]))
    people = F.transform("people", lambda p: F.concat(p["name"], F.lit(" — "), p["one_liner"], F.lit(" ("), p["link"], F.lit(")")))
    links = F.array_join(F.transform("links", lambda x: F.concat(x["label"], F.lit(": "), x["url"])), "; ")
    more = F.when(F.size("links") > 0, F.array(F.concat(F.lit("Find out more — "), links, F.lit("."))))
    texts = F.concat(F.array("one_liner"), prose, F.coalesce(facts, none), F.coalesce(people, none), F.coalesce(more, none))
    html = F.concat(F.lit("<html><body><h2>1 "), escaped(F.col("name")), F.lit("</h2>\n"), F.array_join(F.transform(texts, paragraph), "\n"), F.lit("</body></html>"))
    return entries.select(F.concat(F.lit(f"{SOURCE_TYPE}:"), "id").alias("doc_id"), F.col("name").alias("title"), html.alias("html"))


def chunks(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The passages of all entries, each with its source type; an entry that violates anything is an error when it is read."""
    checked = entry_violations(entries)
    stop = F.raise_error(F.concat(F.coalesce("id", F.lit("?")), F.lit(": "), F.array_join("violations", "; "))).cast("boolean")
    good = checked.filter(F.when(F.size("violations") == 0, F.lit(True)).otherwise(stop))
    pages = page(good)
    blocks = html_blocks(pages.select("doc_id", "html"), "doc_id").drop("title").join(pages.select("doc_id", "title"), "doc_id")
    return chunk_documents(blocks, limits).withColumn("source_type", F.lit(SOURCE_TYPE))
