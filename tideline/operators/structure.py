"""Repairs of document structure over exploded blocks (page_id, title, pos, type, text, level, caption), as windows by page.

What a walk through the blocks would carry along is, at each row, the last heading before it; so each repair is one or two
windows in order of `pos`, and many pages are repaired at once without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of numbered headings, of headings that are no content, and of back matter within a paragraph.
NUMBERED = r"^\s*(\d+(?:\.\d+)*)(?:\s|$)"
KEY_MESSAGE = r"(?i)^\s*key message\s+\d+(?:\.\d+)*\b"
REFERENCES = r"(?i)^\s*(?:\d+(?:\.\d+)*\s+)?(references|bibliography|works cited|reference list)\s*$"
LABELS = (
    "lead authors?|contributing authors?|coordinating authors?|corresponding authors?|chapter authors?|recommended citation|cover art|acknowledge?ments?|affiliations?|"
    "about the authors?|editors?|reviewers?|authors?|table of contents|contents"
)
FRONT_MATTER = rf"(?i)^\s*(?:[\w&.'-]+\s+){{0,3}}(?:{LABELS})\s*[:.]?\s*$"
INSTITUTION = r"(?i)\b(universit|institut|laborato|department|centre|center|college|school of|observatory|academy|faculty)"
SUPERSCRIPTS = r"\b\d{1,2}\s*(?:[,;]\s*\d{1,2})+\b"
ADDRESSES = r"(?:^|[.;]\s+)\d{1,2}\s+[A-Z]"
BACK_MATTER = (
    r"(?i)^\s*(?:competing interests?|acknowledge?ments?|author contributions?|financial support|review statement|disclaimer|data availability|code availability|supplement|"
    r"video supplement)\s*[.:—-]"
)


def _page() -> Window:
    return Window.partitionBy("page_id").orderBy("pos")


def is_front_matter(text: Column) -> Column:
    """A label that is the whole heading, and no numbered one."""
    return text.rlike(FRONT_MATTER) & ~text.rlike(NUMBERED)


def is_affiliation(text: Column) -> Column:
    """Runs of superscripts, or an institution among numbers."""
    numbers = F.regexp_count(text, F.lit(r"\S*\d\S*"))
    listed = (numbers >= 2) | (F.regexp_count(text, F.lit(ADDRESSES)) >= 2) | ((F.regexp_count(text, F.lit(",")) >= 3) & (numbers >= 1))
    return text.rlike(SUPERSCRIPTS) | (text.rlike(INSTITUTION) & listed)


def is_prose(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"\S+")) >= 12) & F.rtrim(text).rlike(r"[.!?]$")


def repair_levels(rows: DataFrame) -> DataFrame:
    """Levels of headings from their numbers, where the reader has lost them.

    A dotted number counts always, a bare one if it has dotted children or a neighbour in sequence. Headings below a key
    message are its children until numbered or closing structure comes. A known level above 1 stays.
    """
    whole, upto = Window.partitionBy("page_id"), _page().rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("type") == "heading"
    number = F.when(head, F.nullif(F.regexp_extract("text", NUMBERED, 1), F.lit("")))
    marked = rows.withColumn("__number", number).withColumn("__bare", F.when(~F.col("__number").contains("."), F.expr("try_cast(__number AS bigint)")))
    marked = marked.withColumn("__bares", F.collect_set("__bare").over(whole)).withColumn("__firsts", F.collect_set(F.when(F.col("__number").contains("."), F.substring_index("__number", ".", 1))).over(whole))
    sequence = F.array_contains("__bares", F.col("__bare") - 1) | F.array_contains("__bares", F.col("__bare") + 1)
    dotted = F.col("__number").contains(".")
    depth = F.when(dotted, F.regexp_count("__number", F.lit(r"\.")) + 1).when(F.array_contains("__firsts", F.col("__number")) | sequence, 1)
    trusted, fallback = F.when(F.col("level") > 1, F.col("level")), F.when(F.col("level") > 0, F.col("level")).otherwise(1)
    key, closing = F.col("text").rlike(KEY_MESSAGE), F.col("text").rlike(REFERENCES) | is_front_matter(F.col("text"))
    change = F.when(head & key, True).when(head & trusted.isNull() & (depth.isNotNull() | closing), False)
    marked = marked.withColumn("__depth", depth).withColumn("__change", change)
    under = F.coalesce(F.last("__change", ignorenulls=True).over(upto), F.lit(False))
    level = F.when(key, 1).when(trusted.isNotNull(), trusted).when(F.col("__depth").isNotNull(), F.col("__depth")).when(closing, fallback).when(under, 2).otherwise(fallback)
    out = marked.withColumn("__level", F.when(head, level).otherwise(F.col("level")).cast("int"))
    return out.withColumn("level", F.col("__level")).drop("__level", "__number", "__bare", "__bares", "__firsts", "__depth", "__change")


def front_matter(rows: DataFrame) -> DataFrame:
    """Adds `dropped`: why a block goes (section, leading, affiliation, statement), null where it stays."""
    upto = _page().rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("type").isin("title", "heading")
    nth = F.sum(is_head.cast("int")).over(upto)
    label = (F.col("type") == "heading") & is_front_matter(F.col("text"))
    opens = (F.col("type") == "title") | ((nth == 1) & ~F.col("text").rlike(NUMBERED) & ~label)
    marked = rows.withColumn("__head", F.when(is_head, F.struct(label.alias("label"), opens.alias("zone"))))
    last = F.last("__head", ignorenulls=True).over(upto)
    marked = marked.withColumn("__last", last)
    running = F.col("type").isin("text", "list_item")
    why = (
        F.when(is_head, F.when(F.col("__head.label"), "section"))
        .when(F.col("__last").isNull(), F.when(running | (F.col("type") == "page_furniture"), "leading"))
        .when(F.col("__last.label"), "section")
        .when(F.col("__last.zone") & running & (is_affiliation(F.col("text")) | ~is_prose(F.col("text"))), "affiliation")
        .when((F.col("type") == "text") & F.col("text").rlike(BACK_MATTER), "statement")
    )
    return marked.withColumn("dropped", why).drop("__head", "__last")


def attach_captions(rows: DataFrame) -> DataFrame:
    """Captions beside a figure or table become its own: the next block's first, else the one before, each used once.

    A neighbour that repeats an own caption goes, as do captions that belong to nothing.
    """
    w = _page()
    kinds = ("figure", "table")
    here = F.struct("type", "caption", F.trim("text").alias("text"))
    marked = rows.withColumns({"__n": F.lead(here).over(w), "__p": F.lag(here).over(w), "__pp": F.lag(here, 2).over(w), "__nn": F.lead(here, 2).over(w)})

    def takes_next(obj: str, nxt: str) -> Column:
        """Whether the object takes the block after it: a caption where it has none, or a repeat of its own."""
        o, n = F.col(obj), F.col(nxt)
        none = o["caption"].isNull() & (n["type"] == "caption")
        same = n["type"].isin("caption", "text") & (n["text"] == F.trim(o["caption"]))
        return F.coalesce(o["type"].isin(*kinds) & (none | same), F.lit(False))

    marked = marked.withColumn("__h", here).withColumn("__free", ~takes_next("__pp", "__p"))
    next_, before = F.col("__n"), F.col("__p")
    mine = F.col("type").isin(*kinds)
    found = F.when(F.col("caption").isNotNull(), F.col("caption")).when(next_["type"] == "caption", next_["text"]).when((before["type"] == "caption") & F.col("__free"), before["text"])

    def takes_before(obj: str, nxt: str, prev: str, free: Column) -> Column:
        """Whether the object takes the block before it, since it does not take the one after."""
        o, p = F.col(obj), F.col(prev)
        none = o["caption"].isNull() & (p["type"] == "caption")
        same = p["type"].isin("caption", "text") & (p["text"] == F.trim(o["caption"]))
        return F.coalesce(o["type"].isin(*kinds) & ~takes_next(obj, nxt) & free & (none | same), F.lit(False))

    # A block is used by the object before it, or by the one after it if that takes it and the one before has not.
    used = takes_next("__p", "__h") | takes_before("__n", "__nn", "__h", ~takes_next("__p", "__h"))
    kept = marked.withColumn("__used", used).withColumn("caption", F.when(mine, found).otherwise(F.col("caption")))
    return kept.filter(~F.col("__used") & (F.col("type") != "caption")).drop("__n", "__p", "__pp", "__nn", "__h", "__free", "__used")
