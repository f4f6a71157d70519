"""Pages as ordered blocks: headings, paragraphs, list items, tables and figures, with boilerplate marked and left out."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKIPPED = frozenset({"script", "style", "nav", "header", "footer"})
_BLOCK = pa.struct([("type", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("caption", pa.string()), ("container", pa.string())])
BLOCK_DDL = "page_id long, title string, blocks array<struct<type:string,text:string,level:int,caption:string,container:string>>"

#: What the name of a container says about its content; the first that matches counts.
REASONS = (
    (r"cookie|consent", "cookie"), (r"breadcrumb", "breadcrumb"), (r"banner", "banner"), (r"social|share|follow", "social"), (r"related", "related"),
    (r"menu|navbar|nav\b|footer|masthead|utility|sidebar|toolbar", "menu"),
)


class _Reader(HTMLParser):
    """One pass over a page. Text between blocks' tags belongs to the block that is open."""

    KINDS = {"p": "text", "li": "list_item", "h1": "title"} | {f"h{n}": "heading" for n in range(2, 7)}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.skip: list[str] = []
        self.open: dict | None = None
        self.parts: list[str] = []
        self.containers: list[tuple[str, str]] = []
        self.table: list[list[str]] | None = None
        self.figure: list[str] | None = None

    def close_block(self) -> None:
        if self.open:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(self.open | {"text": text})
        self.open, self.parts = None, []

    def container(self) -> str | None:
        return self.containers[-1][1] if self.containers else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip.append(tag)
        if self.skip:
            return
        name = " ".join(v for k, v in attrs if k in ("class", "id") and v)
        if name and tag in ("div", "section", "aside", "ul", "ol", "main", "article"):
            self.containers.append((tag, name.lower()))
        if tag == "table":
            self.close_block()
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table is not None:
            self.parts = []
        elif tag == "figure":
            self.close_block()
            self.figure = []
        elif tag in self.KINDS and self.table is None:
            self.close_block()
            level = 0 if tag == "h1" else int(tag[1]) - 1 if tag[0] == "h" else None
            self.open = {"type": self.KINDS[tag], "level": level, "caption": None, "container": self.container()}

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if self.containers and self.containers[-1][0] == tag:
            self.containers.pop()
        if tag in ("td", "th") and self.table:
            self.table[-1].append(" ".join("".join(self.parts).split()))
            self.parts = []
        elif tag == "table" and self.table is not None:
            rows = "\n".join(" ".join(c for c in r if c) for r in self.table)
            if rows.strip():
                self.blocks.append({"type": "table", "text": rows, "level": None, "caption": None, "container": self.container()})
            self.table = None
        elif tag == "figure" and self.figure is not None:
            caption = " ".join("".join(self.figure).split()) or None
            self.blocks.append({"type": "figure", "text": "[FIGURE]", "level": None, "caption": caption, "container": self.container()})
            self.figure = None
        elif tag in self.KINDS:
            self.close_block()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.figure is not None:
            self.figure.append(data)
        elif self.open or self.table is not None:
            self.parts.append(data)


def read_page(page: str | None) -> tuple[str | None, list[dict]]:
    """The title and the blocks of a page."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.close_block()
    title = next((b["text"] for b in reader.blocks if b["type"] == "title"), None)
    return title, reader.blocks


def html_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """page_id, title, blocks for each page (`key`, html): all blocks of content, in order; boilerplate is judged afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, titles, lists = [], [], []
            for row in batch.to_pylist():
                title, blocks = read_page(row["html"])
                ids.append(row[key])
                titles.append(title)
                lists.append(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(titles, pa.string()), pa.array(lists, pa.list_(_BLOCK))], names=[key, "title", "blocks"])

    rows = pages.select(F.col(key).cast("long").alias(key) if key == "page_id" else F.col(key), "html")
    return rows.mapInArrow(run, BLOCK_DDL if key == "page_id" else BLOCK_DDL.replace("page_id long", f"{key} {dict(rows.dtypes)[key]}"))


def exploded(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    return blocks.select(key, "title", F.posexplode("blocks").alias("pos", "b")).select(key, "title", "pos", "b.*")


def collected(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """`exploded` undone: title and blocks of each page, in order."""
    block = F.struct("pos", F.struct("type", "text", "level", "caption", "container").alias("b"))
    return rows.groupBy(key).agg(F.first("title", True).alias("title"), F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("blocks"))


def mark_furniture(rows: DataFrame, least: int = 3) -> DataFrame:
    """Headings that equal the title, or stand `least` times or more in a page, become page furniture (case aside)."""
    times = F.count(F.lit(1)).over(Window.partitionBy("page_id", "type", F.lower("text")))
    furniture = (F.col("type") == "heading") & (F.lower("text").eqNullSafe(F.lower("title")) | (times >= least))
    return rows.withColumn("type", F.when(furniture, "page_furniture").otherwise(F.col("type")))


def section_paths(rows: DataFrame, levels: int = 6) -> DataFrame:
    """Adds `path`: for each level the last heading, as far as no lesser level has begun since."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("type") == "heading"
    level = F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))
    out = rows
    for n in range(1, levels + 1):
        at = F.last(F.when(is_head & (level <= n), F.struct("pos", level.alias("l"), "text")), ignorenulls=True).over(w)
        out = out.withColumn(f"__{n}", F.when(at["l"] == n, at["text"]))
    return out.withColumn("path", F.array_compact(F.array(*(F.col(f"__{n}") for n in range(1, levels + 1))))).drop(*(f"__{n}" for n in range(1, levels + 1)))


def split_references(rows: DataFrame) -> DataFrame:
    """Adds `reference`: rows from a references heading to the next heading of its level or above."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("type") == "heading"
    named = F.col("text").rlike(r"(?i)^\s*(?:\d+(?:\.\d+)*\s+)?(references|bibliography|works cited|reference list)\s*$")
    depth = F.last(F.when(head & named, F.col("level")), ignorenulls=True).over(w)
    started = F.max(F.when(head & named, F.col("pos"))).over(w)
    closed = F.max(F.when(head & ~named & (F.col("level") <= F.col("__depth")), F.col("pos"))).over(w)
    marked = rows.withColumns({"__depth": depth, "__from": started})
    return marked.withColumn("reference", F.coalesce((F.col("__from") >= F.coalesce(closed, F.lit(-1))), F.lit(False))).drop("__depth", "__from")


def boilerplate_reason(container: Column) -> Column:
    """What the name of a block's container says it is, or null."""
    out = F.when(container.isNull(), F.lit(None).cast("string"))
    for pattern, name in REASONS:
        out = out.when(container.rlike(pattern), name)
    return out


# Headings that are nothing but the label of a rail of links.
RELATED_LABEL = r"(?i)^(?:related(?:\s+(?:content|stories|articles|topics|links|resources|reading))?|more\s+(?:from|on|stories)|see\s+also|you\s+may\s+also\s+like|explore\s+more)\s*$"
SOCIAL_LABEL, LABEL_WORDS = r"(?i)^(?:follow|connect|stay connected|find us)\b", 5


def rail_label(text: Column) -> Column:
    """The reason that a heading gives to the list below it, where the heading is a label as a whole; else null."""
    return F.when(text.rlike(RELATED_LABEL), "related").when(text.rlike(SOCIAL_LABEL) & (F.regexp_count(text, F.lit(r"\S+")) <= LABEL_WORDS), "social")


def mark_boilerplate(rows: DataFrame, key: str = "page_id", backend: str | None = None) -> DataFrame:
    """Adds `reason` to blocks (key, pos, type, text, container): why a block is boilerplate, or null where it stays.

    A heading opens a rail if it is a label, and closes any; so does a block that is no list item or whose container gives
    a reason of its own. List items are judged by their container, or else by the rail that is open. So the state before a block is what
    the last block that sets it has set, a window over the page's blocks. In doubt a block stays. Where `backend` names a column, only rows
    of the backend 'html' are judged.
    """
    heading, item = F.col("type").isin("title", "heading"), F.col("type") == "list_item"
    own = boilerplate_reason(F.col("container"))
    opened = F.when(heading, rail_label(F.col("text")))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.coalesce(heading | ~item | own.isNotNull(), F.lit(True))
    rail = F.last(F.when(sets, F.struct(opened.alias("reason"))), ignorenulls=True).over(before)["reason"]
    reason = F.when(heading, opened).otherwise(F.coalesce(own, F.when(item, rail)))
    return rows.withColumn("reason", reason if backend is None else F.when(F.col(backend) == "html", reason))


def without_boilerplate(rows: DataFrame, key: str = "page_id", backend: str | None = None) -> DataFrame:
    """The blocks that stay, as they were."""
    return mark_boilerplate(rows, key, backend).filter("reason is null").drop("reason")


def boilerplate_audit(marked: DataFrame, key: str = "page_id") -> DataFrame:
    """Of marked blocks, for each page: how many go, how many of each reason, and each as 'reason: text' in order."""
    named = marked.filter("reason is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "reason", "text"))), lambda x: F.concat_ws(": ", x["reason"], x["text"]))
    reasons = sorted({r for _, r in REASONS})
    return named.groupBy(key).agg(F.count(F.lit(1)).alias("dropped"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in reasons), lines.alias("lines"))


# Words that mark a paragraph about rights, headings above such ones, and words of a page's own statement.
TRIGGERS = r"creative commons|rights reserved|public domain|cc0|cc by|licence|license"
RIGHTS_HEADINGS = r"copyright|licence|license|rights|permissions"
RIGHTS_WORDS = r"all rights reserved|©|copyright|open access article"


def rights_statements(rows: DataFrame) -> DataFrame:
    """page_id, pos, heading, text: the paragraph of each page that most likely states its rights.

    Of paragraphs with a trigger word, the first below a heading about rights; else the first that speaks of the page's own
    rights; else the first.
    """
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    under = F.last(F.when(F.col("type").isin("title", "heading"), F.col("text")), ignorenulls=True).over(upto)
    found = rows.withColumn("heading", F.coalesce(under, F.lit(""))).filter((F.col("type") == "text") & F.lower("text").rlike(TRIGGERS))
    rank = F.when(F.lower("heading").rlike(RIGHTS_HEADINGS), 0).when(F.lower("text").rlike(RIGHTS_WORDS), 1).otherwise(2)
    best = found.groupBy("page_id").agg(F.min(F.struct(rank.alias("rank"), "pos", "heading", "text")).alias("x"))
    return best.select("page_id", "x.pos", "x.heading", "x.text")
