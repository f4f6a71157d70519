"""HTML extraction by wrappers: union-free regular expressions inferred from all pages of a host.

A page becomes a tree by a lenient reading of its tag stream. Runs of siblings that repeat fold into repeated groups. Pages
of a host are then aligned one after another: what matches is merged, what only some pages have becomes optional, texts
that differ become slots, texts that never differ stay template text. Siblings that come in too many orders become one repeated
group of optional members, so a wrapper's size follows from a host's kinds of elements and not from its pages. Each task
merges its pages of a host before anything is shuffled; these parts are merged in two steps.

The wrapper decides what the article is. Its place is an article or main element that most of the text stands in, or, on a host
without these, the element that holds most of the slots' unlinked text. Inside it, places that are mostly links on most pages
and texts that are the same on all pages are furniture. A page is aligned with the wrapper of its host and takes its places
from there. HTML's own elements, roles and names like 'sidebar' mark furniture too, but not where they hold the article.

Defined results: a null or empty page has an empty text. A page whose host tells nothing (fewer than `TEMPLATE_FROM` pages) is read
by its own tags: its article or main elements, else all its blocks that are not mostly links. Where the wrapper leaves no text, the page
is read so as well. Unclosed, stray and crossing tags are closed as browsers do, about. A page cut off inside a tag loses that
tag. Pages that repeat are extracted each. Rows without a url share one wrapper. Elements below `DEEPEST` levels are one slot of
their ancestor in the wrapper; the page's text has them all.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Pages from which a host's wrapper is evidence.
TEMPLATE_FROM = 4
#: Siblings in a wrapper from which their order is given up, and kinds of them from which names are.
WIDE, KINDS = 16, 64
DEEPEST = 60
#: Hosts whose parts one task holds at a time.
HELD = 20_000
#: Parts of a host's wrapper are merged in this many groups first.
GROUPS = 64

# HTML's elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg iframe object select".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong strike sub sup time tt u var wbr".split())
LEFT_OUT = set("nav header footer aside form button dialog menu head script style noscript template textarea title svg iframe object select input".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN, HEADINGS = ("article", "main"), ("h1", "h2", "h3", "h4", "h5", "h6")
#: Words in class and id names, and roles, that mark what is not the article.
NAMES = set(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist reply replies respond cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup login popup modal overlay promo promotion promoted sponsor sponsored share sharing social "
    "sidebar side related recommended recommendations menu nav navbar navigation pagination pager header masthead footer copyright legal "
    "widget widgets toolbar tags disqus rail teaser teasers".split()
)
#: Words that say nothing themselves, so 'site-footer' is a footer while 'side-note' and 'has-sidebar' are not.
NEUTRAL = set(
    "site page main area box container wrapper wrap list section block inner outer item items top bottom left right global google user users reader readers blog "
    "form slot buttons button links link posts articles stories primary secondary bar panel unit row col column content text more js id the".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
#: An attribute from its start, with its value; so no value is read as a name.
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?")
_CAMEL, _DIGITS, _PARTS = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"\d+"), re.compile(r"[-_]+")


class Node:
    """An element of a page. `kids` holds nodes and texts; what is below it: articles, first headings, unlinked characters."""

    __slots__ = ("tag", "name", "out", "kids", "parent", "link", "articles", "titles", "plain")

    def __init__(self, tag: str, name: str = "", out: bool = False, parent: Node | None = None, link: bool = False):
        self.tag, self.name, self.out, self.kids, self.parent, self.link = tag, name, out, [], parent, link
        self.articles, self.titles, self.plain = int(tag in MAIN), int(tag == "h1"), 0

    @property
    def key(self) -> str:
        return f"{self.tag}.{self.name}" if self.name else self.tag


@lru_cache(maxsize=65536)
def _furniture(word: str) -> bool:
    """Whether a class or id name is made of `NAMES`, with nothing beside but `NEUTRAL` words and digits."""
    parts = [p for p in _PARTS.split(_DIGITS.sub("", _CAMEL.sub("-", word)).lower()) if p]
    return all(p in NAMES or p in NEUTRAL for p in parts) and any(p in NAMES for p in parts)


def _attributes(tag: str, text: str) -> tuple[str, bool]:
    """A name for the element (its first class, else its id, without digits), and whether it says that it is furniture."""
    name, out, seen = "", tag in LEFT_OUT, set()
    for m in _ATTRIBUTE.finditer(text) if text else ():
        kind, value = m[1].lower(), (m[2] or "").strip("\"'")
        if kind in seen:  # the first of a name counts
            continue
        seen.add(kind)
        if kind in ("class", "id"):
            words = value.split()
            if words and (not name or kind == "class"):
                name = _DIGITS.sub("", words[0].lower())
            out = out or any(_furniture(w) for w in words)
        elif kind == "role":
            out = out or any(w in ROLES for w in value.lower().split())
        elif kind == "hidden" or (kind == "aria-hidden" and value.strip().lower() == "true"):
            out = True
    return name, out and tag not in ("body", "html")


def parse(page: str) -> Node:
    """The tree of a page, with `out` settled for each element."""
    root = Node("root")
    stack, at, n, order = [root], 0, len(page), [root]

    def text(value: str) -> None:
        if value:
            stack[-1].kids.append(" " if value.isspace() else html.unescape(value))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("article", "main", "body") and tag in INLINE:
                    break
            continue
        if not m[4]:
            break
        if tag not in INLINE and tag not in VOID:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p" or stack[depth].tag in CLOSES.get(tag, ()):
                    del stack[depth:]
                    break
                if stack[depth].tag not in INLINE and stack[depth].tag not in ("p",):
                    break
        name, out = _attributes(tag, m[3])
        node = Node(tag, name, out, stack[-1], stack[-1].link or tag == "a")
        stack[-1].kids.append(node)
        order.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    _settle(order)
    return root


def _settle(order: list[Node]) -> None:
    """Takes back `out` where an element holds the article: most of the page's text with all its articles, or all first headings if there are none."""
    for node in reversed(order):
        if not node.link:
            node.plain += sum(len(k) for k in node.kids if isinstance(k, str) and k != " ")
        if node.parent is not None:
            up = node.parent
            up.articles, up.titles, up.plain = up.articles + node.articles, up.titles + node.titles, up.plain + node.plain
    whole = order[0]
    for node in order:
        if node.out and node.tag == "header" and _in_article(node) and any(isinstance(k, Node) and k.tag in HEADINGS for k in node.kids):
            node.out = False
        elif node.out and 2 * node.plain >= whole.plain > 0:
            node.out = not (node.articles == whole.articles if whole.articles else node.titles == whole.titles > 0)


def _in_article(node: Node) -> bool:
    while node is not None and node.tag not in MAIN:
        node = node.parent
    return node is not None


class Part:
    """A member of a wrapper: an element, or a text (key '#'). `pages` have it; `same` are the texts that all of these have there (none: a slot)."""

    __slots__ = ("key", "pages", "repeated", "loose", "same", "chars", "linked", "kids")

    def __init__(self, key: str, pages: int = 1, repeated: bool = False, loose: bool = False, same: frozenset = frozenset(), chars: int = 0, linked: int = 0, kids: list | None = None):
        self.key, self.pages, self.repeated, self.loose, self.same, self.chars, self.linked, self.kids = key, pages, repeated, loose, same, chars, linked, kids or []

    def row(self) -> list:
        return [self.key, self.pages, int(self.repeated), int(self.loose), sorted(self.same), self.chars, self.linked, [k.row() for k in self.kids]]

    @classmethod
    def of(cls, row: list) -> Part:
        return cls(row[0], row[1], bool(row[2]), bool(row[3]), frozenset(row[4]), row[5], row[6], [cls.of(k) for k in row[7]])


def _mark(text: str) -> int:
    """A checksum of a text, with its length in the last 20 bits."""
    return zlib.crc32(" ".join(text.split()).encode("utf-8", "surrogatepass")) << 20 | min(len(text), (1 << 20) - 1)


def fold(node: Node, depth: int = 0) -> Part:
    """The page's own expression: sibling runs that repeat become one repeated member, texts between them one slot."""
    if depth >= DEEPEST:
        return Part(node.key, kids=[Part("#", chars=node.plain)] if node.plain else None)
    kids = []
    for k in node.kids:
        if isinstance(k, str):
            if k != " ":
                kids.append(Part("#", same=frozenset((_mark(k),)), chars=len(k), linked=len(k) if node.link else 0))
        elif not k.out and k.tag not in VOID:
            kids.append(fold(k, depth + 1))
    for period in (1, 2, 3):
        at, out = 0, []
        while at < len(kids):
            unit = kids[at : at + period]
            keys, more = [k.key for k in unit], at + period
            while len(unit) == period and [k.key for k in kids[more : more + period]] == keys:
                unit = [_merge(a, b, True) for a, b in zip(unit, kids[more : more + period], strict=True)]
                more += period
            if more > at + period:
                for k in unit:
                    k.repeated = True
                out += unit
                at = more
            else:
                out.append(kids[at])
                at += 1
        kids = out
    whole = Part(node.key, kids=kids)
    if len(kids) > WIDE:
        whole.kids, whole.loose = _loosen(kids, True), True
    return whole


def _merge(a: Part, b: Part, one_page: bool) -> Part:
    """The least expression of this form that covers both members."""
    out = Part(a.key, max(a.pages, b.pages) if one_page else a.pages + b.pages, a.repeated or b.repeated, a.loose or b.loose, a.same | b.same if one_page else a.same & b.same, a.chars + b.chars, a.linked + b.linked)
    out.kids = _loosen(a.kids + b.kids, one_page) if out.loose else align(a.kids, b.kids, one_page)
    if len(out.kids) > WIDE and not out.loose:
        out.kids, out.loose = _loosen(out.kids, True), True
    return out


def _loosen(members: list[Part], one_page: bool) -> list[Part]:
    """The members of a repeated group of optional ones, one of each key; without names where these are too many."""
    found: dict[str, Part] = {}
    for k in members:
        found[k.key] = _merge(found[k.key], k, one_page) if k.key in found else k
        found[k.key].repeated = True
    if len(found) > KINDS and any("." in key for key in found):
        for k in found.values():
            k.key = k.key.partition(".")[0]
        return _loosen(list(found.values()), one_page)
    return [found[key] for key in sorted(found)]


def align(a: list[Part], b: list[Part], one_page: bool = False) -> list[Part]:
    """Members of two sequences: matched ones merged, others as they are (so optional), in an order that keeps both."""
    ka, kb = ([k.key for k in x] for x in (a, b))
    if ka == kb:
        return [_merge(x, y, one_page) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            out.append(_merge(a[i], b[j], one_page))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return out


def infer(pages: list[str]) -> Part:
    """The wrapper of pages of one host."""
    whole = None
    for page in dict.fromkeys(p for p in pages if p):
        own = fold(parse(page))
        whole = own if whole is None else _merge(whole, own, False)
    return whole or Part("root", 0)


def expression(part: Part, pages: int | None = None) -> str:
    """The wrapper as text: tags, #PCDATA for slots, ( )? for optional and ( )+ for repeated groups."""
    inner = ("text" if part.same else "#PCDATA") if part.key == "#" else f"<{part.key}>" + "".join(expression(k, part.pages) for k in part.kids) + f"</{part.key.partition('.')[0]}>"
    optional = pages is not None and part.pages < pages
    return f"({inner}){'+' if part.repeated else ''}{'?' if optional else ''}" if part.repeated or optional else inner


#: What a place of the wrapper is for its pages: nothing known, the article, furniture, an article element that is not the article.
OPEN, ARTICLE, FURNITURE, MINOR = 0, 1, 2, 3


def compiled(whole: Part) -> list:
    """What extraction needs of a wrapper: [key, mark, repeated, checksums of template texts, members]; members only where they hold a mark."""
    if whole.pages < TEMPLATE_FROM:
        return []
    sums: dict[int, tuple[int, int, int]] = {}  # of a member: characters, linked ones, unlinked ones in slots

    def measure(part: Part) -> tuple[int, int, int]:
        own = (part.chars, part.linked, max(part.chars - part.linked - part.pages * sum(v & 0xFFFFF for v in part.same), 0))
        for k in part.kids:
            own = tuple(x + y for x, y in zip(own, measure(k), strict=True))
        sums[id(part)] = own
        return own

    measure(whole)
    tag = lambda part: part.key.partition(".")[0]
    articles: list[Part] = []

    def seek(part: Part) -> None:
        for k in part.kids:
            if tag(k) in MAIN:
                articles.append(k)
            else:
                seek(k)

    seek(whole)
    marks: dict[int, int] = {}
    if articles:
        # Teasers and the like: articles with a small part of the text that the greatest has on a page.
        mean = lambda part: sums[id(part)][0] / part.pages
        most = max(map(mean, articles))
        for part in articles:
            marks[id(part)] = MINOR if 8 * mean(part) < most and part.pages >= TEMPLATE_FROM else ARTICLE
    else:
        at = whole
        while True:
            best = max(at.kids, key=lambda k: sums[id(k)][2], default=None)
            blocks = best is not None and any(k.key != "#" and tag(k) not in INLINE for k in best.kids)
            if not blocks or 10 * sums[id(best)][2] < 6 * sums[id(at)][2] or not sums[id(best)][2]:
                break
            at = best
        if tag(at) not in ("root", "html", "body"):
            marks[id(at)] = ARTICLE
        articles = [at]

    template: dict[int, list[int]] = {}
    for main in articles:
        if main.pages < TEMPLATE_FROM:
            continue
        constant, fixed = 0, {}

        def walk(part: Part, steady: bool, main: Part = main, fixed: dict = fixed) -> int:
            """Marks furniture below `part`; `steady`: once on each page of the article. Gives the characters that never differ."""
            found = 0
            blocks = any(k.key != "#" and tag(k) not in INLINE for k in part.kids)
            for k in part.kids:
                if k.key == "#":
                    # Headings stay: many pages may have a section of the same name.
                    enough = k.pages >= (TEMPLATE_FROM if steady and not k.repeated else 2 * TEMPLATE_FROM)
                    if k.same and enough and k.pages == main.pages and not blocks and tag(part) not in INLINE and tag(part) not in HEADINGS:
                        fixed.setdefault(id(part), []).extend(sorted(k.same))
                        found += k.pages * sum(v & 0xFFFFF for v in k.same)
                    continue
                chars, linked, _ = sums[id(k)]
                if tag(k) not in INLINE and chars and 10 * linked >= 8 * chars and 2 * k.pages >= main.pages and k.pages >= TEMPLATE_FROM and _links(k) > 1:
                    marks[id(k)] = FURNITURE
                    continue
                found += walk(k, steady and not k.repeated)
            return found

        constant = walk(main, not main.repeated)
        # Template texts are a minor part of an article; where most texts agree, the pages are copies and say nothing.
        if 2 * constant < sums[id(main)][0]:
            template.update(fixed)

    def rows(part: Part) -> list | None:
        kids = [k for k in part.kids if k.key != "#"]
        inner = [rows(k) if marks.get(id(k)) != FURNITURE else [k.key, FURNITURE, int(k.repeated), [], []] for k in kids]
        if not any(inner) and not marks.get(id(part)) and id(part) not in template:
            return None
        members = [r or [k.key, OPEN, int(k.repeated), [], []] for r, k in zip(inner, kids, strict=True)] if any(inner) else []
        return [part.key, marks.get(id(part), OPEN), int(part.repeated), template.get(id(part), []), members]

    return rows(whole) or []


def _links(part: Part) -> int:
    """Places of links in a member; a repeated one is two."""
    return sum((2 if k.repeated or part.repeated else 1) if k.key.partition(".")[0] == "a" else _links(k) * (2 if k.repeated else 1) for k in part.kids)


@lru_cache(maxsize=4096)
def _loaded(wrapper: str | None) -> list:
    return json.loads(wrapper) if wrapper else []


def _places(kids: list, members: list) -> list:
    """The member of the wrapper that each child of a page's element is, by order where a key stands in several places."""
    by: dict[str, list[int]] = {}
    for k, m in enumerate(members):
        by.setdefault(m[0], []).append(k)
    out, at = [], 0
    for k in kids:
        found = None
        if isinstance(k, Node):
            where = by.get(k.key) or by.get(k.tag) or []
            place = next((p for p in where if p >= at), where[-1] if where else None)
            if place is not None:
                found = members[place]
                at = max(at, place if found[2] else place + 1)
        out.append(found)
    return out


def extract(page: str | None, wrapper: str | None = None) -> str:
    """The article's text: its blocks with single spaces, joined by one."""
    if not page:
        return ""
    root, places = parse(page), _loaded(wrapper)
    return (_read(root, places) if places else "") or _read(root, [])


def _read(root: Node, places: list) -> str:
    blocks: list[tuple[bool, str, float]] = []  # inside the article, text, share of linked text
    parts: list[str] = []
    linked = 0

    def flush(inside: bool) -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((inside, text, linked / max(len(text), 1)))
        parts.clear()
        linked = 0

    todo: list[tuple] = [(root, places, False, None)]
    while todo:  # no recursion: nesting has no bound
        node, place, inside, close = todo.pop()
        if close is not None:
            flush(close)
            continue
        if not isinstance(node, Node):
            parts.append(node)
            linked += len(node) if place else 0
            continue
        if node.out or (place and place[1] == FURNITURE):
            if node.tag not in INLINE:
                flush(inside)
            continue
        if node.tag in VOID:
            if node.tag in ("br", "hr"):
                parts.append(" ")
            continue
        mark = place[1] if place else OPEN
        within = inside or mark == ARTICLE or (node.tag in MAIN and mark != MINOR)
        if node.tag not in INLINE:
            flush(inside)
            todo.append((None, None, False, within))
        of = _places(node.kids, place[4]) if place and place[4] else [None] * len(node.kids)
        fixed = place[3] if place else ()
        for k, p in zip(reversed(node.kids), reversed(of), strict=True):
            if isinstance(k, Node):
                todo.append((k, p, within, None))
            elif not fixed or k == " " or _mark(k) not in fixed:
                todo.append((k, node.link, within, None))
    flush(False)
    if any(b[0] for b in blocks):
        return " ".join(b[1] for b in blocks if b[0])
    return " ".join(b[1] for b in blocks if b[2] <= 0.5)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each host of a task with the wrapper of its pages there, which are distinct."""
    held: dict[str, Part] = {}
    group = TaskContext.get().partitionId() % GROUPS

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": pa.array(held, pa.string()), "group": pa.array([group] * len(held), pa.int32()), "part": pa.array([json.dumps(p.row()) for p in held.values()], pa.string())})

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if page:
                own = fold(parse(page))
                held[host] = _merge(held[host], own, False) if host in held else own
        if len(held) > HELD:
            yield rows()
            held.clear()
    yield rows()


def _merged(parts: pd.Series) -> Part:
    whole = None
    for row in sorted(parts):  # whatever order they came in
        own = Part.of(json.loads(row))
        whole = own if whole is None else _merge(whole, own, False)
    return whole


def _once(rows: DataFrame) -> DataFrame:
    """host and html of `rows` without copies of a page of a host, wherever they lie: only hashes of pages are shuffled, and those that repeat say which row stays."""
    marked = rows.select("host", "html", F.xxhash64("html").alias("h"), F.length("html").alias("n"), F.monotonically_increasing_id().alias("at"))
    again = marked.groupBy("host", "h", "n").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first")).filter("rows > 1")
    again = shared.sized(shared.hold(again.select(F.col("host").alias("of"), F.col("h").alias("h0"), F.col("n").alias("n0"), "first"), "copies"))
    both = marked.join(again, (F.col("host") == F.col("of")) & (F.col("h") == F.col("h0")) & (F.col("n") == F.col("n0")), "left")
    return both.filter("first is null or at = first").select("host", "html")


def learn_wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON of `compiled`) for each host of `pages` (url, html) that tells something."""
    rows = _once(pages.select(host_of(F.col("url")).alias("host"), "html").filter("html is not null"))
    parts = rows.mapInArrow(_parts, "host string, group int, part string")
    some = parts.groupBy("host", "group").applyInPandas(lambda g: pd.DataFrame({"host": [g["host"].iloc[0]], "part": [json.dumps(_merged(g["part"]).row())]}), "host string, part string")
    done = some.groupBy("host").applyInPandas(lambda g: pd.DataFrame({"host": [g["host"].iloc[0]], "wrapper": [json.dumps(compiled(_merged(g["part"])))]}), "host string, wrapper string")
    return done.filter("wrapper <> '[]'")


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h, w) for h, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages`."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    wrappers = shared.sized(shared.hold(learn_wrappers(pages), "wrappers").withColumnRenamed("host", "of"), 100_000, "wrapper")
    with_host = pages.withColumn("host", host_of(F.col("url"))).join(wrappers, F.col("host") == F.col("of"), "left")
    return with_host.select("page_id", "url", "html", "wrapper").mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
