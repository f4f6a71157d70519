"""Repairs of structure, as the rules have them."""

from __future__ import annotations

from tideline.operators import structure as X


def frame(spark, blocks, page=1):
    rows = [(page, "T", k, *b) for k, b in enumerate(blocks)]
    return spark.createDataFrame(rows, "page_id long, title string, pos int, type string, text string, level int, caption string")


def test_levels(spark):
    heads = ["1 Intro", "2 Data", "2.1 Sources", "2.1.1 Old", "2024 was warm", "Key Message 1.1", "Seas rise", "References", "After"]
    got = [r.level for r in X.repair_levels(frame(spark, [("heading", h, 1, None) for h in heads] + [("heading", "Deep", 3, None), ("text", "x", None, None)])).orderBy("pos").collect()]
    assert got == [1, 1, 2, 3, 1, 1, 2, 1, 1, 3, None]


def test_front_matter(spark):
    long = "This is a long sentence that tells in more than twelve words what the paper found."
    blocks = [
        ("text", "University 1, 2", None, None), ("heading", "A Paper", 1, None), ("text", "Dept of X, 3, Y 4, Z, W 5", None, None), ("text", long, None, None), ("heading", "Lead Authors", 1, None),
        ("text", "Jo, Al", None, None), ("heading", "1 Authors", 1, None), ("text", "short", None, None), ("text", "Competing interests. None.", None, None),
    ]
    assert [r.dropped for r in X.front_matter(frame(spark, blocks)).orderBy("pos").collect()] == ["leading", None, "affiliation", None, "section", "section", None, None, "statement"]


def test_captions(spark):
    blocks = [
        ("figure", "[FIGURE]", None, None), ("caption", "one", None, None), ("figure", "[FIGURE]", None, None), ("caption", "two", None, None), ("text", "gap", None, None),
        ("caption", "three", None, None), ("table", "t", None, None), ("text", "gap", None, None), ("caption", "orphan", None, None), ("text", "gap", None, None),
        ("figure", "[FIGURE]", None, "own"), ("text", "own", None, None), ("caption", "own", None, None), ("figure", "[FIGURE]", None, None), ("text", "end", None, None),
    ]
    got = [(r.type, r.caption if r.type in ("figure", "table") else r.text) for r in X.attach_captions(frame(spark, blocks)).orderBy("pos").collect()]
    assert got == [("figure", "one"), ("figure", "two"), ("text", "gap"), ("table", "three"), ("text", "gap"), ("text", "gap"), ("figure", "own"), ("figure", "own"), ("text", "end")]


def test_passages_match_a_plain_packer(spark):
    """All pages of the smallest tables, cut into small passages, against sentences laid one after another by hand."""
    import re

    from tideline.operators import blocks as B
    from tideline.operators import chunking as C

    limits = C.Limits(max_tokens=60)
    pages = B.html_blocks(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    got = {}
    for r in C.chunk_documents(pages.selectExpr("cast(page_id as string) doc_id", "title", "blocks"), limits).collect():
        got.setdefault(r.doc_id, []).append((r.seq, r.body, r.token_count, r.oversized))
    size = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    several = 0
    for page in pages.collect():
        said = [s for b in page.blocks if b.type in ("text", "list_item") for s in C.sentences(b.text)]
        room, want, k, last = 60 - size(page.title or ""), [], 0, None
        while k < len(said):
            body = []
            if last is not None and size(last) + size(said[k]) <= room:
                body.append(last)
            own = 0
            while k < len(said) and sum(map(size, body)) + size(said[k]) <= room:
                body.append(said[k])
                k, own = k + 1, own + 1
            if own:
                want.append((" ".join(body), False))
                last = said[k - 1]
                continue
            held = []  # a sentence beyond the limit, by words
            for w in said[k].split():
                if held and sum(map(size, held)) + size(w) > room:
                    want.append((" ".join(held), False))
                    held = []
                if size(w) > room:
                    want.append((w, True))
                else:
                    held.append(w)
            if held:
                want.append((" ".join(held), False))
            last, k = want[-1][0], k + 1
        mine = sorted(got.get(str(page.page_id), []))
        assert [(b, o) for _, b, _, o in mine] == want and [s for s, *_ in mine] == list(range(len(mine)))
        assert all(n == size(page.title or "") + size(b) and (o or n <= 60) for _, b, n, o in mine)
        several += len(mine) > 3
    assert several > 10
