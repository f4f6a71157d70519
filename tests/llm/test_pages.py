"""HTML extraction: wrappers of a host, broken markup, and what is left out."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tideline.llm import wrappers

PAGE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Menu {0}</a></li><li><a href=y>b</a></li></ul></nav>'
    '<div class="ad">Buy {0}</div><article><h1>Head {0}</h1><p>One &amp; {0}<p>two <b>bold</b>er<br>end</p>{1}<p>Share this with all</p></article><footer>&copy; f</footer>'
)


def test_extract_leaves_furniture_out():
    text = wrappers.extract(PAGE.format(7, '<div class="comments"><p>nope</p></div><form>q</form><aside>s</aside>'))
    assert text == "Head 7 One & 7 two bolder end Share this with all"
    assert wrappers.extract(None) == wrappers.extract("") == "" and wrappers.extract("just text") == "just text"
    assert wrappers.extract("<article><p>cut off in a tag<p class='x") == "cut off in a tag"


def compiled(pages):
    return json.dumps(wrappers.compiled(wrappers.infer(pages)))


def test_wrapper_has_repeats_options_and_slots():
    w = wrappers.expression(wrappers.infer([PAGE.format(k, f"<ul><li>a{k}</li><li>b</li></ul>" if k % 2 else "") for k in range(6)]))
    assert "(<ul>(<li>text</li>)+</ul>)?" in w and "<h1>#PCDATA</h1>" in w and "?" in w and "Menu" not in w


def test_same_pages_are_no_template():
    page = PAGE.format(1, "")
    w = compiled([page] * 8)
    assert w == "[]" and wrappers.extract(page, w).endswith("Share this with all")
    near = [page.replace("two", f"two {k}") for k in range(8)]
    assert "Share this with all" in wrappers.extract(near[0], compiled(near))


def words(k, n):
    return " ".join(f"w{(k * 31 + j * 7) % 97}x{j}" for j in range(n))


def test_template_text_of_a_host_goes():
    pages = [PAGE.format(f"{k} {words(k, 40)}", "") for k in range(9)]
    alone = wrappers.extract(pages[3])
    assert alone.endswith("end Share this with all") and wrappers.extract(pages[3], compiled(pages)) == alone.removesuffix(" Share this with all").replace(" two bolder end", " bold")
    assert wrappers.extract(pages[3], compiled(pages[:3])) == alone


OPAQUE = (
    "<html><body><div class=a1><a href=/>Home {0}</a> <a href=/b>B</a></div><div class=q9>Sale of {0} things</div>"
    '<div class=zz><div class=k3><h1>T{0}</h1><p>{1}</p><div class=r4><a href=1>see {0}</a> <a href=2>and {0}</a></div><p>{2}</p><p>{3}</p></div></div>'
    "<div class=c7><p>user {0} says hm</p></div><div class=f2>All rights</div></body></html>"
)


def test_opaque_names_are_read_by_the_wrapper():
    pages = [OPAQUE.format(k, words(k, 30), words(k + 1, 25), words(k + 2, 20)) for k in range(9)]
    want = f"T4 {words(4, 30)} {words(5, 25)} {words(6, 20)}"
    assert wrappers.extract(pages[4]) != want
    assert wrappers.extract(pages[4], compiled(pages)) == want
    # A page that the host's wrapper was not made from, with a part more.
    more = OPAQUE.format(40, words(40, 30), words(41, 25) + "</p><ul><li>one</li><li>two</li></ul><p>", words(42, 20))
    assert wrappers.extract(more, compiled(pages)) == f"T40 {words(40, 30)} {words(41, 25)} one two {words(42, 20)}"
    # Two layouts of one host.
    both = pages + [PAGE.format(f"{k} {words(k, 40)}", "") for k in range(8)]
    assert wrappers.extract(both[10], compiled(both)).startswith("Head 1 w31x0")


def test_teasers_are_not_the_article():
    page = "<body><div class=x><article><h2><a href=z>other {0}</a></h2></article></div><div class=y><article><h1>H{0}</h1><p>{1}</p></article></div></body>"
    pages = [page.format(k, words(k, 60)) for k in range(6)]
    assert wrappers.extract(pages[2], compiled(pages)) == f"H2 {words(2, 60)}" and wrappers.extract(pages[2]).startswith("other 2")


def test_names_drop_nothing_that_holds_the_article():
    body = f"<article><h1>h</h1><p>{words(1, 30)}</p></article>"
    for name in ("layout has-sidebar", "no-ads content", "sidebar", "site-header"):
        assert wrappers.extract(f'<body><nav><a href=x>m</a></nav><div class="{name}">{body}</div></body>') == f"h {words(1, 30)}", name
    assert wrappers.extract(f"<body><form id=f>{body}</form></body>") == f"h {words(1, 30)}"
    for name in ("side-note", "post-tags-intro", "headerless", "comment-on-method"):
        assert wrappers.extract(f'<article><h1>h</h1><p class="{name}">a</p></article>') == "h a", name
    for name in ("sidebar", "siteFooter", "comment-list", "reader-comments", "ad-banner-top", "related-posts", "cookie_notice"):
        assert wrappers.extract(f'<article><h1>h</h1><p>{words(1, 30)}</p><div class="{name}">a<article>b</article></div></article>') == f"h {words(1, 30)}", name
    assert wrappers.extract("<article><header><h1>h</h1></header><p>a</p></article>") == "h a"


def test_orders_without_end_make_a_bounded_wrapper():
    rng = __import__("random").Random(1)
    part = lambda k: rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", '<div class="css-{}">x</div>', "<div class=n{}q{}>y</div>"]).format(chr(97 + k % 26) * 3, rng.random())
    pages = [f"<body><article><h1>{k}</h1>" + "".join(part(rng.randrange(999)) for _ in range(rng.randrange(5, 200))) + "</article><footer>f</footer></body>" for k in range(150)]
    whole = wrappers.infer(pages)
    assert len(json.dumps(whole.row())) < 8000
    assert wrappers.extract(pages[7], json.dumps(wrappers.compiled(whole))) == wrappers.extract(pages[7])


def test_tasks_and_their_order_give_one_wrapper():
    pages = [OPAQUE.format(k, words(k, 30), words(k + 1, 25), words(k + 2, 20)) for k in range(12)]
    import pandas as pd

    parts = [json.dumps(wrappers.infer(pages[k::3]).row()) for k in range(3)]
    assert wrappers.compiled(wrappers._merged(pd.Series(parts))) == wrappers.compiled(wrappers._merged(pd.Series(parts[::-1]))) == wrappers.compiled(wrappers.infer(pages))


def test_pages_table(spark):
    deep = "<article>" + "<div>" * 5000 + "deep" + "</article>"
    rows = [(k, f"http://h{k % 2}.example.com/{k}", PAGE.format(k, "")) for k in range(9)] + [(20, None, PAGE.format(20, "")), (21, "http://x.example/", None), (22, "bad url", ""), (1, "http://h1.example.com/1", PAGE.format(1, "")), (23, "http://d.example/", deep)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = wrappers.main_texts(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert next(r.text for r in out if r.page_id == 3).startswith("Head 3 One & 3 two bolder end")
    assert next(r.text for r in out if r.page_id == 21) == "" and next(r.text for r in out if r.page_id == 23) == "deep"
    assert wrappers.main_texts(df.limit(0)).count() == 0


def test_only_attributes_mark_what_is_left_out():
    kept = [
        '<div style="overflow:hidden">a</div>', '<p title="A hidden gem">a</p>', '<p data-role="banner">a</p>', '<p><a href="/p?id=menu">a</a></p>', "<p><a href=/p?id=menu>a</a></p>",
        '<div class="content no-sidebar">a</div>', '<p data-x="role=banner class=ad">a</p>',
    ]
    for block in kept:
        assert wrappers.extract(f"<article><h1>h</h1>{block}</article>") == "h a", block
    gone = ['<div hidden>a</div>', "<div class='x' hidden=hidden>a</div>", '<div aria-hidden = "true">a</div>', '<p ROLE="note banner">a</p>', "<p id=sidebar-2>a</p>", '<p class="post site-footer">a</p>']
    for block in gone:
        assert wrappers.extract(f"<article><h1>h</h1>{block}</article>") == "h", block


def test_a_place_is_not_left_out_for_its_neighbour():
    page = '<article><h1>h{0}</h1><div role="complementary">aside {0}</div><p>p{0}</p><div>content {0}</div></article>'
    assert wrappers.extract(page.format(9), compiled([page.format(k) for k in range(8)])) == "h9 p9 content 9"


def test_the_table_is_read_by_wrappers_of_all_its_pages(spark):
    """Against the same inference on one machine; a hot host over many tasks, copies, a very long page, no url."""
    long = f"<article><h1>long</h1>{''.join(f'<p>{words(k, 50)}</p>' for k in range(4000))}</article>"
    rows = [(k, f"http://hot.example/{k}", OPAQUE.format(k, words(k, 30), words(k + 1, 25), words(k + 2, 20))) for k in range(60)]
    rows += [(100 + k, "http://hot.example/0", rows[0][2]) for k in range(20)] + [(200, "http://l.example/", long), (201, None, "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("wrapper", F.lit(1)).repartition(7)
    got = {r.page_id: r.text for r in wrappers.main_texts(df).collect()}
    w = compiled([r[2] for r in rows[:60]])
    assert got == {i: wrappers.extract(h, w if u and "hot" in u else None) for i, u, h in rows}
    assert got[5] == f"T5 {words(5, 30)} {words(6, 25)} {words(7, 20)}" and len(got[200].split()) == 200001


def test_copies_are_no_evidence_however_they_lie(spark):
    """Three pages of a host and twelve copies of a fourth, in one task and in eight: the same texts, those of four pages."""
    rows = [(k, f"http://few.example/{k}", PAGE.format(f"{k} {words(k, 40)}", "")) for k in range(3)] + [(10 + k, "http://few.example/x", PAGE.format(f"9 {words(9, 40)}", "")) for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    w = compiled([r[2] for r in rows[:4]])
    want = {i: wrappers.extract(h, w) for i, _, h in rows}
    for dealt in (df.coalesce(1), df.repartition(8), df.repartition(3, "page_id")):
        assert {r.page_id: r.text for r in wrappers.main_texts(dealt).collect()} == want
    assert wrappers.learn_wrappers(df).count() == 1 and wrappers.learn_wrappers(df.filter("page_id > 0")).count() == 0
