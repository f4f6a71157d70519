"""Boilerplate rails, logs cut anywhere, appends that are tried again, and an ingest that is killed and resumed."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from tideline.operators import blocks as B
from tideline.plans import ingest
from tideline.sources import appends, journal

ROWS = "page_id long, pos int, type string, text string, container string, backend string"


def plain_reasons(rows):
    """The rail as a loop over the blocks of a page."""
    import re

    def label(text):
        text = text or ""
        if re.match(B.RELATED_LABEL, text):
            return "related"
        return "social" if re.match(B.SOCIAL_LABEL, text) and len(text.split()) <= B.LABEL_WORDS else None

    out, rail, page = [], None, object()
    for p, pos, kind, text, container, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        if p != page:
            rail, page = None, p
        own = next((name for pattern, name in B.REASONS if container and re.search(pattern, container)), None)
        if kind in ("title", "heading"):
            rail = why = label(text)
        elif own is None and rail is not None and kind == "list_item":
            why = rail
        else:
            why, rail = own, None
        out.append((p, pos, why))
    return out


PAGE = [
    ("text", "Read all about it.", "site-banner"), ("list_item", "Home", "breadcrumb"), ("list_item", "Topics", "breadcrumb"), ("title", "The basin", None), ("text", "Levels rose by 4 cm.", None),
    ("list_item", "Glaciers lost 14% of their area.", None), ("heading", "Related warming feedbacks", None), ("list_item", "Snow melts.", None), ("heading", "Related", None), ("list_item", "Ten facts", None), ("list_item", "Vital signs", None),
    ("text", "Data are updated quarterly.", None), ("list_item", "Kept: the rail is closed.", None), ("heading", "Follow us", None), ("list_item", "On one site", None), ("list_item", "A menu link", "footer-menu"), ("list_item", "Closed by the menu", None),
    ("heading", "Follow the water from the spring to the sea", None), ("list_item", "Kept too", None), ("heading", "See also", "sidebar"), ("table", "1 2", None), ("list_item", "After a table", None), ("heading", "Related", None), ("list_item", "Consent first", "cookie-bar"), (None, "?", None), ("list_item", "x", None),
    ("text", "We follow the usual practice.", None), ("heading", "Sources", "related-links"), ("list_item", "Kept under a real heading", None),
]


def test_rails_match_a_loop_and_fail_open(spark):
    rows = [(1, k, *b, "html") for k, b in enumerate(PAGE)] + [(2, k, *b, "pdf") for k, b in enumerate(PAGE)] + [(3, 0, "list_item", "On one site", None, "html"), (4, 0, "heading", "Related", None, None), (4, 1, "list_item", "y", None, None)]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = {(r.page_id, r.pos): r.reason for r in B.mark_boilerplate(df).collect()}
    assert got == {(p, k): why for p, k, why in plain_reasons(rows)}
    kept = {t for (_, t, _), (_, _, why) in zip(PAGE, plain_reasons(rows)[: len(PAGE)], strict=True) if why is None}
    assert {"Glaciers lost 14% of their area.", "Related warming feedbacks", "Snow melts.", "Data are updated quarterly.", "Kept: the rail is closed.", "Closed by the menu", "Kept too", "After a table", "x", "Kept under a real heading", "We follow the usual practice."} <= kept
    assert not kept & {"Ten facts", "Vital signs", "On one site", "A menu link", "Home", "Related", "See also", "Consent first"}
    # Other backends pass; what goes and what stays are all blocks, unchanged.
    marked = B.mark_boilerplate(df, backend="backend")
    assert marked.filter("page_id in (2, 4) and reason is not null").count() == 0
    stays, audit = B.without_boilerplate(df, backend="backend"), B.boilerplate_audit(marked).collect()
    assert stays.columns == df.columns and stays.count() + sum(r.dropped for r in audit) == len(rows)
    assert all(r.dropped == len(r.lines) == sum(r[f"n_{x}"] for _, x in B.REASONS) for r in audit) and audit[0].lines[:2] == ["banner: Read all about it.", "breadcrumb: Home"]
    again = B.collected(B.exploded(B.html_blocks(spark.createDataFrame([(1, "<h1>T</h1><p>a<p>b"), (2, "")], "page_id long, html string"))))
    assert [(r.page_id, r.title, [b.text for b in r.blocks]) for r in again.collect()] == [(1, "T", ["T", "a", "b"])]


@pytest.mark.parametrize("size", [40, 10_000])
def test_logs_cut_at_any_byte(spark, tmp_path, size):
    lines = [json.dumps({"id": k, "text": "é" * (k % 7) + "x" * (40 * (k == 3)), "in": {"n": [k]}}, ensure_ascii=False) for k in range(6)]
    whole, want, torn = ("\n".join(lines) + "\n \n").encode(), set(), set()
    for cut in range(0, len(whole) + 1, 3):
        name = f"{cut:04}.jsonl"
        (tmp_path / name).write_bytes(whole[:cut])
        own = [x for x in whole[:cut].decode(errors="replace").split("\n") if x.strip()]
        for k, x in enumerate(own):
            if x in lines:
                want.add((name, json.loads(x)["id"]))
            else:
                assert k == len(own) - 1
                torn.add((name, x))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows, tails = journal.read_log(spark, f"file://{tmp_path}", "id long, text string, in struct<n:array<long>>")
        counted = sum(1 for _ in want)
        assert rows.count() == counted and {r.id for r in rows.collect()} == {i for _, i in want} and rows.columns == ["id", "text", "in"]
        assert {(r.file.rsplit("/", 1)[1], r.line) for r in tails.collect()} == torn and len(torn) > 20
        (tmp_path / "bad.jsonl").write_text(lines[0] + "\n{broken\n" + "\n".join(lines))
        with pytest.raises(Exception, match="before the last"):
            journal.read_log(spark, f"file://{tmp_path}", "id long, text string")[0].collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "empty.jsonl").write_text("")
    rows, tails = journal.read_log(spark, f"file://{tmp_path}/more", "id long")
    assert rows.count() == tails.count() == 0


def test_appends_count_once_and_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = lambda lo, hi: spark.range(lo, hi).withColumn("v", F.col("id") * 2)
    schema = "id long, v long"
    assert appends.read(spark, path, schema).count() == 0
    assert appends.append(rows(0, 10), path, "first", metrics={"even": F.count_if(F.col("id") % 2 == 0), "given": 7})
    assert not appends.append(rows(0, 10), path, "first") and not appends.append(rows(50, 60), path, "first")
    assert sorted(r.id for r in appends.read(spark, path, schema).collect()) == list(range(10))
    # Eight writers of eight batches, and eight of one.
    done = []
    threads = [threading.Thread(target=lambda k=k: done.append(appends.append(rows(100 * k, 100 * k + 5), path, f"w{k}"))) for k in range(1, 9)]
    threads += [threading.Thread(target=lambda: appends.append(rows(5000, 5003), path, "same")) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    want = [*range(10), *(100 * k + j for k in range(1, 9) for j in range(5)), 5000, 5001, 5002]
    assert done == [True] * 8 and sorted(r.id for r in appends.read(spark, path, schema).collect()) == want
    assert appends.read(spark, path, schema, ["w3"]).count() == 5 and appends.totals(spark, path) == {"rows": len(want), "even": 5, "given": 7}
    with pytest.raises(KeyError):
        appends.read(spark, path, schema, ["w99"])
    # A writer that died before its commit is never read; its folder goes when it is old.
    rows(9000, 9009).write.parquet(f"{path}/data/attempt=dead-1")
    assert appends.read(spark, path, schema).count() == len(want)
    assert appends.compact(spark, path, schema, "all") and not appends.append(rows(0, 10), path, "first")
    assert sorted(r.id for r in appends.read(spark, path, schema).collect()) == want and appends.totals(spark, path) == {"rows": len(want), "even": 5, "given": 7}
    assert appends.vacuum(spark, path) == [] and len(appends.vacuum(spark, path, 0)) >= 10 and not appends.compact(spark, path, schema, "again")
    assert sorted(r.id for r in appends.read(spark, path, schema).collect()) == want
    with pytest.raises(ValueError):
        appends.append(rows(0, 1), path, "../x")


def test_logs_refuse_forbidden_names(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    records = spark.createDataFrame([(1, {"a": [{"ip": "1"}]})], "id long, v map<string,array<struct<ip:string>>>")
    with pytest.raises(ValueError, match="ip"):
        journal.append_log(records, path, "one", {"ip"})
    assert not (tmp_path / "log").exists()
    assert journal.append_log(records, path, "one") and not journal.append_log(records, path, "one")
    assert journal.read_appended_log(spark, path, "id long, v map<string,array<struct<ip:string>>>").collect() == records.collect()


def page(k):
    items = "".join(f"<li>Point {j} of {k} holds.</li>" for j in range(3))
    return f'<html><body><h1>Page {k}</h1><p>The level of basin {k} rose by {k} cm. It fell again.</p><h2>Related</h2><ul>{items}</ul><h2>Results</h2><ul>{items}</ul><div class="footer"><p>About us</p></div></body></html>'


@pytest.fixture()
def source(spark, tmp_path):
    rows = [(k, page(k)) for k in range(20)] + [(None, page(99)), (21, ""), (22, None), (23, "year,value\n1,2"), (24, "<html><body></body></html>"), (25, page(25)), (25, page(26)), (3, page(3)), (27, "<html><h2>Related</h2><ul><li>x</ul>")]
    spark.createDataFrame(rows, "page_id long, html string").repartitionByRange(6, F.coalesce("page_id", F.lit(-1))).write.parquet(f"{tmp_path}/pages")
    return f"file://{tmp_path}/pages"


def everything(spark, out):
    return [sorted(map(repr, f(spark, out).collect())) for f in (ingest.documents, ingest.blocks, ingest.chunks)]


def test_ingest_is_the_same_after_being_killed_anywhere(spark, tmp_path, source, monkeypatch):
    config = ingest.Config(files_per_batch=2)
    record = ingest.ingest(spark, source, f"file://{tmp_path}/whole", config)
    want = everything(spark, f"file://{tmp_path}/whole")
    of = {(r.page_id, r.content): r for r in ingest.documents(spark, f"file://{tmp_path}/whole").collect()}
    why = sorted((str(r.page_id), r.reason) for r in of.values() if r.status == "quarantined")
    assert why == sorted([("None", "no id"), ("21", "no content"), ("23", "no html"), ("24", "nothing in it"), ("25", "another content of this id"), ("27", "no passage"), ("22", "no content")])
    assert record["documents_ingested"] == 21 and record["documents_quarantined"] == 7 and record["documents_rows"] == 28 == len(of)
    assert record["blocks_dropped"] == sum(r.n_dropped for r in of.values()) and record["chunks_rows"] == len(want[2]) > 0
    three = next(r for r in of.values() if r.page_id == 3)
    assert (three.n_blocks, three.n_dropped) == (11, 5)
    # Killed before any of its appends, or between an append's rows and its commit.
    out = f"file://{tmp_path}/killed"
    real, calls, torn = appends.append, {"n": 0}, []

    def failing(at):
        def put(df, path, batch, *a, **k):
            calls["n"] += 1
            if calls["n"] == at:
                df.write.parquet(f"{path}/data/attempt=torn-{len(torn)}")
                torn.append(at)
                raise RuntimeError("killed")
            return real(df, path, batch, *a, **k)

        return put

    for at in (1, 2, 3, 2, 3):
        calls["n"] = 0
        monkeypatch.setattr(appends, "append", failing(at))
        with pytest.raises(RuntimeError):
            ingest.ingest(spark, source, out, config)
        monkeypatch.setattr(appends, "append", real)
    assert ingest.ingest(spark, source, out, config) == record and everything(spark, out) == want
    # Nothing is done again; pages that are new are added, known ones are not.
    monkeypatch.setattr(ingest, "_batch", lambda *a: pytest.fail("a committed batch was run"))
    assert ingest.ingest(spark, source, out, config) == record
    monkeypatch.undo()
    more = spark.createDataFrame([(3, page(3)), (4, page(400)), (500, page(500))], "page_id long, html string")
    more.coalesce(1).write.parquet(f"{tmp_path}/more")
    after = ingest.ingest(spark, f"file://{tmp_path}/more", out, config)
    assert after["documents_rows"] == record["documents_rows"] + 2 and after["documents_ingested"] == record["documents_ingested"] + 2


def test_a_gate_refuses_before_anything_is_written(spark, tmp_path, source):
    gate = lambda rows: rows.filter("page_id is null").select(F.lit("a page without an id").alias("violation"))
    with pytest.raises(ingest.Refused, match="without an id"):
        ingest.ingest(spark, source, f"file://{tmp_path}/out", ingest.Config(gate=gate))
    assert not (tmp_path / "out").exists()
