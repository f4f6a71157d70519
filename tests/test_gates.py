"""Gates, chart artefacts and landed files on fixtures with every refusal."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tideline.operators import gates as W
from tideline.plans import artefacts as P
from tideline.plans import chartspec
from tideline.sources import landing


def test_retrieval_gate(spark):
    schema = "query int, item string, source_type string, score double"
    rows = [(1, "a", "evidence", 0.9), (1, "b", "evidence", 0.3), (1, "c", "evidence", 0.2), (2, "a", "evidence", 0.4), (3, "a", "evidence", 0.8), (3, "b", "evidence", 0.8)]
    queries = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4)], "query int")
    good = W.checked_candidates(spark.createDataFrame(rows, schema), ["evidence"])
    out = {r.query: r for r in W.served(queries, good, 2, 0.5).collect()}
    assert {q: (r.outcome, r.top_score, r.partial_support, [p["item"] for p in r.passages]) for q, r in out.items()} == {
        1: ("passages", 0.9, True, ["a", "b"]), 2: ("refusal", 0.4, False, []), 3: ("passages", 0.8, False, ["a", "b"]), 4: ("refusal", 0.0, False, []),
    }
    assert [p["clears"] for p in out[1].passages] == [True, False]
    open_ = {r.query: (r.outcome, r.partial_support) for r in W.served(queries, good, 2).collect()}
    assert open_ == {1: ("passages", False), 2: ("passages", False), 3: ("passages", False), 4: ("refusal", False)}
    for bad in ((1, "x", "voices", 0.5), (1, "x", None, 0.5), (1, "x", "evidence", float("nan")), (1, "x", "evidence", float("inf")), (1, "x", "evidence", None)):
        with pytest.raises(Exception, match="candidate x"):
            W.checked_candidates(spark.createDataFrame([*rows, bad], schema), ["evidence"]).collect()


def test_sources_show_no_more_than_they_may(spark):
    schema = "answer int, place int, doc_id string, chunk_id string, title string, attribution string, url string, source_type string, context string, body string"
    contexts = ["open", "non-commercial-educational", "permission-on-file", "OPEN", None, "x"]
    rows = [(1, k, f"d{k}", f"c{k}", "" if k % 2 else "T", None if k == 3 else "A", None, "evidence", c, "w" * 1000) for k, c in enumerate(contexts)] + [(1, 9, "d9", "c9", None, None, None, None, "open", None), (1, 10, "d10", "c", "t", "a", "u", "voices", "open", "short")]
    entries = W.sources_event(spark.createDataFrame(rows, schema).repartition(3)).first().sources
    assert [e["tier"] for e in entries] == ["A", "B", "C", None, None, None, "A", "A"] and [e["title"] for e in entries] == ["T", "A", "T", "d3", "T", "A", "d9", "t"]
    assert [e["excerpt"] and len(e["excerpt"]) for e in entries] == [600, 300, 300, None, None, None, "", 5] and [e["truncated"] for e in entries] == [True] * 3 + [False] * 5
    assert all("w" * 601 not in json.dumps(e.asDict()) for e in entries)


def test_document_blocks_are_bounded(spark):
    schema = "answer int, place int, chunk_id string, header string, source_type string, consensus string, backend string, degraded boolean, review boolean, attribution string, body string"
    df = spark.createDataFrame([(1, 2, "c2", "h", "e", None, "html", True, None, "A", "B2"), (1, 1, "c1", "h", "e", "maj", "pdf", None, True, "A", "B1")], schema)
    docs = W.document_blocks(df, 2).first().documents
    assert [d["text"] for d in docs] == ["B1", "B2"] and docs[1]["context"].split("\n")[3:] == ["consensus_position: ", "parse_backend: html", "degraded_fallback: true", "needs_hand_review: false"]
    with pytest.raises(Exception, match="beyond 1"):
        W.document_blocks(df, 1).collect()


def test_addresses_and_words(spark):
    dois = ["10.1000/a b", "10.1000/a;b<c>#d?e=f&g*~(h)[i]é", "10.12/x", "x", None, "10.1234/plain"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(dois)), "k int, d string").orderBy("k").select(W.quoted_doi(F.col("d"))).collect()]
    ok = [d for d in dois if d and " " not in d and d.startswith("10.1") and d.index("/") > 6]
    assert got == [urllib.parse.quote(d, safe="/") if d in ok else None for d in dois]
    urls = {"https://a": True, "HTTPS://a": True, "http://a": False, "file:///https://a": False, "": False, "a": False}
    assert {r[0]: r[1] is not None for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", W.https_only(F.col("u"))).collect()} == urls
    signs = [("Ann Lee", "looked at the licence page", True), ("y", "looked at the licence page", False), ("OK", "looked at the licence page", False), ("Ann", "short", False), ("a considered sign-off", "a considered sign-off", False), (None, None, False), ("  Bo ", " checked the site today ", True)]
    assert [r[0] for r in spark.createDataFrame(signs, "w string, n string, g boolean").select(W.plausible_signoff(F.col("w"), F.col("n"))).collect()] == [g for *_, g in signs]
    for text, want in (("a\nowner_severity_audit: complete 2026\n", "complete"), ("owner_severity_audit: pending", "pending"), ("owner_severity_audit: done", None), (" owner_severity_audit: complete", None), (None, None)):
        df = spark.createDataFrame([(text,)], "t string").select(W.audit_status(F.col("t")).alias("s"))
        if want:
            assert df.first().s == want
        else:
            with pytest.raises(Exception, match="owner_severity_audit"):
                df.collect()


def test_calibrations_are_strict(spark, tmp_path):
    at = f"file://{tmp_path}"
    W.write_calibration(spark, f"{at}/good.json", 0.25, ["a", "b"])
    W.write_calibration(spark, f"{at}/good.json", 0.5, ["a"])
    assert W.read_calibration(spark, f"{at}/good.json") == (0.5, ["a"])
    good = {"schema_version": 1, "threshold": 0.5, "calibration_item_ids": ["a"]}
    bad = ["", "[]", "{", *(json.dumps(good | c) for c in ({"schema_version": 2}, {"threshold": 0}, {"threshold": 1.0}, {"threshold": float("nan")}, {"threshold": True}, {"threshold": "0.5"}, {"calibration_item_ids": "ab"}, {"calibration_item_ids": [1]})), '{"schema_version": 1}']
    for k, text in enumerate(bad):
        (tmp_path / f"bad{k}.json").write_text(text)
        with pytest.raises(W.GateError):
            W.read_calibration(spark, f"{at}/bad{k}.json")
    with pytest.raises(W.GateError):
        W.read_calibration(spark, f"{at}/none.json")
    assert W.index_version(spark.createDataFrame([("v1",), ("v1",)], "corpus_version string")) == "v1"
    for rows in ([], [("a",), ("b",)], [(None,)]):
        with pytest.raises(W.GateError):
            W.index_version(spark.createDataFrame(rows, "corpus_version string"))
    W.gold_snapshot(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "chunk_id string").repartition(3), f"{at}/snap")
    assert [r.value for r in spark.read.text(f"{at}/snap").collect()] == ["a", "b"]


def test_landing_is_all_or_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "PIECE", 7)
    names = [f"f{k}" for k in range(6)]
    for k, n in enumerate(names):
        (tmp_path / n).write_bytes(bytes(range(k * 40)))
    pin = lambda n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()
    rows = [(n, f"file://{tmp_path}/{n}", f"file://{tmp_path}/to/{n}", pin(n).upper() if n == "f1" else pin(n)) for n in names]
    schema = "name string, source string, target string, sha256 string"
    for k, wrong in enumerate(((*rows[0][:3], "0" * 64), ("gone", f"file://{tmp_path}/gone", f"file://{tmp_path}/to/gone", "1" * 64))):
        with pytest.raises(landing.Mismatch, match=wrong[0]):
            landing.land(spark.createDataFrame([*rows[1:], wrong], schema), f"file://{tmp_path}/journal-{k}")
        assert os.listdir(tmp_path / "to") == []
    done = landing.land(spark.createDataFrame(rows, schema), f"file://{tmp_path}/journal", 2)
    assert sorted(os.listdir(tmp_path / "to")) == names and {r.name: r.bytes for r in done.collect()} == {n: 40 * k for k, n in enumerate(names)}
    # A run that died between moves is finished from its journal.
    os.rename(tmp_path / "to/f2", next(r.copy for r in spark.read.parquet(f"{tmp_path}/journal").collect() if r.name == "f2").removeprefix("file://"))
    landing.finish(spark.read.parquet(f"{tmp_path}/journal"))
    assert sorted(os.listdir(tmp_path / "to")) == names
    seen = {r.name: (r.ok, r.bytes) for r in landing.verified(spark.createDataFrame([(n, str(tmp_path / n), "0" * 64 if n == "f3" else pin(n)) for n in names] + [("none", str(tmp_path / "none"), "0" * 64)], "name string, source string, sha256 string")).collect()}
    assert seen == {n: (n != "f3", 40 * k) for k, n in enumerate(names)} | {"none": (False, 0)}


def test_a_file_beyond_two_gigabytes_is_hashed_in_pieces(spark, tmp_path):
    with open(tmp_path / "big", "wb") as f:
        f.truncate((2 << 30) + 5)  # holds no blocks
    digest = hashlib.sha256()
    for _ in range(256):
        digest.update(bytes(8 << 20))
    digest.update(bytes(5))
    row = landing.verified(spark.createDataFrame([("big", str(tmp_path / "big"), digest.hexdigest())], "name string, source string, sha256 string")).first()
    assert row.ok and row.bytes == (2 << 30) + 5


SETS = {"old": {"unit": "degC_anomaly", "attribution": "Old, Cores", "licence": "cc-by"}, "new": {"unit": "degC_anomaly", "licence": "open"}, "many": {"unit": "degC_anomaly", "entity": "World", "attribution": "Many"}}
SPEC = {
    "type": "line", "title": "t", "x_range": [0, 100],
    "series": [{"id": "joined", "splice": {"paleo": "old", "instrumental": "new", "year": 50}}, {"id": 'a "b", c', "dataset": "many", "transforms": [{"op": "rolling_mean", "window_years": 5}, {"op": "unit_conversion", "to_unit": "degF_anomaly"}]}, {"id": "runs", "dataset": "new", "transforms": [{"op": "resample", "window_years": 7}, {"op": "anomaly_vs_baseline"}]}],
}


@pytest.fixture(scope="module")
def pack(spark):
    rows = [("old", None, float(x), x * 0.25) for x in range(0, 80, 3)] + [("new", None, float(x), (x * 7 % 13) / 4) for x in range(40, 101)] + [("many", e, float(x), x + k * 100.0) for k, e in enumerate(("World", "Other")) for x in range(60) if x != 30]
    return spark.createDataFrame(rows, "dataset string, entity string, x double, value double").repartition(3)


def test_the_second_reckoning_agrees_and_tells_drift(spark, pack, monkeypatch):
    assert not chartspec.violations(SPEC, SETS)
    out = P.faithfulness(SPEC, pack, SETS).collect()
    assert all(r.faithful for r in out) and {(r.series, r.kind) for r in out} == {("joined", "pass_through"), ('a "b", c', "post_transform"), ("runs", "post_transform")}
    assert sum(r.series == "joined" for r in out) == 17 + 51 and sum(r.series == "runs" for r in out) == 8
    drawn = chartspec.compile_spec(SPEC, pack, SETS)
    moved = drawn.filter("not (series = 'joined' and x = 60)").withColumn("value", F.when((F.col("series") == "joined") & (F.col("x") == 70), F.col("value") + 1e-12).when((F.col("series") == "runs"), F.col("value") * (1 + 1e-9)).otherwise(F.col("value")))
    monkeypatch.setattr(P, "compile_spec", lambda *a: moved.unionByName(drawn.limit(1).select(F.lit("joined").alias("series"), F.lit(99.5).alias("x"), F.lit(1.0).alias("value"), "segment")))
    bad = {(r.series, r.x): (r.expected, r.actual) for r in P.faithfulness(SPEC, pack, SETS).filter("not faithful").collect()}
    assert set(bad) == {("joined", 60.0), ("joined", 70.0), ("joined", 99.5)} and bad["joined", 60.0][1] == float("inf") == bad["joined", 99.5][0]


def test_chart_files_carry_their_captions(spark, pack, tmp_path):
    pairs = {"old/new": {"note": " Cores after 50 are left out. ", "disclosure": ""}}
    P.write_csv(SPEC, pack, SETS, f"file://{tmp_path}/chart", "2026-01-02", "https://x.example", pairs=pairs)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "chart").glob("part-*"))).split("\n")
    assert lines[:5] == ["# Data: Old, Cores — cc-by", "# Data: new — open", "# Data: Many — ", "# Entity shown: World (not all entities in this source)", "# Cores after 50 are left out."]
    assert lines[5].startswith("# Accessed 2026-01-02 · https://x.example · ChartSpec ") and lines[6] == 'year_ce,joined,"a ""b"", c",runs'
    x = [float(r.split(",")[0]) for r in lines[7:] if r]
    assert x == sorted(x) and lines[7] == "0.0,0.0,," and next(r for r in lines[7:] if r.startswith("60.0,")).endswith(",,")
    short = P.caption_lines(SPEC, SETS, "d", "s", short=True, pairs=pairs)
    assert short[:4] == ["Data: Old, Cores", "Data: new", "Data: Many", "Entity shown: World (not all entities in this source)"] and len(short) == 5


def test_a_chart_is_a_document_with_named_data(spark, pack, tmp_path):
    spec = SPEC | {"series": [*SPEC["series"][:2], {"id": "raw", "dataset": "new", "transforms": []}], "annotations": [{"x": 20, "text": "here"}]}
    banded = pack.withColumns({"lower": F.when(F.col("dataset") == "new", F.col("value") - 1), "upper": F.when(F.col("dataset") == "new", F.col("value") + 1)})
    assert [v.path for v in chartspec.violations(spec | {"annotations": [{"x": 1}]}, SETS)] == [v.path for v in chartspec.violations(spec | {"annotations": "x"}, SETS)] == ["$.annotations"]
    out = P.artefact(spec, banded, SETS, f"file://{tmp_path}", "2026-01-02", "https://x.example")
    doc = out["document"]
    titles = [axis["layer"][-1]["encoding"]["y"]["title"] for axis in doc["layer"][:2]]
    assert titles == ["degC_anomaly", "degF_anomaly"] and doc["resolve"] == {"scale": {"y": "independent"}} and doc["title"]["subtitle"] == out["captions"]
    assert [layer["data"]["name"] for layer in doc["layer"][0]["layer"]] == ["bounds", "points"] and "strokeDash" in doc["layer"][0]["layer"][1]["encoding"] and "strokeDash" not in doc["layer"][1]["layer"][0]["encoding"]
    assert doc["layer"][0]["layer"][0]["transform"] == [{"filter": {"field": "series", "oneOf": ["raw"]}}] and doc["layer"][2]["data"]["values"] == [{"x": 50, "text": ""}, {"x": 20, "text": "here"}]
    points = spark.read.json(f"file://{tmp_path}/points").collect()
    assert len(points) == chartspec.compile_spec(spec, pack, SETS).count() and spark.read.json(f"file://{tmp_path}/bounds").count() == 61
    raw = sorted((r.x, r.value) for r in points if r.series == "raw")
    way = "rises" if raw[-1][1] > raw[0][1] else "falls"
    assert f"raw {way} from {raw[0][1]:g} in 40 to {raw[-1][1]:g} in 100." in out["alt_text"] and out["extents"]["raw"] == (min(v for _, v in raw), max(v for _, v in raw))
    assert out["spec_hash"] == P.artefact(spec | {"_meta": {"a": 1}}, banded, SETS, f"file://{tmp_path}/again", "2026-01-02", "https://x.example")["spec_hash"] and json.dumps(doc)


def test_frames_survive_any_data(spark):
    from tideline.sources.journal import event_frames, event_text

    rows = [(1, "a", "x\ny"), (2, "b", ""), (3, "c\nd", "event: z\r\n\rdata: q"), (4, None, "only data"), (5, "e", None), (6, "f", "\n\n")]
    df = spark.createDataFrame(rows, "id int, event string, data string").withColumn("sent", event_text(F.col("event"), F.col("data")))
    got = {r.id: [(f.event, f.data) for f in r.f] for r in df.select("id", event_frames(F.col("sent")).alias("f")).collect()}
    assert got == {1: [("a", "x\ny")], 2: [("b", "")], 3: [("c d", "event: z\n\ndata: q")], 4: [("", "only data")], 5: [("e", "")], 6: [("f", "\n\n")]}
    assert all(r.sent.endswith("\n\n") and "\n\n" not in r.sent[:-2] for r in df.collect())


def test_items_are_planned_once(spark, tmp_path):
    from tideline.plans import ingest

    items = spark.createDataFrame([(1, None), (2, True), (3, False)], "item int, blocked boolean")
    plan = lambda rows: rows.select("item", F.lit("p").alias("plan"))
    run = lambda some, batch: sorted(r.item for r in ingest.run_items(some, f"file://{tmp_path}/j", plan, "item int, plan string", batch).collect())
    assert run(items.filter("item = 1"), "a") == [1] and run(items, "b") == [1, 3] and run(items, "b") == [1, 3] and run(items, "c") == [1, 3]
