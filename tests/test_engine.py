"""Readers, chart plans, packers, blocks, text functions and streams on small made-up inputs."""

from __future__ import annotations

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tideline.functions import canonical
from tideline.functions import text as T
from tideline.operators import blocks as B
from tideline.operators import chunking as C
from tideline.operators import evaluation as E
from tideline.operators import retrieval as R
from tideline.operators import series as S
from tideline.plans import chartspec
from tideline.sources import journal, series_files
from tideline.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_series_files(spark, tmp_path):
    head = "Year Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec J-D D-N DJF MAM JJA SON".split()
    row = lambda y, v: ",".join([str(y)] + ["0"] * 12 + [v] + ["0"] * 5)
    (tmp_path / "g.csv").write_text("Land-Ocean\n" + ",".join(head) + "\n" + row(2001, ".5") + "\n" + row(2000, "***") + "\n" + row(1999, "-.1") + "\n")
    assert [tuple(r) for r in series_files.gistemp(spark, f"file://{tmp_path}/g.csv").collect()] == [(1999, -0.1), (2001, 0.5)]
    (tmp_path / "b.txt").write_bytes("﻿# a\r\n# b\r\nage_gas_calBP\tco2_ppm\tco2_1s_ppm\r\n300\t280.5\t1\r\n-50\t368\t1\r\n".encode())
    assert [tuple(r) for r in series_files.bereiter(spark, f"file://{tmp_path}/b.txt").collect()] == [(-50.0, 368.0), (300.0, 280.5)]
    (tmp_path / "o.csv").write_text("country,year,iso_code,population,gdp,cement_co2,co2,co2_per_capita\nB,2001,B,1,1,1,,1\nA,2000,A,1,1,1,3.5,1\n")
    assert [tuple(r) for r in series_files.owid(spark, f"file://{tmp_path}/o.csv").collect()] == [("A", 2000, "A", 3.5)]
    with pytest.raises(series_files.SourceError):
        series_files.gml_co2(spark, f"file://{tmp_path}/o.csv")
    with pytest.raises(series_files.SourceError):
        series_files.reader("nothing")


def test_series_refusals_and_windows(spark):
    df = spark.createDataFrame([("a", float(k), float(k * k)) for k in range(9)] + [("a", 20.0, 1.0)], "series string, x double, value double")
    assert [r.x for r in S.rolling_mean_complete(df, 3).orderBy("x").collect()] == [float(k) for k in range(1, 8)]
    assert S.resample_rows(df, 4).count() == 2
    for wrong in (lambda: S.resample_rows(df, 0), lambda: S.convert_units(df, "a", "b"), lambda: S.splice(df, df.filter("x < 0"), 3, check=True)):
        with pytest.raises(S.SeriesError):
            wrong()
    with pytest.raises(Exception, match="no value"):
        S.rebaseline(df, 100, 200).collect()
    with pytest.raises(Exception, match="repeats a key"):
        S.outer_merge({"p": df.unionByName(df)}).collect()


def test_chart_spec(spark):
    pack = spark.createDataFrame([("d", None, float(k), float(k)) for k in range(1990, 2010)] + [("p", None, float(k), 1.0) for k in range(1900, 1995)], "dataset string, entity string, x double, value double")
    data = {"d": {"unit": "degC_anomaly"}, "p": {"unit": "degC_anomaly"}}
    spec = {"id": "c", "type": "line", "series": [{"id": "s", "dataset": "d", "transforms": [{"op": "rolling_mean", "window_years": 5}, {"op": "unit_conversion", "to_unit": "degF_anomaly"}]}], "x_range": [1995, 2000]}
    rows = chartspec.compile_spec(spec, pack, data).orderBy("x").collect()
    assert [(r.x, round(r.value, 6)) for r in rows] == [(float(y), round(y * 1.8, 6)) for y in range(1995, 2001)]
    joined = {"id": "c", "type": "line", "series": [{"id": "s", "splice": {"paleo": "p", "instrumental": "d", "year": 1992}}]}
    assert chartspec.compile_spec(joined, pack, data).count() == 92 + 18
    art = chartspec.render(spec, pack, data)
    assert art["alt_text"].startswith("s rises") and art["spec_hash"] == chartspec.render(spec | {"_meta": {"a": 1}}, pack, data)["spec_hash"]
    bad = {"id": "c", "type": "pie", "other": 1, "series": []}
    assert {v.path for v in chartspec.violations(bad, data)} == {"$.type", "$.other", "$.series"}
    wrong = spec | {"series": [{"id": "s", "dataset": "d", "transforms": [{"op": "resample", "window_years": 0.5}, {"op": "unit_conversion", "to_unit": "x"}, {"op": "zip"}]}, {"id": "s", "dataset": "none"}]}
    assert len(chartspec.violations(wrong, data)) == 5
    with pytest.raises(chartspec.SpecError):
        chartspec.parse('{"x_range": [NaN, 1]}')


def test_text_functions(spark):
    assert one(spark, T.normalise_text(F.lit("tempera-\nture of the oﬃce"))) == "temperature of the office"
    assert one(spark, T.split_sentences(F.lit("See Fig. A now. It rose by 1.5 mm! Dr. Who agreed. "))) == ["See Fig. A now.", "It rose by 1.5 mm!", "Dr. Who agreed."]
    assert one(spark, T.strip_note_markers(F.lit("considerably more.67 In just. 24 stations, see Fig. 2 Here"))) == "considerably more. In just. 24 stations, see Fig. 2 Here"
    assert one(spark, T.note_markers(F.lit("considerably more.67 In"))) == ["67"]
    assert one(spark, T.confidence_markers(F.lit('It is very likely, not likely, "virtually certain", unlikely and of High confidence'))) == ["very likely", "unlikely", "high confidence"]
    assert one(spark, T.veto_profile(F.lit("Isn't it? It will NOT"))) == ["is", "not", "will"]
    assert one(spark, T.hmac_sha256(F.lit("1.2.3.4"), b"salt")) == hmac.new(b"salt", b"1.2.3.4", hashlib.sha256).hexdigest()
    assert one(spark, T.two_figures(F.lit(0.01849), "low")) == 0.018 and one(spark, T.two_figures(F.lit(1234.0), "high")) == 1300
    assert one(spark, T.licence_of_url(F.lit("https://creativecommons.org/licenses/by-nc-sa/4.0/"))) == "cc-by-nc-sa"
    assert one(spark, T.statement_licence(F.lit("Creative Commons Attribution-NonCommercial-NoDerivs"))) == "cc-by-nc-nd"
    assert one(spark, T.client_ip(F.lit("9.9.9.9"), F.lit("1.1.1.1, 2.2.2.2"), F.lit(True))) == "1.1.1.1"
    assert one(spark, T.decline(F.lit("NO_ANSWER\nsorry"), "NO_ANSWER")).asDict() == {"declined": True, "text": "sorry"}
    assert one(spark, T.bounded_excerpt(F.lit("x"), F.lit("unknown"))) is None
    assert one(spark, T.count_tokens(F.lit("Größe, ja!"))) == 4
    spans = one(spark, T.sentence_spans(F.lit("Aa. Aa. B."), F.array(F.lit("Aa."), F.lit("Aa."), F.lit("B."))))
    assert [(s.start, s.end) for s in spans] == [(0, 3), (4, 7), (8, 10)]


def test_more_text_functions(spark):
    assert one(spark, T.chart_slug(F.lit(" CO2_level, (ppm) -- x "))) == "co2-level-ppm-x"
    assert [one(spark, T.degenerate(F.lit(t))) for t in ("café 5 °C – CO₂", "ＧＩＳ", "a\ufeff", "𝐀bc")] == [False, True, True, True]
    assert one(spark, T.tokens_at_least(F.lit("-" * 400 + "abcd" * 4))) == 4
    fields = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("3"))
    assert one(spark, T.differing_fields(*fields, ["a", "b", "c"])) == ["b", "c"]
    assert one(spark, T.verdict_of(F.lit("no json"), "verdict string"))["verdict"] is None


def test_canonical_hash(spark):
    assert canonical.digest('{"b": 2.0, "a": [1], "_meta": {}}', frozenset({"_meta"})) == canonical.digest('{"a":[1],"b":2}')
    with pytest.raises(ValueError):
        canonical.digest('{"a": NaN}')
    assert one(spark, canonical.request_hash(F.lit('{"Authorization": "x", "q": 1}'))) == canonical.digest('{"q":1}')


def test_packer_limits_and_overlap():
    limits = C.Limits(max_tokens=12)
    p = C.Packer("h", limits)
    bodies = p.prose(["One two three four.", "Five six seven.", "Eight nine ten eleven twelve.", " ".join(["w"] * 30)])
    assert all(C.count("h") + C.count(b) <= 12 or f for b, f in bodies)
    assert bodies[1][0].startswith("Five six seven.") and bodies[0][0].endswith("Five six seven.")
    assert sum(b.split().count("w") for b, _ in bodies) == 30
    table = p.table("a b\nc d e f g\nh i j k l m n", "cap")
    assert all(b.startswith("a b") for b, _ in table[:2])
    chunks = list(C.chunks_of("d", "T", [{"type": "heading", "text": "H", "level": 1}, {"type": "text", "text": "Same. "}, {"type": "figure", "text": "[FIGURE]"}, {"type": "text", "text": "Same."}], C.Limits()))
    assert [c["body"] for c in chunks] == ["Same.", "Same."] and len({c["chunk_id"] for c in chunks}) == 2 and chunks[0]["section_path"] == ["H"]


def test_blocks(spark):
    page = '<nav><p>no</p></nav><h1>T</h1><h2>A</h2><p>x &amp; y</p><div class="cookie-bar"><p>c</p></div><h3>B</h3><ul><li>l</ul><table><tr><td>1<td>2</table><h2>References</h2><p>r</p>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    kept = B.html_blocks(df)
    assert kept.filter("page_id = 2").first()["blocks"] == []
    rows = B.exploded(kept)
    audit = B.boilerplate_audit(B.mark_boilerplate(rows)).first().asDict()
    assert {k: v for k, v in audit.items() if v} == {"page_id": 1, "dropped": 1, "n_cookie": 1, "lines": ["cookie: c"]}
    rows = B.without_boilerplate(rows)
    paths = {r.text: r.path for r in B.section_paths(rows).collect()}
    assert paths["x & y"] == ["A"] and paths["l"] == ["A", "B"] and paths["r"] == ["References"]
    refs = {r.text: r.reference for r in B.split_references(rows).collect()}
    assert refs["r"] and not refs["l"]
    assert B.mark_furniture(rows).filter("type = 'page_furniture'").count() == 0


def test_gates_on_empty_and_edge(spark):
    none = spark.createDataFrame([], "refused boolean, judged int, gold int")
    assert E.refusal_gate(none, F.col("refused")).first().status == "failed"
    assert E.false_refusal_gate(none, F.col("refused")).first().status == "passed"
    assert E.severity_gate(none).first().status == "failed"
    exact = spark.createDataFrame([(k < 18,) for k in range(20)], "refused boolean")
    assert E.refusal_gate(exact, F.col("refused")).first().status == "failed"


def test_window_bounds(spark):
    def want(n, b):
        if n <= b:
            return [(0, n)]
        out, at = [], 0
        while at + b < n:
            out.append((at, at + b))
            at += b
        return [*out, (n - b, n)]

    for n in (0, 1, 10, 11, 20, 21, 25, 100):
        assert [(w.start, w.end) for w in one(spark, R.window_bounds(F.lit(n), 10))] == want(n, 10), n
    with pytest.raises(ValueError):
        R.window_bounds(F.lit(3), 0)


def test_journal(spark, tmp_path):
    df = spark.createDataFrame([("e", "q", False, {"ip": "x"})], "exchange_id string, question string, exclude_from_harvest boolean, validation map<string,string>")
    assert journal.harvest(df, {"email"}).count() == 1
    with pytest.raises(ValueError):
        journal.harvest(df.withColumn("deep", F.struct(F.array(F.struct(F.lit(1).alias("IP"))).alias("a"))), {"ip"})
    journal.write_jsonl(df, f"file://{tmp_path}/j")
    assert journal.read_jsonl(spark, f"file://{tmp_path}/j", df.schema).count() == 1
    assert json.loads(journal.run_record(df, ["exchange_id"]))[0]["question"] == "q"


def test_logs_with_torn_tails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id": 3')
    rows, torn = journal.read_log(spark, f"file://{tmp_path}/a.jsonl", "id long")
    assert sorted(r.id for r in rows.collect()) == [1, 2] and [r.line for r in torn.collect()] == ['{"id": 3']
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id"\n{"id": 3}\n')
    with pytest.raises(Exception, match="a broken line before the last"):
        journal.read_log(spark, f"file://{tmp_path}/b.jsonl", "id long")[0].collect()
    (tmp_path / "l.csv").write_text("# note\nday,usd\n1,2.5\n")
    assert journal.read_ledger_csv(spark, f"file://{tmp_path}/l.csv", "day int, usd double").first().usd == 2.5
    specs = spark.createDataFrame([("a" * 64, "x"), ("a" * 64, "x"), ("no", "y")], "hash string, spec string")
    for _ in range(2):
        journal.put_specs(specs, f"file://{tmp_path}/store")
    store = spark.read.parquet(f"file://{tmp_path}/store")
    assert store.count() == 1 and journal.get_one(store, "hash", "a" * 64)["spec"] == "x"
    with pytest.raises(KeyError):
        journal.get_one(store, "hash", "b")
    frames = one(spark, journal.event_frames(F.lit("event: token\ndata: a\ndata: b\n\nevent: done\ndata: {}\n\n")))
    assert [(f.event, f.data) for f in frames] == [("token", "a\nb"), ("done", "{}")]
    journal.write_atomically(str(tmp_path / "x"), b"1")
    assert (tmp_path / "x").read_bytes() == b"1"
    gates = spark.createDataFrame([("b", "passed", 1, 2, 0.5), ("a", "failed", 0, 2, None)], "name string, status string, numerator long, denominator long, threshold double")
    assert journal.gate_report(gates).splitlines()[2:] == ["| a | failed | 0/2 |  |", "| b | passed | 1/2 | 0.5 |"]


def test_rights_statements(spark):
    page = "<h1>T</h1><p>Figure licence: CC BY</p><h2>Text</h2><p>© Someone, all rights reserved</p><h2>Licence</h2><p>This is Creative Commons</p>"
    rows = B.exploded(B.html_blocks(spark.createDataFrame([(1, page), (2, page.split("<h2>Licence")[0]), (3, "<p>none</p>")], "page_id long, html string")))
    assert {r.page_id: r.text for r in B.rights_statements(rows).collect()} == {1: "This is Creative Commons", 2: "© Someone, all rights reserved"}


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = live.event_stream(spark, f"file://{tmp_path}/in", events, per_trigger=3)
    q = live.daily_spend(stream, "value").writeStream.format("memory").queryName("spend").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    days = {(r.day, r.event_type): r.spent for r in spark.sql("select * from spend").collect()}
    want = {(r.day, r.event_type): r.spent for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("spent")).collect()}
    assert days and all(want[k] == v for k, v in days.items())
    q = live.sliding_limits(stream, "user_id", 3600, 2).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from limits").count() == events.count()
