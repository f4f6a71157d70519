"""What a chart leaves behind: its table in wide form under caption lines, and whether its points are those that a second reckoning gives."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import digest
from ..operators import series as S
from .chartspec import compile_spec


def caption_lines(spec: Mapping[str, Any], datasets: Mapping[str, Mapping[str, Any]], accessed: str, site: str, short: bool = False, pairs: Mapping[str, Mapping[str, str]] | None = None) -> list[str]:
    """The lines below a chart: each source once with its licence, the entity shown of several, what a splice leaves out, and when, where and what it was.

    `pairs` has a note and a disclosure by the pair's name (older/newer). The short form keeps sources and entities.
    """
    members = [m for one in spec["series"] for m in ([one["splice"]["paleo"], one["splice"]["instrumental"]] if "splice" in one else [one["dataset"]])]
    lines = []
    for name in dict.fromkeys(members):
        entry = datasets[name]
        source = f"Data: {str(entry.get('attribution', name)).strip()}"
        lines.append(source if short else f"{source} — {str(entry.get('licence', '')).strip()}")
        if entry.get("entity"):
            lines.append(f"Entity shown: {entry['entity']} (not all entities in this source)")
    for one in [] if short else spec["series"]:
        pair = (pairs or {}).get("{paleo}/{instrumental}".format(**one["splice"]), {}) if "splice" in one else {}
        lines += [text.strip() for key in ("note", "disclosure") if (text := pair.get(key) or "").strip()]
    return [*lines, f"Accessed {accessed} · {site} · ChartSpec {digest(json.dumps(spec), frozenset({'_meta'}))[:12]}"]


def wide(rows: DataFrame, ids: Sequence[str], x: str = "x") -> DataFrame:
    """One row for each x of (series, x, value), one column for each id; null where a series has no value there. One aggregate, whatever the number of series."""
    return S.outer_merge({i: rows.filter(F.col("series") == i) for i in ids}, x)


def write_csv(spec: Mapping[str, Any], pack: DataFrame, datasets: Mapping[str, Mapping[str, Any]], path: str, accessed: str, site: str, **caption: Any) -> None:
    """The chart's table as one CSV file in the folder `path`: caption lines behind #, then the header, then the rows by x.

    The rows are sorted and written by a task, in any number; none passes through the driver.
    """
    ids = [one["id"] for one in spec["series"]]
    table = wide(compile_spec(spec, pack, datasets), ids)
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = table.select(F.lit(1).alias("part"), F.col("x").alias("at"), F.concat_ws(",", cell("x"), *map(cell, ids)).alias("value"))
    quoted = [f'"{i.replace(chr(34), chr(34) * 2)}"' if any(c in i for c in ',"\n') else i for i in ids]
    head = [f"# {line}" for line in caption_lines(spec, datasets, accessed, site, **caption)] + [",".join(["year_ce", *quoted])]
    first = table.sparkSession.createDataFrame([(0, float(k), line) for k, line in enumerate(head)], "part int, at double, value string")
    first.unionByName(rows).repartition(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


MARKS = {"line": {"type": "line"}, "area": {"type": "area", "opacity": 0.6}, "bar": {"type": "bar"}, "scatter": {"type": "point", "filled": True}}


def chart_document(spec: Mapping[str, Any], datasets: Mapping[str, Mapping[str, Any]], captions: Sequence[str], bands: Sequence[str] = ()) -> dict[str, Any]:
    """The chart as a layered document without its rows, which are named data: `points` (series, x, value, segment) and, for the series in `bands`, `bounds` (series, x, lower, upper).

    Series of one unit share an axis; of two units each gets its own, titled by it. A splice has a rule where its sides meet, and annotations (x, text) stand at their x. The captions are the title's lines below.
    """
    units: dict[str, list[str]] = {}
    for one in spec["series"]:
        name = one["splice"]["instrumental"] if "splice" in one else one["dataset"]
        unit = next((t["to_unit"] for t in reversed(one.get("transforms", [])) if t["op"] == "unit_conversion"), datasets[name].get("unit", ""))
        units.setdefault(unit, []).append(one["id"])
    x = {"field": "x", "type": "quantitative", "title": "Year", "axis": {"format": "d"}} | ({"scale": {"domain": list(spec["x_range"])}} if spec.get("x_range") else {})
    color = {"field": "series", "type": "nominal", "scale": {"domain": [one["id"] for one in spec["series"]]}, "title": None}
    only = lambda ids: [{"filter": {"field": "series", "oneOf": list(ids)}}]
    axes = []
    for k, (unit, ids) in enumerate(units.items()):
        y = {"type": "quantitative", "title": unit, "axis": {"orient": "right" if k else "left"}}
        layers = []
        if own := [i for i in ids if i in bands]:
            layers.append({"data": {"name": "bounds"}, "transform": only(own), "mark": {"type": "area", "opacity": 0.2}, "encoding": {"x": x, "y": y | {"field": "lower"}, "y2": {"field": "upper"}, "color": color}})
        encoding = {"x": x, "y": y | {"field": "value"}, "color": color}
        if any("splice" in one and one["id"] in ids for one in spec["series"]):
            encoding["strokeDash"] = {"field": "segment", "type": "nominal", "title": None}
        layers.append({"data": {"name": "points"}, "transform": only(ids), "mark": MARKS[spec["type"]], "encoding": encoding})
        axes.append({"layer": layers})
    rules = [{"x": one["splice"]["year"], "text": ""} for one in spec["series"] if "splice" in one] + [{"x": a["x"], "text": a["text"]} for a in spec.get("annotations", [])]
    if rules:
        place = {"x": {"field": "x", "type": "quantitative"}}
        axes.append({"data": {"values": rules}, "layer": [{"mark": {"type": "rule", "strokeDash": [2, 2]}, "encoding": place}, {"mark": {"type": "text", "align": "left", "dx": 4, "baseline": "top", "y": 4}, "encoding": place | {"text": {"field": "text"}}}]})
    document = {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "title": {"text": spec.get("title", ""), "subtitle": list(captions)}, "datasets": {"points": [], "bounds": []}, "layer": axes}
    return document | ({"resolve": {"scale": {"y": "independent"}}} if len(units) > 1 else {})


def artefact(spec: Mapping[str, Any], pack: DataFrame, datasets: Mapping[str, Mapping[str, Any]], path: str, accessed: str, site: str, **caption: Any) -> dict[str, Any]:
    """A chart as files in the folder `path`, none of which passes its rows through the driver, and what is known of it.

    `csv` holds the table, `points` and `bounds` the rows as lines of JSON (a document's named data), by series and x. Returned are the document without rows, its hash, a sentence for each series (its first and last point
    and which way it went), and the extent of each series.
    """
    rows, ids = compile_spec(spec, pack, datasets), [one["id"] for one in spec["series"]]
    captions = caption_lines(spec, datasets, accessed, site, **caption)
    write_csv(spec, pack, datasets, f"{path}/csv", accessed, site, **caption)
    rows.select("series", "x", "value", "segment").repartition("series").sortWithinPartitions("series", "x").write.mode("overwrite").json(f"{path}/points")
    banded = [one["id"] for one in spec["series"] if "dataset" in one and not one.get("transforms")] if {"lower", "upper"} <= set(pack.columns) else []
    bounds = None
    for one in (o for o in spec["series"] if o["id"] in banded):
        own = S.band(pack.filter((F.col("dataset") == one["dataset"]) & (F.lit(True) if not datasets[one["dataset"]].get("entity") else F.col("entity") == datasets[one["dataset"]]["entity"]))).withColumn("series", F.lit(one["id"]))
        bounds = own if bounds is None else bounds.unionByName(own)
    if bounds is not None:
        inside = S.clip(bounds, *spec["x_range"]) if spec.get("x_range") else bounds
        inside.select("series", "x", "lower", "upper").repartition("series").sortWithinPartitions("series", "x").write.mode("overwrite").json(f"{path}/bounds")
        banded = [r[0] for r in inside.select("series").distinct().collect()]  # one row for each series of the chart
    ends = S.trend(rows).join(S.extents(rows), "series").join(rows.groupBy("series").agg(F.min("x").alias("from"), F.max("x").alias("to")), "series").collect()
    known = {r["series"]: r for r in ends}
    said = []
    for i in ids:
        if (r := known.get(i)) is not None:
            way = r["trend"] if r["trend"] != "is unchanged" else "is unchanged,"
            said.append(f"{i} {way} from {r['first']:g} in {r['from']:g} to {r['last']:g} in {r['to']:g}.")
    return {
        "document": chart_document(spec, datasets, captions, banded), "spec_hash": digest(json.dumps(spec), frozenset({"_meta"})), "alt_text": " ".join(said), "captions": captions,
        "extents": {i: (known[i]["low"], known[i]["high"]) for i in ids if i in known},
    }


# ---- the second reckoning ------------------------------------------------------------------------------------------


def _resampled(df: DataFrame, width: int) -> DataFrame:
    """Runs of rows by sorted arrays, where the chart's plan numbers rows in a window."""
    listed = df.groupBy("series").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("value").cast("double").alias("value")))).alias("rows"))
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size("rows") / width).cast("int")), lambda k: F.slice("rows", k * width + 1, F.lit(width)))
    mean = lambda run, c: F.aggregate(run, F.lit(0.0), lambda acc, r: acc + r[c]) / width
    each = listed.select("series", F.explode(F.filter(runs, lambda r: F.size(r) == width)).alias("run"))
    return each.select("series", mean(F.col("run"), "x").alias("x"), mean(F.col("run"), "value").alias("value"))


def _rolled(df: DataFrame, width: int) -> DataFrame:
    """Each row given to the places it counts for, by an equality join on whole x, where the chart's plan has a range frame; x must be whole numbers."""
    half = (width - 1) // 2
    given = df.withColumn("__to", F.explode(F.sequence(F.col("x").cast("long") - half, F.col("x").cast("long") + half)))
    sums = given.groupBy("series", "__to").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    places = df.select("series", F.col("x"), F.col("x").cast("long").alias("__to"))
    return places.join(sums, ["series", "__to"]).filter(F.col("n") == width).select("series", "x", (F.col("s") / F.col("n")).alias("value"))


def _anomaly(df: DataFrame) -> DataFrame:
    """A mean joined back, where the chart's plan has a window."""
    mean = df.groupBy("series").agg((F.sum("value") / F.count("value")).alias("__mean"))
    return df.join(mean, "series").select("series", "x", (F.col("value") - F.col("__mean")).alias("value"))


def second_series(one: Mapping[str, Any], pack: DataFrame, datasets: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """series, x, value of one series, by other plans than `compile_series`."""

    def member(name: str, low: float | None = None, high: float | None = None) -> DataFrame:
        entity = datasets[name].get("entity")
        own = pack.where(F.col("dataset").eqNullSafe(F.lit(name)) & (F.lit(True) if entity is None else F.col("entity").eqNullSafe(F.lit(entity))))
        inside = (F.lit(True) if low is None else F.col("x") >= low) & (F.lit(True) if high is None else ~(F.col("x") >= high))
        return own.where(inside).select(F.lit(one["id"]).alias("series"), "x", "value")

    if "splice" in one:
        cut = one["splice"]
        return member(cut["paleo"], high=cut["year"]).unionByName(member(cut["instrumental"], low=cut["year"]))
    df, unit = member(one["dataset"]), datasets[one["dataset"]].get("unit")
    for t in one.get("transforms", []):
        if t["op"] == "resample":
            df = _resampled(df, t["window_years"])
        elif t["op"] == "rolling_mean":
            df = _rolled(df, t["window_years"])
        elif t["op"] == "anomaly_vs_baseline":
            df = _anomaly(df)
        else:
            df, unit = df.select("series", "x", (F.col("value") / (1 / S.CONVERSIONS[unit, t["to_unit"]])).alias("value")), t["to_unit"]
    return df


def faithfulness(spec: Mapping[str, Any], pack: DataFrame, datasets: Mapping[str, Mapping[str, Any]], tolerance: float = 1e-6) -> DataFrame:
    """series, x, kind, expected, actual, faithful for each point of the chart or of the second reckoning.

    A point that only one side has counts as infinite on the other, and is not faithful. `kind` is pass_through for series as they are, else post_transform, whose
    values may differ by `tolerance` of the expected one; pass_through values must be equal.
    """
    drawn = compile_spec(spec, pack, datasets).select("series", "x", F.col("value").alias("actual"))
    expected = None
    for one in spec["series"]:
        kind = "post_transform" if one.get("transforms") else "pass_through"
        df = second_series(one, pack, datasets).select("series", "x", F.col("value").alias("expected"), F.lit(kind).alias("kind"))
        expected = df if expected is None else expected.unionByName(df)
    if spec.get("x_range"):
        expected = expected.filter((F.col("x") >= spec["x_range"][0]) & (F.col("x") <= spec["x_range"][1]))
    kinds = F.create_map(*(F.lit(v) for one in spec["series"] for v in (one["id"], "post_transform" if one.get("transforms") else "pass_through")))
    # Means of x may differ in their last digits: points meet on nine decimals.
    key = F.round(F.col("x").cast("double"), 9).alias("at")
    both = drawn.select("series", key, "actual").join(expected.select("series", key, "expected"), ["series", "at"], "full_outer")
    gap = F.abs(F.col("actual") - F.col("expected")) / F.when(F.col("expected") == 0, 1.0).otherwise(F.abs("expected"))
    missing = F.lit(float("inf"))
    faithful = F.when(F.col("kind") == "pass_through", F.col("actual") == F.col("expected")).otherwise(gap <= tolerance)
    out = both.withColumn("kind", kinds[F.col("series")]).withColumn("faithful", F.coalesce(faithful, F.lit(False)))
    return out.select("series", F.col("at").alias("x"), "kind", F.coalesce("expected", missing).alias("expected"), F.coalesce("actual", missing).alias("actual"), "faithful")
