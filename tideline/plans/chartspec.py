"""Small declarative chart specifications, validated as a whole and compiled to DataFrame plans."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import digest
from ..operators import series as S

CHART_TYPES = frozenset({"line", "area", "bar", "scatter"})
PARAMETERS = {"resample": {"window_years"}, "rolling_mean": {"window_years"}, "anomaly_vs_baseline": set(), "unit_conversion": {"to_unit"}}
MAX_WINDOW, MAX_BYTES, MAX_META, MAX_NOTE = 100, 8192, 2048, 120


@dataclass(frozen=True)
class Violation:
    path: str
    reason: str


class SpecError(ValueError):
    def __init__(self, violations: list[Violation]):
        super().__init__("; ".join(f"{v.path}: {v.reason}" for v in violations))
        self.violations = violations


def _number(v: Any) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _finite(value: Any, path: str) -> list[Violation]:
    if isinstance(value, float) and not math.isfinite(value):
        return [Violation(path, "not a finite number")]
    if isinstance(value, Mapping):
        return [x for k, v in value.items() for x in _finite(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in _finite(v, f"{path}[{k}]")]
    return []


def parse(text: str) -> dict:
    """A specification from JSON, within its size, with finite numbers."""
    if len(text.encode()) > MAX_BYTES:
        raise SpecError([Violation("$", f"more than {MAX_BYTES} bytes")])
    spec = json.loads(text)
    bad = _finite(spec, "$")
    if len(json.dumps(spec.get("_meta", {})).encode()) > MAX_META:
        bad.append(Violation("$._meta", f"more than {MAX_META} bytes"))
    if bad:
        raise SpecError(bad)
    return spec


def violations(spec: Mapping[str, Any], datasets: Mapping[str, Mapping[str, Any]]) -> list[Violation]:
    """All that is wrong. Errors of structure stop the search for errors of meaning."""
    out: list[Violation] = []
    known = {"id", "type", "title", "series", "x_range", "annotations", "_meta"}
    out += [Violation(f"$.{k}", "unknown key") for k in spec if k not in known]
    if spec.get("type") not in CHART_TYPES:
        out.append(Violation("$.type", f"not one of {sorted(CHART_TYPES)}"))
    series = spec.get("series")
    if not isinstance(series, list) or not series:
        return [*out, Violation("$.series", "at least one series is needed")]
    if out:
        return out
    seen: set[str] = set()
    units: set[str] = set()
    for k, s in enumerate(series):
        at = f"$.series[{k}]"
        if s.get("id") in seen:
            out.append(Violation(f"{at}.id", "repeated"))
        seen.add(s.get("id"))
        if ("dataset" in s) == ("splice" in s):
            out.append(Violation(at, "one of dataset and splice is needed"))
            continue
        members = [s["dataset"]] if "dataset" in s else [s["splice"].get("paleo"), s["splice"].get("instrumental")]
        missing = [m for m in members if m not in datasets]
        out += [Violation(at, f"no dataset {m!r}") for m in missing]
        if missing:
            continue
        if "splice" in s and s.get("transforms"):
            out.append(Violation(f"{at}.transforms", "a spliced series takes none"))
        if "splice" in s and s["splice"].get("overlap", "cut") != "cut":
            out.append(Violation(f"{at}.splice.overlap", "only cut is supported"))
        if "splice" in s and not _number(s["splice"].get("year")):
            out.append(Violation(f"{at}.splice.year", "a number is needed"))
        unit = datasets[members[0]].get("unit")
        for j, t in enumerate(s.get("transforms", [])):
            here, kind = f"{at}.transforms[{j}]", t.get("op")
            if kind not in PARAMETERS:
                out.append(Violation(here, f"unknown operation {kind!r}"))
                continue
            if set(t) - {"op"} != PARAMETERS[kind]:
                out.append(Violation(here, f"takes {sorted(PARAMETERS[kind])}"))
                continue
            if "window_years" in t and (not isinstance(t["window_years"], int) or isinstance(t["window_years"], bool) or not 1 <= t["window_years"] <= MAX_WINDOW):
                out.append(Violation(f"{here}.window_years", f"a whole number from 1 to {MAX_WINDOW} is needed"))
            if kind == "unit_conversion":
                if (unit, t["to_unit"]) not in S.CONVERSIONS:
                    out.append(Violation(f"{here}.to_unit", f"no conversion from {unit!r}"))
                unit = t["to_unit"]
        units.add(unit)
    if len(units) > 2:
        out.append(Violation("$.series", "more than two units"))
    notes = spec.get("annotations", [])
    if not isinstance(notes, list) or not all(isinstance(a, Mapping) and set(a) == {"x", "text"} and _number(a["x"]) and isinstance(a["text"], str) and len(a["text"]) <= MAX_NOTE for a in notes):
        out.append(Violation("$.annotations", f"each needs a number x and a text of {MAX_NOTE} characters at most"))
    r = spec.get("x_range")
    if r is not None and (not isinstance(r, list) or len(r) != 2 or not all(map(_number, r)) or r[0] >= r[1]):
        out.append(Violation("$.x_range", "two ascending numbers are needed"))
    return list(dict.fromkeys(out))


def compile_series(one: Mapping[str, Any], pack: DataFrame, datasets: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """series, x, value of one series. `pack` is the long table of all datasets, pruned by dataset before anything else."""

    def member(name: str) -> DataFrame:
        own = pack.filter(F.col("dataset") == name)
        if datasets[name].get("entity"):
            own = S.select_entity(own, datasets[name]["entity"])
        return own.select(F.lit(one["id"]).alias("series"), "x", "value")

    if "splice" in one:
        cut = one["splice"]
        return S.splice(member(cut["paleo"]), member(cut["instrumental"]), cut["year"]).select("series", "x", "value", "segment")
    df, unit = member(one["dataset"]), datasets[one["dataset"]].get("unit")
    for t in one.get("transforms", []):
        if t["op"] == "resample":
            df = S.resample_rows(df, t["window_years"])
        elif t["op"] == "rolling_mean":
            df = S.rolling_mean_complete(df, t["window_years"])
        elif t["op"] == "anomaly_vs_baseline":
            df = S.anomaly(df)
        else:
            df, unit = S.convert_units(df, unit, t["to_unit"]), t["to_unit"]
    return df.withColumn("segment", F.lit(None).cast("string"))


def compile_spec(spec: Mapping[str, Any], pack: DataFrame, datasets: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """series, x, value, segment of all series, clipped to the range, as one plan."""
    bad = violations(spec, datasets)
    if bad:
        raise SpecError(bad)
    out = None
    for one in spec["series"]:
        df = compile_series(one, pack, datasets)
        out = df if out is None else out.unionByName(df)
    return S.clip(out, *spec["x_range"]) if spec.get("x_range") else out


def render(spec: Mapping[str, Any], pack: DataFrame, datasets: Mapping[str, Mapping[str, Any]], most: int = 20_000) -> dict:
    """The chart as a document with its rows (a chart holds `most` points at most), hash, alternative text and CSV."""
    rows = compile_spec(spec, pack, datasets).orderBy("series", "x").limit(most + 1).collect()
    if len(rows) > most:
        raise SpecError([Violation("$.series", f"more than {most} points")])
    values = [{"series": r["series"], "x": r["x"], "value": r["value"]} for r in rows]
    parts = []
    for one in spec["series"]:
        own = [v for v in values if v["series"] == one["id"]]
        if own:
            change = own[-1]["value"] - own[0]["value"]
            word = "rises" if change > 1e-9 else "falls" if change < -1e-9 else "is unchanged"
            parts.append(f"{one['id']} {word} from {own[0]['value']:g} in {own[0]['x']:g} to {own[-1]['value']:g} in {own[-1]['x']:g}.")
    csv = "series,x,value\n" + "".join(f"{v['series']},{v['x']:g},{v['value']:g}\n" for v in values)
    mark = {"scatter": "point"}.get(spec["type"], spec["type"])
    chart = {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "title": spec.get("title", ""), "data": {"values": values}, "mark": mark, "encoding": {"x": {"field": "x", "type": "quantitative"}, "y": {"field": "value", "type": "quantitative"}, "color": {"field": "series", "type": "nominal"}}}
    return {"chart": chart, "alt_text": " ".join(parts), "csv": csv, "spec_hash": digest(json.dumps(spec), frozenset({"_meta"}))}
