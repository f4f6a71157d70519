"""Nested values: all strings of JSON documents with their paths, hashes that ignore order, and where two values differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import SECRET_TEXT
from .text import let


def json_strings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, text: every string anywhere in the JSON texts of `column`, with paths like $.a[0].b; other text than JSON has none.

    Documents are variants, taken apart level by level until no array or object is left anywhere; no schema is needed or inferred. Strings already found pass
    through the levels below, so the result is one chain of generators over one scan. Keys of objects are no strings of it.
    """
    at = rows.select(key, F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v")).filter("v is not null")
    nested = F.schema_of_variant(F.col("v")).rlike("^(ARRAY|OBJECT)")
    text = F.schema_of_variant(F.col("v")) == "STRING"
    tvf = rows.sparkSession.tvf
    at = at.filter(nested | text)
    while not at.filter(nested).isEmpty():
        opened = at.lateralJoin(tvf.variant_explode_outer(F.col("v").outer()).select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__value")))
        inner = F.col("__value").isNotNull()
        step = F.when(F.col("__key").isNotNull(), F.concat(F.lit("."), "__key")).otherwise(F.concat(F.lit("["), F.col("__pos").cast("string"), F.lit("]")))
        opened = opened.filter(inner | text).select(key, F.when(inner, F.concat("path", step)).otherwise(F.col("path")).alias("path"), F.coalesce("__value", "v").alias("v"))
        at = opened.filter(nested | text)
    return at.select(key, "path", F.variant_get("v", "$", "string").alias("text"))


def secret_paths(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path of every string in the JSON texts of `column` that is a secret by its own form; what it says is not repeated."""
    return json_strings(rows, key, column).filter(F.col("text").rlike(SECRET_TEXT)).select(key, "path")


def merkle(value: Column, kind: T.DataType) -> Column:
    """A hash of a nested value, made of the hashes of its parts: fields go by name, and elements of arrays and entries of maps count in any order.

    Null is a value of its own. Leaves are hashed as their text, so 1 and '1' are alike.
    """
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}:"), merkle(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        whole = F.concat(F.lit("o"), *parts)
    elif isinstance(kind, T.ArrayType):
        whole = F.concat(F.lit("a"), F.array_join(F.array_sort(F.transform(value, lambda x: merkle(x, kind.elementType))), ""))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(merkle(e["key"], kind.keyType), F.lit("="), merkle(e["value"], kind.valueType))
        whole = F.concat(F.lit("m"), F.array_join(F.array_sort(F.transform(F.map_entries(value), entry)), ""))
    else:
        whole = F.concat(F.lit("v"), value.cast("string"))
    return F.sha2(F.when(value.isNotNull(), whole).otherwise("n"), 256)


def differing_paths(a: Column, b: Column, kind: T.DataType, at: str | Column = "") -> Column:
    """The paths at which two values of one type differ, by `merkle`: of one differing element in an array the path within it, of more the array's own."""
    here = F.lit(at) if isinstance(at, str) else at
    under = lambda name: F.when(here == "", F.lit(name)).otherwise(F.concat(here, F.lit(f".{name}")))
    none, own = F.array().cast("array<string>"), F.array(here)
    apart = merkle(a, kind) != merkle(b, kind)
    if isinstance(kind, T.StructType) and kind.fields:
        inner = F.concat(*(differing_paths(a[f.name], b[f.name], f.dataType, under(f.name)) for f in kind.fields))
    elif isinstance(kind, T.ArrayType):
        hashes = lambda v: F.transform(v, lambda x: merkle(x, kind.elementType))
        alone = lambda v, other: let(hashes(other), lambda h: F.filter(v, lambda x: ~F.array_contains(h, merkle(x, kind.elementType))))
        item = F.concat(here, F.lit("[]"))
        one = let(alone(a, b), lambda x: let(alone(b, a), lambda y: F.when((F.size(x) == 1) & (F.size(y) == 1), differing_paths(x[0], y[0], kind.elementType, item))))
        inner = F.coalesce(one, F.array(item))
    elif isinstance(kind, T.MapType):
        keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
        changed = F.filter(keys, lambda k: merkle(a[k], kind.valueType) != merkle(b[k], kind.valueType))
        inner = F.transform(changed, lambda k: F.concat(here, F.lit("{"), k.cast("string"), F.lit("}")))
    else:
        inner = own
    return F.when(~apart, none).when(a.isNull() | b.isNull(), own).otherwise(inner)


def fingerprint_mismatches(published: Column, current: Column, kind: T.StructType) -> Column:
    """The fields of a configuration that are no longer what was published, in their order. What is missing on either side counts as changed."""
    changed = [F.when(published[f.name].isNull() | current[f.name].isNull() | (merkle(published[f.name], f.dataType) != merkle(current[f.name], f.dataType)), F.lit(f.name)) for f in kind.fields]
    return F.when(published.isNull(), F.array(*(F.lit(f.name) for f in kind.fields))).otherwise(F.array_compact(F.array(*changed)))
