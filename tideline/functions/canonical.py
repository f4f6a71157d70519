"""Canonical JSON and its hash, in batches of Arrow-backed pandas, since the JVM's JSON sorts no keys."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CREDENTIALS = frozenset({"api_key", "apikey", "authorization", "password", "secret", "token", "x-api-key"})


def canonical(value, drop: frozenset[str] = frozenset()):
    """`value` with whole floats as integers and without the `drop` keys; NaN and infinities are refused."""
    if isinstance(value, dict):
        return {k: canonical(v, drop) for k, v in value.items() if k.lower() not in drop}
    if isinstance(value, list):
        return [canonical(v, drop) for v in value]
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number is not finite")
        return int(value) if value.is_integer() else value
    return value


def digest(text: str | None, drop: frozenset[str] = frozenset()) -> str | None:
    if text is None:
        return None
    plain = json.dumps(canonical(json.loads(text), drop), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return hashlib.sha256(plain.encode()).hexdigest()


def spec_hash(spec: Column) -> Column:
    """sha256 of a chart specification without its `_meta`."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: digest(t, frozenset({"_meta"})), na_action="ignore")

    return run(spec)


def request_hash(payload: Column) -> Column:
    """sha256 of a request without credentials."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: digest(t, CREDENTIALS), na_action="ignore")

    return run(payload)


# Parts of a key, between hyphens or underscores, that say that its value opens something.
SECRET_WORDS = frozenset({"token", "secret", "apikey", "password", "passwd", "cookie", "credential", "credentials", "authorization", "bearer", "auth"})
#: Texts that are a secret whatever their key.
SECRET_TEXT = r"(?i:\bbearer\s+\S+|x-api-key|authorization)|\bAKIA[0-9A-Z]{16}\b|\bhf_[A-Za-z0-9]{20,}|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-(?:ant-|[A-Za-z0-9]{20,})"


def opens_something(key: str) -> bool:
    """Whether a key names a credential: a part of it is such a word as a whole, or it ends in `key` after another part."""
    parts = key.lower().replace("_", "-").split("-")
    return not SECRET_WORDS.isdisjoint(parts) or (parts[-1] == "key" and len(parts) > 1)


def scrubbed(value):
    """`value` without the entries whose key names a credential, at any depth."""
    if isinstance(value, dict):
        return {k: scrubbed(v) for k, v in value.items() if not opens_something(k)}
    return [scrubbed(v) for v in value] if isinstance(value, list) else value


def scrub(payload: Column) -> Column:
    """JSON text without credentials, keys sorted; null where it is no JSON, so that nothing unread is passed on."""

    def one(text: str) -> str | None:
        try:
            return json.dumps(scrubbed(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(one, na_action="ignore")

    return run(payload)
