"""Words and shingles of Arrow text columns as 64-bit hashes, by whole-array numpy steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

#: Text bytes worked on at once. Longer texts are cut at white space.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; by sorting, as `np.unique` hashes large arrays and is slow at that."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * CHUNK)
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, _U)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def row_chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one longer row."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def _spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in `raw`, of which `offs` cuts the rows."""
    word = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


def _hash_piece(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, _U), np.zeros(len(offs), np.int64)
    starts, ends = _spans(raw, offs)
    power, inverse = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((LOWER[raw].astype(_U) + _U(1)) * power[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, offs).astype(np.int64)


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of each row and the offsets of the rows in them."""
    lo, hi = int(offs[0]), int(offs[-1])
    if hi - lo <= 2 * CHUNK or len(offs) > 2:
        return _hash_piece(raw[lo:hi], offs - lo)
    parts, at = [], lo
    while at < hi:
        end = min(at + CHUNK, hi)
        while end < hi and not _BLANK[raw[end]]:
            ahead = np.flatnonzero(_BLANK[raw[end : end + CHUNK]])
            end = end + int(ahead[0]) if len(ahead) else min(end + CHUNK, hi)
        parts.append(_hash_piece(raw[at:end], np.array([0, end - at]))[0])
        at = end
    whole = np.concatenate(parts)
    return whole, np.array([0, len(whole)], np.int64)


def shingles(hashes: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's windows of `width` words; a shorter row with words is one window of them all."""
    counts = np.diff(offs)
    windows = np.maximum(counts - width + 1, 0)
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), _U)
    for k in range(width):
        rolled = rolled * _U(0xD6E8FEB86659FD93) + hashes[k : n - width + 1 + k]
    keep = np.ones(n, bool)
    for k in range(1, width):
        last = offs[1:] - k
        keep[last[last >= offs[:-1]]] = False
    short = np.flatnonzero((counts > 0) & (counts < width))
    out_offs = np.zeros(len(offs), np.int64)
    sizes = windows.copy()
    sizes[short] = 1
    np.cumsum(sizes, out=out_offs[1:])
    out = np.empty(int(out_offs[-1]), _U)
    place = np.ones(len(out), bool)
    for d in short:
        value = _U(counts[d])
        with np.errstate(over="ignore"):
            for h in hashes[offs[d] : offs[d + 1]]:
                value = value * _U(0xD6E8FEB86659FD93) + h
        out[out_offs[d]] = value
        place[out_offs[d]] = False
    out[place] = rolled[np.flatnonzero(keep[: len(rolled)])]
    return mix(out), out_offs
