"""Training-order materialisation: documents to token ids, packed sequences, and a keyed permutation to global slots.

Texts become ids of a given public tokenizer, an end id follows each. All documents form one stream, in the order of a keyed
hash of id and text, and the stream is cut into sequences of a fixed length: so sequences and slots hang on the documents and the key
alone, not on files or tasks. Where a document starts comes from sums over hash ranges; only narrow rows are sorted for that.
A sequence's slot is a keyed Feistel permutation of its number: two halves of nearly equal size that add hashes of each
other, walked again where the result lies outside. Pieces of documents go to range partitions of the slots, are joined there
to sequences, and stand in slot order. `write_shards` writes them as fixed-stride files: any reader can go to slot s at byte
(s mod shard size) * stride of shard s div shard size, and resume there.

Defined results: a null or empty text is its end id alone. Special strings in a text are ordinary text. The last sequence
of the stream is filled up with end ids, `n_tokens` is its true number. An empty table gives no sequence. Rows that repeat
come one after another.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import hold, sized, tidy

SEQUENCE = 1024
#: Sequences of a shard, and shards of a partition.
SHARD, SHARDS = 1024, 16
#: Documents whose tokens a worker holds at once.
ROWS = 1000
#: Bits of the hash by which starts are summed in ranges.
RANGES = 12
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # a fixed value, that of the vocabulary

_encoders: dict[str, object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary lies; any file of base64 tokens and ranks does."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(ranks: bytes):
    import tiktoken

    key = hashlib.sha256(ranks).hexdigest()
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def _tokenise(batches: Iterator[pa.RecordBatch], ranks: bytes, end: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """part (the task), h, nth (row of that hash and length in the task), doc_id, n, tokens of each document."""
    encode, part = _encoder(ranks).encode_ordinary, TaskContext.get().partitionId()
    seen: dict[tuple[int, int], int] = {}
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        rows: list[bytes] = []
        nth = []
        for h, text in zip(batch.column("h").to_pylist(), batch.column("text"), strict=True):
            ids = np.array([*encode(text.as_py() or ""), end], dtype)
            seen[h, len(ids)] = seen.get((h, len(ids)), -1) + 1
            nth.append(seen[h, len(ids)])
            rows.append(ids.tobytes())
        size = np.dtype(dtype).itemsize
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int64()), batch.column("h"), pa.array(nth, pa.int64()), batch.column("doc_id"), pa.array([len(r) // size for r in rows], pa.int64()), pa.array(rows, pa.binary())],
            names=["part", "h", "nth", "doc_id", "n", "tokens"],
        )


def _cut(batches: Iterator[pa.RecordBatch], length: int, total: int, key: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """The pieces of documents (doc_id, n, tokens, at) by sequence: slot, at (in the sequence), doc_id, tokens."""
    size = np.dtype(dtype).itemsize
    for batch in batches:
        at, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("at", "n"))
        pieces = (at + n - 1) // length - at // length + 1
        of = np.repeat(np.arange(len(n)), pieces)
        number = at[of] // length + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo, hi = np.maximum(number * length, at[of]), np.minimum((number + 1) * length, (at + n)[of])
        tokens = batch.column("tokens").to_pylist()
        slot = permute(number, total, key).astype(np.int64)
        for k in range(0, len(of), 4096):  # a long document has many pieces
            some = slice(k, k + 4096)
            cut = [tokens[d][size * (x - a) : size * (y - a)] for d, x, y, a in zip(of[some], lo[some], hi[some], at[of[some]], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slot[some]), pa.array((lo - number * length)[some]), batch.column("doc_id").take(pa.array(of[some])), pa.array(cut, pa.binary())], names=["slot", "at", "doc_id", "tokens"])


def _join(batches: Iterator[pa.RecordBatch], length: int, shard: int, end: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of slot and place to whole sequences."""
    size, fill = np.dtype(dtype).itemsize, np.array([end], dtype).tobytes()
    slot, ids, room, rows = None, [], [], []

    def close() -> None:
        data = b"".join(room)
        rows.append((slot, slot // shard, slot % shard, len(data) // size, list(dict.fromkeys(ids)), data + fill * (length - len(data) // size)))

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["slot", "shard", "place", "n_tokens", "doc_ids", "tokens"])
        rows.clear()
        return out

    for table in batches:
        for s, doc, tokens in zip(*(table.column(c).to_pylist() for c in ("slot", "doc_id", "tokens")), strict=True):
            if s != slot:
                if slot is not None:
                    close()
                slot, ids, room = s, [], []
            ids.append(doc)
            room.append(tokens)
            if len(rows) >= 1024:
                yield batch()
    if slot is not None:
        close()
    yield batch()


def permute(index: np.ndarray, n: int, key: int, rounds: int = 8) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1."""
    from .hashing import mix

    u = np.uint64
    a = max(int(np.ceil(np.sqrt(n))), 1)
    b = -(-n // a) if n else 1
    out = np.asarray(index, u).copy()
    walk = np.ones(len(out), bool)
    while walk.any():
        x, y = out[walk] % u(a), out[walk] // u(a)
        for r in range(rounds):
            salt = u((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
            if r % 2:
                y = (y + mix(x + salt) % u(b)) % u(b)
            else:
                x = (x + mix(y + salt) % u(a)) % u(a)
        out[walk] = y * u(a) + x
        walk = out >= u(n)
    return out


def _starts(tokens: DataFrame) -> DataFrame:
    """h, n, part, start: where the documents of a hash, length and task start in the stream; those of one hash and length follow each other by task.

    The length is part of the order, so texts whose hashes collide still get places of their own.
    """
    parts = tokens.groupBy("h", "n", "part").agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("h", "n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hashes = hold(parts.groupBy("h", "n").agg((F.sum("rows") * F.col("n")).alias("size")).withColumn("range", F.shiftright("h", 64 - RANGES)), "hashes")
    run = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = hashes.groupBy("range").agg(F.sum("size").alias("size")).select("range", run(Window.orderBy("range")).alias("first"))  # 2 ** RANGES rows at most
    inside = hashes.withColumn("in_range", run(Window.partitionBy("range").orderBy("h", "n"))).join(F.broadcast(ranges), "range")
    first = inside.select(F.col("h").alias("of"), F.col("n").alias("long"), (F.col("first") + F.col("in_range")).alias("start"))
    return parts.join(first, (F.col("h") == F.col("of")) & (F.col("n") == F.col("long"))).select("h", "n", "part", (F.col("start") + F.col("before") * F.col("n")).alias("start"))


def sequences(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, shard: int = SHARD, key: int = 7, end: int = 50256, shards: int = SHARDS) -> DataFrame:
    """slot, shard, place (in the shard), n_tokens, doc_ids, tokens (little-endian ids, `length` of them), in slot order by partition.

    A partition holds `shards` shards of `shard` sequences.
    """
    with open(path or tokenizer_path(), "rb") as f:
        ranks = f.read()
    dtype = "<u2" if end < 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(key), F.col("doc_id").cast("long"), "text").alias("h"), "text")
    tokens = hold(rows.mapInArrow(tidy(lambda it: _tokenise(it, ranks, end, dtype)), "part long, h long, nth long, doc_id long, n long, tokens binary"), "tokens")
    all_ = tokens.agg(F.sum("n")).first()[0] or 0
    total = -(-all_ // length)
    starts = sized(hold(_starts(tokens.select("part", "h", "n")), "starts")).withColumnsRenamed({"h": "of", "n": "long", "part": "task"})
    placed = tokens.join(starts, (F.col("h") == F.col("of")) & (F.col("n") == F.col("long")) & (F.col("part") == F.col("task"))).select("doc_id", "n", "tokens", (F.col("start") + F.col("nth") * F.col("n")).alias("at"))
    pieces = placed.mapInArrow(tidy(lambda it: _cut(it, length, total, key, dtype)), "slot long, at long, doc_id long, tokens binary")
    # Slots are dense, so the bounds of the ranges are known and need no sampling.
    parts = max(-(-total // (shard * shards)), 1)
    dealt = pieces.repartitionById(parts, F.floor(F.col("slot") / (shard * shards)).cast("int")).sortWithinPartitions("slot", "at")
    return dealt.mapInArrow(tidy(lambda it: _join(it, length, shard, end, dtype)), "slot long, shard long, place long, n_tokens int, doc_ids array<long>, tokens binary")


def _at(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address (a local or mounted folder, hdfs, s3, gs) and the path in it."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each shard of `sequences()` as a file of fixed stride in `folder`, which all executors share, and returns shard, first_slot, rows, bytes, sha256.

    A file is written beside its place and moved there, so a task that is run again replaces it whole.
    """

    def sink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _at(folder)
        files.create_dir(root, recursive=True)
        done, current, out, digest, n, first, size = [], None, None, None, 0, 0, 0

        def close() -> None:
            out.close()
            files.move(f"{root}/_shard-{current:06d}-{attempt}", f"{root}/shard-{current:06d}.bin")
            done.append((current, first, n, size, digest.hexdigest()))

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for slot, shard, tokens in zip(*(batch.column(c).to_pylist() for c in ("slot", "shard", "tokens")), strict=True):
                if shard != current:
                    if out:
                        close()
                    current, digest, n, first, size = shard, hashlib.sha256(), 0, slot, 0
                    out = files.open_output_stream(f"{root}/_shard-{shard:06d}-{attempt}")
                out.write(tokens)
                digest.update(tokens)
                n, size = n + 1, size + len(tokens)
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "first_slot", "rows", "bytes", "sha256"), d, strict=True)) for d in done])

    return hold(rows.select("slot", "shard", "tokens").mapInArrow(sink, "shard long, first_slot long, rows long, bytes long, sha256 string"), "manifest")


def read_slots(folder: str, first: int, count: int, length: int = SEQUENCE, shard: int = SHARD, dtype: str = "<u2") -> np.ndarray:
    """The token ids of `count` slots from `first` on, by seeking."""
    (files, root), stride, out = _at(folder), length * np.dtype(dtype).itemsize, []
    while count > 0:
        at = first % shard
        n = min(count, shard - at)
        with files.open_input_file(f"{root}/shard-{first // shard:06d}.bin") as f:
            f.seek(at * stride)
            data = f.read(n * stride)
        out.append(np.frombuffer(data, dtype).reshape(-1, length))
        if len(data) < n * stride:
            break
        first, count = first + n, count - n
    return np.concatenate(out) if out else np.zeros((0, length), dtype)
