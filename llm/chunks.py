"""Chunks of documents that meet shared values in columnar blocks.

Documents are gathered in chunks of bounded size. A chunk has a body, which holds its rows,
and blocks: the distinct values (words, hashes) it wants to compare with other chunks, dealt
to parts. A part gets the blocks of all chunks, works on each distinct value once and
replies to the chunks by position. A value sends one entry per chunk, however often it
occurs, so frequent words, passages and copies are combined before the shuffle, and no
row is moved for a single word. Chunk tables are written once to shared storage; what
follows reads them again when executors are lost.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.runtime import scratch_path

CHUNK_BYTES = 16 * 1024 * 1024  # of text; a longer text is a chunk of its own
OUT_ROWS = 1024  # rows of a batch that goes back to Spark
ROWS = "chunk long, part int, payload binary"
BODY = -1
_SCHEMA = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])


# --- bytes ---------------------------------------------------------------------------------

def dumps(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; 64-bit ones by byte plane, sorted unsigned ones by difference."""
    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        sorted_ids = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        raw = np.diff(a, prepend=np.uint64(0)) if sorted_ids else a
        raw = raw.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        data = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out.append(struct.pack("<4s?qq", a.dtype.str[1:].encode(), sorted_ids, len(raw), len(data)))
        out.append(data)
    return b"".join(out)


def loads(data: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<i", data), 4, []
    size = struct.calcsize("<4s?qq")
    for _ in range(n):
        kind, by_difference, raw_len, data_len = struct.unpack_from("<4s?qq", data, at)
        at += size
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        if raw_len:
            raw = pa.decompress(data[at : at + data_len], raw_len, codec="zstd", asbytes=True)
            planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1)
            a = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
            a = np.cumsum(a, dtype=np.uint64) if by_difference else a
        else:
            a = np.zeros(0, dtype)
        out.append(a)
        at += data_len
    return out


def dump_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def load_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def dump_words(words: pa.Array) -> bytes:
    """Words hold no line feed, so that one can stand between them."""
    text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py() or ""
    raw = text.encode()
    return struct.pack("<qq", len(words), len(raw)) + (
        pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
    )


def load_words(data: bytes) -> pa.Array:
    n, size = struct.unpack_from("<qq", data)
    if not n:
        return pa.array([], pa.string())
    raw = pa.decompress(data[16:], size, codec="zstd", asbytes=True)
    return pc.split_pattern(pa.array([raw.decode()]), "\n").flatten()


# --- chunks --------------------------------------------------------------------------------

def n_parts(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _slices(batches: Iterable[pa.RecordBatch], text_col: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of text; never empty."""
    kept, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0)
        sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            room = np.cumsum(sizes[at:])
            n = max(1, int(np.searchsorted(room, limit - size, side="right")))
            kept.append(batch.slice(at, n))
            size += int(room[n - 1])
            at += n
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def build(
    docs: DataFrame,
    text_col: str,
    make: Callable[[pa.Table], Iterable[tuple[int, bytes]]],
    name: str,
    chunk_bytes: int = CHUNK_BYTES,
    *,
    divide: int = 1,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Write the chunk table of ``docs``, bucketed by chunk; return its bodies and its blocks.

    ``make(table)`` gives the rows of a chunk: one (BODY, bytes) and any (part, bytes).
    Chunks number the rows of a partition in order. ``divide``: so many times smaller chunks, where
    tasks hold more for each byte. ``path``: a new folder, for ``drop_blocks``.
    """
    spark = docs.sparkSession

    def task(batches):
        first = TaskContext.get().partitionId() << 32
        for i, table in enumerate(_slices(batches, text_col, max(1, chunk_bytes // divide))):
            rows = list(make(table))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + i] * len(rows), pa.int64()),
                    pa.array([part for part, _ in rows], pa.int32()),
                    pa.array([data for _, data in rows], pa.binary()),
                ],
                schema=_SCHEMA,
            )

    rows = docs.mapInArrow(task, ROWS).withColumn("is_body", F.col("part") == BODY)
    path = path or scratch_path(spark, name)
    table = f"chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.write.partitionBy("is_body").bucketBy(buckets, "chunk")
    writer.option("path", path).saveAsTable(table)
    stored = spark.table(table).select("chunk", "part", "payload", "is_body")
    blocks = spark.read.schema(rows.schema).parquet(path)  # without the buckets: more, smaller scans
    columns = ["chunk", "part", "payload"]
    return stored.filter("is_body").select(*columns), blocks.filter("not is_body").select(*columns)


def drop_blocks(spark: SparkSession, path: str) -> None:
    """Empty the blocks of the chunk table at ``path``, once all replies are stored; its bodies stay."""
    spark.createDataFrame([], ROWS).write.mode("overwrite").parquet(f"{path}/is_body=false")


def exchange(
    blocks: DataFrame, reply: Callable[[list[bytes]], list[bytes | None]]
) -> DataFrame:
    """Bring the blocks of a part together; ``reply`` answers each of them (None: no answer)."""

    def task(table: pa.Table) -> pa.Table:
        answers = reply(table["payload"].to_pylist())
        pa.default_memory_pool().release_unused()
        keep = pa.array([a is not None for a in answers], pa.bool_())
        out = pa.table(
            [table["chunk"], table["part"], pa.array(answers, pa.binary())], schema=_SCHEMA
        )
        return out.filter(keep)

    return blocks.groupBy("part").applyInArrow(task, ROWS)


def meet(
    bodies: DataFrame,
    replies: DataFrame,
    finish: Callable[[int, bytes, list[bytes]], pa.Table],
    schema: str,
) -> DataFrame:
    """Bring each body together with the replies to its blocks, which come by part.

    Bodies are stored by chunk, so only the replies are shuffled.
    """

    def task(body: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")["payload"].to_pylist()
        out = finish(body["chunk"][0].as_py(), body["payload"][0].as_py(), answers)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out.to_batches(max_chunksize=OUT_ROWS), out.schema)

    return (
        bodies.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(task, schema)
    )


# --- hashes that several chunks have ---------------------------------------------------------

def hash_blocks(hashes: np.ndarray, parts: int, *with_hash: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks of sorted hashes, and of arrays in the same order, dealt by their range."""
    step = 2**64 // parts + 1
    bounds = np.array([min(step * i, 2**64 - 1) for i in range(parts)], np.uint64)
    cuts = np.append(np.searchsorted(hashes, bounds), len(hashes))
    for part in range(parts):
        lo, hi = cuts[part], cuts[part + 1]
        if hi > lo:
            yield part, dumps(hashes[lo:hi], *(a[lo:hi] for a in with_hash))


def shared_hashes(payloads: list[bytes]) -> list[bytes | None]:
    """For each block of distinct hashes, those that another block holds as well."""
    blocks = [loads(p)[0] for p in payloads]
    everything = np.sort(np.concatenate(blocks))
    twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
    out = []
    for block in blocks:
        kept = block[member(block, twice)]
        out.append(dumps(kept) if len(kept) else None)
    return out


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def gathered(replies: list[bytes]) -> np.ndarray:
    """The hashes of all replies to a chunk, sorted."""
    return np.concatenate([loads(r)[0] for r in replies]) if replies else np.zeros(0, np.uint64)
