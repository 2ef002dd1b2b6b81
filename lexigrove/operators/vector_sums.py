"""Grouped sums of vectors with a vectorised map-side combine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A task holds at most this many bytes of partial sums before it passes them on.
COMBINE_BYTES = 64 * 1024 * 1024


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of a list column as a 2-d array; all lists must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width, rest = divmod(len(flat), len(column))
    if rest or column.null_count:
        raise ValueError("vectors must be non-null and all of the same length")
    return flat.reshape(len(column), width).astype(dtype, copy=False)


def list_column(values: np.ndarray, kind=pa.float64()) -> pa.Array:
    """A 2-d array as a list column."""
    rows, width = values.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(
        rows + 1, np.int32
    )
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def group_codes(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> tuple[np.ndarray, pa.Table]:
    """Code per row and the table of distinct keys, in code order."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    table = table.select(keys)
    distinct = table.group_by(keys, use_threads=False).aggregate([]).select(keys)
    if distinct.num_rows == table.num_rows:
        return np.arange(table.num_rows), table
    codes = np.zeros(table.num_rows, np.int64)
    for key in keys:
        encoded = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
        part = encoded.indices.to_numpy(zero_copy_only=False)
        _, codes = np.unique(codes * (len(encoded.dictionary) + 1) + part, return_inverse=True)
    _, first = np.unique(codes, return_index=True)
    return codes, table.take(pa.array(first))


def grouped_sum(codes: np.ndarray, values: np.ndarray, n_groups: int) -> np.ndarray:
    """Row sums of ``values`` per code, as one segmented pass over sorted rows."""
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(n_groups))
    return np.add.reduceat(values[order], starts, axis=0)


def _combine(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        held_bytes = 0

        def reduce() -> pa.Table:
            table = pa.concat_tables(held)
            codes, distinct = group_codes(table, keys)
            sums = grouped_sum(codes, matrix(table["vec"]), distinct.num_rows)
            return distinct.append_column("vec", list_column(sums))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = matrix(batch.column("vec"))
            codes, distinct = group_codes(batch, keys)
            sums = grouped_sum(codes, values, distinct.num_rows)
            held.append(distinct.append_column("vec", list_column(sums)))
            held_bytes += sums.nbytes
            if held_bytes > COMBINE_BYTES:
                table = reduce()
                held, held_bytes = [table], table.num_rows * values.shape[1] * 8
                if held_bytes > COMBINE_BYTES // 2:  # many keys: pass on and start afresh
                    yield from table.combine_chunks().to_batches()
                    held, held_bytes = [], 0
        if held:
            yield from reduce().combine_chunks().to_batches()

    return run


def _merge(keys: list[str]):
    """Sums over rows sorted by key; the last key of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            doubles = list_column(matrix(table["vec"]))
            table = table.set_column(table.column_names.index("vec"), "vec", doubles)
            if carry is not None:
                table = pa.concat_tables([carry, table])
            codes, distinct = group_codes(table, keys)
            sums = grouped_sum(codes, matrix(table["vec"]), distinct.num_rows)
            out = distinct.append_column("vec", list_column(sums))
            last = int(codes[-1])
            carry = out.slice(last, 1)
            if out.num_rows > 1:
                done = pa.concat_tables([out.slice(0, last), out.slice(last + 1)])
                yield from done.combine_chunks().to_batches()
        if carry is not None:
            yield from carry.combine_chunks().to_batches()

    return run


def sum_vectors(df: DataFrame, keys: list[str], vec: str, combine: bool = True) -> DataFrame:
    """``keys + vec`` with the element-wise sum of ``vec`` per key, in doubles.

    Each task first adds up its own rows, so a hot key sends one row per task
    to the shuffle; partial rows are then sorted by key and merged in a stream.
    """
    rows = df.select(*keys, F.col(vec).alias("vec"))
    doubles = T.StructField("vec", T.ArrayType(T.DoubleType()))
    schema = T.StructType([*rows.select(*keys).schema.fields, doubles])
    if combine:
        rows = rows.mapInArrow(_combine(keys), schema)
    merged = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(keys), schema)
    return merged.withColumnRenamed("vec", vec)
