"""Work on all pairs of rows without emitting them: tiles of two row blocks.

Rows are hashed into blocks of bounded size. A tile is an unordered pair of
blocks; each row is sent to the tiles of its block, and a task turns one tile
into a few reduced rows with matrix products. A group of any size, one hot
group included, is split into tiles that fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism

MIN_BLOCK_ROWS = 256
MAX_BLOCK_ROWS = 16_384
BLOCK_BYTES = 64 * 1024 * 1024
# Values for pairs of rows that a task holds at once.
STRIP_PAIRS = 1 << 21


def block_rows_for(df: DataFrame, n_rows: int, row_bytes: int) -> int:
    """Rows per block: about four tiles per core, within what a task can hold.

    Larger blocks mean fewer copies of each row in the shuffle.
    """
    blocks = math.ceil(math.sqrt(8 * parallelism(df.sparkSession)))
    wanted = math.ceil(n_rows / blocks)
    ceiling = max(MIN_BLOCK_ROWS, min(MAX_BLOCK_ROWS, BLOCK_BYTES // max(1, row_bytes)))
    return min(ceiling, max(MIN_BLOCK_ROWS, wanted))


def strips(n_rows: int, n_columns: int):
    """Ranges of rows whose pairs with all columns fit a task, whatever the size of the blocks."""
    step = max(1, STRIP_PAIRS // max(1, n_columns))
    for start in range(0, n_rows, step):
        yield start, min(n_rows, start + step)


def _block(key: Column, n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), n_blocks.cast("long")).cast("int")


def blocks_of(n_rows: int, block_rows: int) -> int:
    return max(1, math.ceil(n_rows / block_rows))


def with_block(df: DataFrame, key: str, n_rows: int, block_rows: int) -> DataFrame:
    """Add ``n_blocks`` and ``block`` for one ungrouped table of known size."""
    n_blocks = blocks_of(n_rows, block_rows)
    return df.withColumn("n_blocks", F.lit(n_blocks)).withColumn(
        "block", _block(F.col(key), F.col("n_blocks"))
    )


def with_group_block(df: DataFrame, groups: list[str], key: str, block_rows: int) -> DataFrame:
    """Add ``n_blocks`` and ``block`` per group, from the row count of each group."""
    counts = df.groupBy(*groups).agg(
        F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int").alias("n_blocks")
    )
    return df.join(counts, groups).withColumn("block", _block(F.col(key), F.col("n_blocks")))


def unordered_tiles(
    blocked: DataFrame,
    groups: list[str],
    run: Callable[[pa.Table, pa.Table | None], pa.Table],
    schema: str,
) -> DataFrame:
    """Apply ``run(a, b)`` to every unordered pair of blocks of a group.

    ``b`` is None on the diagonal. Every row reaches ``n_blocks`` tiles.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    sent = blocked.withColumn("other", other).select(
        *[c for c in blocked.columns if c != "n_blocks"],
        F.least("block", "other").alias("tile_lo"),
        F.greatest("block", "other").alias("tile_hi"),
    )

    def tile(table: pa.Table) -> pa.Table:
        lo = table["tile_lo"][0].as_py()
        hi = table["tile_hi"][0].as_py()
        if lo == hi:
            return run(table, None)
        first = pc.equal(table["block"], lo)
        return run(table.filter(first), table.filter(pc.invert(first)))

    return sent.groupBy(*groups, "tile_lo", "tile_hi").applyInArrow(tile, schema)


def directed_tiles(
    rows: DataFrame,
    columns: DataFrame,
    n_blocks: tuple[int, int],
    run: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """Apply ``run(a, b)`` to every block of ``rows`` against every block of ``columns``.

    Both sides carry ``block`` and share the same columns.
    """
    cols = [c for c in rows.columns if c not in ("block", "n_blocks")]
    n_row_blocks, n_col_blocks = n_blocks

    def sent(side: DataFrame, is_row: bool, others: int) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return side.withColumn("other", other).select(
            *cols,
            F.lit(is_row).alias("is_row"),
            F.col("block" if is_row else "other").alias("tile_rows"),
            F.col("other" if is_row else "block").alias("tile_cols"),
        )

    both = sent(rows, True, n_col_blocks).unionByName(sent(columns, False, n_row_blocks))

    def tile(table: pa.Table) -> pa.Table:
        is_row = table["is_row"]
        return run(table.filter(is_row), table.filter(pc.invert(is_row)))

    return both.groupBy("tile_rows", "tile_cols").applyInArrow(tile, schema)
