"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, parallelism

# A counted table of at most this many rows is numbered by one task.
SMALL_TABLE = 10_000
# The cut-off of a top-n comes from a quantile sketch that is off by at most count / ACCURACY ranks.
ACCURACY = 10_000


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``, the 0-based position of each row in ``order``.

    Rows are range-partitioned and sorted per partition, written once, and
    numbered inside each partition; the only other data is one row count per
    partition. The written copy fixes the partition bounds, which are sampled.
    """
    stored = materialize(df, "unranked")
    return _numbered(stored, stored.count(), order, name)


def _numbered(stored: DataFrame, count: int, order: list[Column], name: str) -> DataFrame:
    if count <= SMALL_TABLE:
        return stored.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    parts = parallelism(stored.sparkSession) * 2
    ranged = materialize(
        stored.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().alias("__mid"),
        ),
        "ranked",
    )
    sizes = ranged.groupBy("__part").agg(
        F.count("*").alias("__n"), F.min("__mid").alias("__first")
    )
    # one row per partition, so the running sum is small whatever the data
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    return (
        ranged.join(offsets, "__part")
        .withColumn(name, F.col("__offset") + F.col("__mid") - F.col("__first"))
        .drop("__part", "__mid", "__first", "__offset")
    )


def top_ranked(df: DataFrame, order: list[Column], n: int, name: str, first: Column) -> DataFrame:
    """The first ``n`` rows in ``order`` with their 0-based position.

    ``first`` is a double, never null, that ascends along ``order``. Rows whose ``first`` is
    beyond the cut-off cannot be among the ``n`` and are left out of the sort; all rows that
    tie with the cut-off take part in it.
    """
    stored = materialize(df, "unranked")
    count = stored.count()
    if count > max(n, SMALL_TABLE):
        share = min(1.0, n / count + 2 / ACCURACY)
        bound = stored.agg(F.percentile_approx(first, share, ACCURACY)).first()[0]
        near = stored.where(first <= F.lit(bound))
        n_near = near.count()
        if n_near >= n:
            stored, count = near, n_near
    return _numbered(stored, count, order, name).where(F.col(name) < n)
