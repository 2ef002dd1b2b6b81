"""Nearest neighbours by largest inner product over a permutation index.

Equal vectors are one class, named by its smallest id. A bounded sample of classes are the pivots.
Vectors are scaled by the largest norm and get one more component that fills them up to length
1, so that the largest inner product is the smallest angle. A vector is represented by its
``prefix`` nearest pivots in order. Classes are dealt to shards by a hash, and each shard posts its
classes, with the place of the pivot, in one inverted file per pivot. A query reads the files of its
own pivots in every shard and adds up, class by class, what they spare of the footrule distance of
the two permutations (a pivot that a permutation lacks counts as behind its end). The classes of
least distance are reranked by the inner product of the original vectors, in double precision.

Pivots and reranked classes grow with the square root of the classes, so a query looks at a share of the
table that falls as it grows: see ``reranked``. Shards and blocks of queries are of bounded bytes.

Vectors that are null, zero, hold a null or non-finite component or are not of the most
frequent length take no part. Rows with the same id and vector are one. An empty table, or one
without a usable vector, gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.runtime import materialize

from .words import one_array

SHARD_BYTES = 32 * 1024 * 1024  # of the vectors of a shard
LEAST_SHARD = 8192  # classes below which a table is not cut further for more tasks
BLOCK_BYTES = 4 * 1024 * 1024  # of the vectors of a block of queries
STEP_ROWS = 1024  # vectors compared with the pivots at once


def n_pivots(n: int, most: int = 4096) -> int:
    """Pivots of an index over n classes."""
    return min(n, most, max(8, round(8 * math.sqrt(n))))


def reranked(n: int, k: int, factor: float = 12.0) -> int:
    """Classes of n that a query compares by their vectors."""
    return min(n, max(k + 1, math.ceil(factor * math.sqrt(n))))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part."""
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    ).filter("id is not null and vec is not null and size(vec) > 0")
    rows = rows.filter(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("vec") == (most["d"] if most else -1))


def _numbers(column) -> np.ndarray:
    column = one_array(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _members(rows: DataFrame, wanted: int) -> DataFrame:
    """(cls, id, vec, place): the ``wanted`` smallest ids of equal vectors, and the first of them."""
    order = Window.partitionBy("vec").orderBy("id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.distinct().select(
        F.first("id").over(so_far).alias("cls"), "id", "vec", F.row_number().over(order).alias("place")
    )
    return ranked.filter(F.col("place") <= wanted)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * rows.itemsize * rows.shape[1]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(rows)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), buffers).cast(pa.binary())


def _matrix(column, dtype, width: int) -> np.ndarray:
    """The matrix whose rows are these bytes."""
    return np.frombuffer(b"".join(one_array(column).to_pylist()), dtype).reshape(-1, width)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    prefix: int = 96,
    rerank_factor: float = 12.0,
    max_pivots: int = 4096,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``is_query`` over the column ``id`` its
    ``k`` nearest others, ties to the smaller id.

    ``prefix``: pivots in a permutation. ``rerank_factor``: see ``reranked``. These two set the
    recall; nothing else is cut.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col), "ann-rows")
    members = materialize(_members(rows, k + 1), "ann-members")
    classes = members.filter("place = 1").select("cls", "vec")
    asked = rows.filter(is_query).select(F.col("id").alias("query_id"), "vec").distinct()
    asked = materialize(asked.join(classes, "vec").select("query_id", "cls"), "ann-queries")

    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    size = classes.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("vec")).alias("d")).first()
    n, width = size["n"], size["d"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    wanted = n_pivots(n, max_pivots)
    sample = classes.orderBy(F.xxhash64(F.lit("pivot"), "cls"), "cls").limit(wanted).select("vec").collect()
    scale = float(size["norm"])

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x / scale
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(axis=1, keepdims=True)))
        return np.concatenate([x, rest], axis=1)

    def angle(x: np.ndarray) -> np.ndarray:
        """A query: its direction alone, without the last component."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return np.pad(x / np.sqrt((x**2).sum(axis=1, keepdims=True)), ((0, 0), (0, 1)))

    shared = spark.sparkContext.broadcast(lifted(np.array([r["vec"] for r in sample], float)))  # max_pivots vectors at most
    prefix = min(prefix, wanted)

    def nearest(x: np.ndarray) -> np.ndarray:
        near = -(x @ shared.value.T)
        some = np.sort(np.argpartition(near, prefix - 1, axis=1)[:, :prefix], axis=1)
        order = np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        return np.take_along_axis(some, order, axis=1).astype(np.int16)

    def permuted(placed):
        def task(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, STEP_ROWS):
                    part = batch.slice(at, STEP_ROWS)
                    x = _numbers(part.column("vec")).astype(np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("cls"), _binary(x), _binary(nearest(placed(x)))], names=["cls", "vec", "perm"]
                    )

        return task

    kind = "cls long, vec binary, perm binary"
    indexed = materialize(classes.mapInArrow(permuted(lifted), kind), "ann-index")
    asking = classes.join(asked.select("cls").distinct(), "cls").select("cls", "vec")
    queries = materialize(asking.mapInArrow(permuted(angle), kind), "ann-asking")

    per_task = -(-n // int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = -(-n // max(1, min(SHARD_BYTES // (8 * width), max(LEAST_SHARD, per_task))))
    blocks = max(1, -(-queries.count() // max(1, BLOCK_BYTES // (8 * width))))

    def dealt(table: DataFrame, asks: bool) -> DataFrame:
        own, other = F.pmod(F.xxhash64(F.lit(asks), "cls"), F.lit(blocks if asks else shards)), shards if asks else blocks
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))
        names = ("block", "shard") if asks else ("shard", "block")
        tiles = table.select("*", own.alias(names[0]), every.alias(names[1]), F.lit(asks).alias("asks"))
        return tiles.select("shard", "block", "asks", "cls", "vec", "perm")

    most = reranked(n, k, rerank_factor)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        asks = one_array(table["asks"])
        q, m = table.filter(asks), table.filter(pc.invert(asks))
        member, found = m["cls"].to_numpy(), []
        if q.num_rows and m.num_rows:
            x, y = (_matrix(t["vec"], np.float64, width) for t in (m, q))
            perm, own = (_matrix(t["perm"], np.int16, prefix) for t in (m, q))
            # the inverted files, one behind the other: classes and the place of the pivot in each
            order = np.argsort(perm.ravel(), kind="stable")
            listed, place = np.divmod(order.astype(np.int32), np.int32(prefix))
            starts = np.concatenate([[0], np.cumsum(np.bincount(perm.ravel(), minlength=wanted))])
            del order, perm
            steps = np.arange(prefix, dtype=np.int32)
            cut = max(k + 1, math.ceil(most * len(member) / n))
            for i, name in enumerate(q["cls"].to_pylist()):
                lengths = starts[own[i] + 1] - starts[own[i]]
                ends = np.cumsum(lengths)
                at = np.arange(ends[-1]) + np.repeat(starts[own[i]] - (ends - lengths), lengths)
                # a pivot in both permutations spares twice what it lies before the end in both
                spared = prefix - np.maximum(place[at], np.repeat(steps, lengths))
                near = np.arange(len(member))
                if len(near) > cut:
                    gain = np.bincount(listed[at], weights=spared, minlength=len(member))
                    near = np.sort(np.argpartition(-gain, cut - 1)[:cut])
                score = (x[near] * y[i]).sum(axis=1)
                top = np.lexsort((member[near], -score))[: k + 1]
                found.append((np.full(len(top), name), member[near[top]], score[top]))
        parts = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0), np.zeros(0), np.zeros(0)]
        return pa.table({"query": parts[0].astype(np.int64), "cls": parts[1].astype(np.int64), "score": parts[2]})

    both = dealt(queries, True).unionByName(dealt(indexed, False))
    hits = both.groupBy("shard", "block").applyInArrow(compare, "query long, cls long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    hits = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    # only classes of several ids have more to add
    copies = members.filter("place > 1").groupBy("cls").agg(F.collect_list("id").alias("more"))
    ids = F.explode(F.concat(F.array("cls"), F.coalesce("more", F.array().cast("array<long>"))))
    hits = hits.join(copies, "cls", "left").select("query", ids.alias("id"), "score")
    hit = F.struct((-F.col("score")).alias("lost"), "id", "score")
    top = hits.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(hit)), 1, k + 1).alias("hits"))
    answered = asked.join(top, F.col("cls") == F.col("query")).select(
        "query_id", F.posexplode(F.expr(f"slice(filter(hits, h -> h.id != query_id), 1, {k})")).alias("place", "hit")
    )
    return answered.select(
        "query_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("hit.id").alias("id"),
        F.col("hit.score").alias("score"),
    )
