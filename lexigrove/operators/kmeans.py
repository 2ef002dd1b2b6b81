"""K-means: best of several restarts, and full-batch steps from given centres."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, parallelism
from .distances import sq_distances
from .vector_sums import grouped_sum, list_column, matrix, sum_vectors

PART_BYTES = (1 << 20, 32 << 20)  # of packed vectors in a task: at least, where others are free, and at most
PARTIAL_BYTES = 16 << 20  # of partial sums that the driver adds up
WAVE_BYTES = 16 << 20  # of centres that move in one pass


@dataclass
class Clustering:
    """Labels of every point, the model's centres if it has any, their cost, and how the fit ended."""

    labels: DataFrame
    centers: np.ndarray | None = None
    cost: float | None = None
    iterations: int | None = None
    converged: bool | None = None


def as_points(points: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return points.select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    )


def require_k(n_points: int, k: int) -> None:
    if not 1 <= k <= n_points:
        raise ValueError(f"k = {k} must lie between 1 and the number of points, {n_points}")


def nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (the first of equals) and the squared distance."""
    best = np.zeros(len(x), np.int64)
    low = np.full(len(x), np.inf)
    step = max(1, 4_000_000 // max(1, len(x)))
    for start in range(0, len(centers), step):
        d2 = sq_distances(x, centers[start : start + step])
        at = d2.argmin(axis=1)
        value = d2[np.arange(len(x)), at]
        closer = value < low
        best[closer], low[closer] = at[closer] + start, value[closer]
    return best, low


def assign(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """``id, vec, cluster, sq`` for ``rows`` of ``id, vec``.

    Centres are sent to the tasks in slices below the broadcast limit; with more
    than one slice the best centre so far travels along with the row.
    """
    sc = rows.sparkSession.sparkContext
    per_slice = max(1, BROADCAST_BYTES // (8 * centers.shape[1]))
    out = rows.withColumn("cluster", F.lit(-1)).withColumn("sq", F.lit(float("inf")))
    schema = out.schema

    def pass_over(shared, offset: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                at, sq = nearest_center(matrix(batch.column("vec")), shared.value)
                old_at = batch.column("cluster").to_numpy()
                old_sq = batch.column("sq").to_numpy()
                closer = sq < old_sq
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("vec"),
                        pa.array(np.where(closer, at + offset, old_at).astype(np.int32)),
                        pa.array(np.where(closer, sq, old_sq)),
                    ],
                    ["id", "vec", "cluster", "sq"],
                )

        return run

    for offset in range(0, len(centers), per_slice):
        shared = sc.broadcast(centers[offset : offset + per_slice])
        out = out.mapInArrow(pass_over(shared, offset), schema)
    return out


def batch_sums(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """``cluster, s``: per task and cluster the count, the cost and the vector sum.

    Needs the centres of one broadcast; a task holds k x d numbers.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, c = matrix(batch.column("vec")), shared.value
            if held is None:
                held = np.zeros((len(c), c.shape[1] + 2))
            at, sq = nearest_center(x, c)
            present, codes = np.unique(at, return_inverse=True)
            stacked = np.column_stack([np.ones(len(x)), sq, x])
            held[present] += grouped_sum(codes, stacked, len(present))
        if held is not None:
            used = np.flatnonzero(held[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), list_column(held[used])], ["cluster", "s"]
            )

    return rows.mapInArrow(run, "cluster int, s array<double>")


def center_sums(rows: DataFrame, centers: np.ndarray) -> np.ndarray:
    """k x (2 + d) totals: count, cost and vector sum of the points nearest each centre."""
    one_slice = centers.nbytes <= BROADCAST_BYTES
    if one_slice:
        partial = batch_sums(rows, centers)
    else:
        packed = F.concat(F.array(F.lit(1.0), F.col("sq")), F.col("vec")).alias("s")
        partial = assign(rows, centers).select("cluster", packed)
    out = np.zeros((len(centers), centers.shape[1] + 2))
    # k rows come back; single points are added up inside their tasks first
    for row in sum_vectors(partial, ["cluster"], "s", combine=not one_slice).collect():
        out[row["cluster"]] = row["s"]
    return out


def lloyd(
    points: DataFrame,
    centers: np.ndarray,
    max_iter: int = 300,
    tol: float = 1e-4,
    id_col: str = "word_id",
    vec_col: str = "features",
) -> Clustering:
    """Full-batch k-means from given centres; an emptied cluster keeps its centre."""
    rows = as_points(points, id_col, vec_col).persist()
    centers = np.array(centers, np.float64)
    try:
        step, converged = 0, False
        for step in range(1, max_iter + 1):
            sums = center_sums(rows, centers)
            filled = sums[:, 0] > 0
            moved = centers.copy()
            moved[filled] = sums[filled, 2:] / sums[filled, :1]
            shift = ((moved - centers) ** 2).sum(axis=1).max()
            centers = moved
            if shift <= tol * tol:
                converged = True
                break
        # of the centres returned, not of those before the last move
        cost = float(center_sums(rows, centers)[:, 1].sum())
        return Clustering(label(points, centers, id_col, vec_col), centers, cost, step, converged)
    finally:
        rows.unpersist()


def label(
    points: DataFrame, centers: np.ndarray, id_col: str = "word_id", vec_col: str = "features"
) -> DataFrame:
    """``id, cluster`` with the nearest centre of every point."""
    labeled = assign(as_points(points, id_col, vec_col), np.asarray(centers, np.float64))
    return labeled.select(F.col("id").alias(id_col), "cluster")


def kmeans(
    points: DataFrame,
    k: int,
    seed: int = 42,
    n_init: int = 10,
    max_iter: int = 300,
    tol: float = 1e-4,
    init: str = "k-means||",
    parallel_restarts: int = 4,
    id_col: str = "word_id",
    vec_col: str = "features",
) -> Clustering:
    """K-means of ``n_init`` seeds; the one with the least cost wins.

    The starting centres come from the JVM. All restarts move in one pass over packed vectors; those
    that have converged leave it. The cost is that of the last pass, about the centres before its move.
    """
    rows = points.select(
        F.col(id_col).alias("id"), array_to_vector(F.col(vec_col)).alias("vec")
    ).persist()
    try:
        n_points = rows.count()
        require_k(n_points, k)

        def start(restart: int) -> np.ndarray:
            model = KMeans(
                featuresCol="vec", predictionCol="cluster", k=k, seed=seed + restart,
                initMode=init, maxIter=0, tol=tol,
            ).fit(rows)
            return np.array(model.clusterCenters())

        if n_init == 1:
            starts = [start(0)]
        else:
            with ThreadPool(min(n_init, parallel_restarts)) as pool:
                starts = pool.map(inheritable_thread_target(rows.sparkSession)(start), range(n_init))
        fits = _restarts(rows, n_points, starts, max_iter, tol)
    finally:
        rows.unpersist()
    cost, _, centers, steps = min(fits, key=lambda f: f[:2])
    return Clustering(label(points, centers, id_col, vec_col), centers, cost, steps, steps < max_iter)


def _pack(rows: DataFrame, n_points: int, width: int) -> tuple[DataFrame, int]:
    """``block``, the vectors of some rows as bytes, dealt evenly however few files they come from; number of parts."""
    size = 8 * width * n_points
    parts = max(1, min(parallelism(rows.sparkSession), -(-size // PART_BYTES[0])), -(-size // PART_BYTES[1]))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([matrix(batch.column("vec")).tobytes()])], ["block"])

    vectors = rows.select(vector_to_array("vec").alias("vec"))
    return vectors.repartition(parts).mapInArrow(run, "block binary"), parts


def _stacked_sums(packed: DataFrame, parts: int, stacks: list[np.ndarray]) -> list[np.ndarray]:
    """For each set of centres k x (2 + d) totals, as ``center_sums``; all sets in one pass over ``parts`` tasks."""
    width, cuts = stacks[0].shape[1], np.cumsum([0, *map(len, stacks)]).tolist()
    shared = packed.sparkSession.sparkContext.broadcast(np.concatenate(stacks))

    def run(batches):
        centers = shared.value
        held = np.zeros((len(centers), width + 2))
        step = max(1, 2_000_000 // len(centers))
        for batch in batches:
            for block in batch.column("block"):
                vectors = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, width)
                for at in range(0, len(vectors), step):
                    x = vectors[at : at + step]
                    d2, each = sq_distances(x, centers), np.arange(len(x))
                    member = np.zeros(d2.shape)
                    for lo, hi in zip(cuts, cuts[1:]):
                        best = lo + d2[:, lo:hi].argmin(axis=1)
                        member[each, best] = 1
                        held[:, 1] += np.bincount(best, d2[each, best], len(centers))
                    held[:, 0] += member.sum(axis=0)
                    held[:, 2:] += member.T @ x
        used = np.flatnonzero(held[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), list_column(held[used])], ["cluster", "s"])

    partial = packed.mapInArrow(run, "cluster int, s array<double>")
    if parts * 8 * cuts[-1] * (width + 2) > PARTIAL_BYTES:
        partial = sum_vectors(partial, ["cluster"], "s", combine=False)
    out = np.zeros((cuts[-1], width + 2))
    for row in partial.collect():
        out[row["cluster"]] += row["s"]
    shared.unpersist()
    return [out[lo:hi] for lo, hi in zip(cuts, cuts[1:])]


def _restarts(
    rows: DataFrame, n_points: int, starts: list[np.ndarray], max_iter: int, tol: float
) -> list[tuple[float, int, np.ndarray, int]]:
    """(cost, restart, centres, steps) of full-batch k-means from each start; an emptied cluster keeps its centre."""
    fits = [(0.0, r, centers, 0) for r, centers in enumerate(starts)]
    if starts[0].nbytes > BROADCAST_BYTES:  # centres go in slices
        packed, parts, wave = rows.select("id", vector_to_array("vec").alias("vec")), 0, 1
    else:
        packed, parts = _pack(rows, n_points, starts[0].shape[1])
        wave = max(1, WAVE_BYTES // starts[0].nbytes)
    packed = packed.persist()
    try:
        for first in range(0, len(starts), wave):
            moving = list(range(first, min(first + wave, len(starts))))
            for step in range(1, max_iter + 1):
                sets = [fits[r][2] for r in moving]
                sums = _stacked_sums(packed, parts, sets) if parts else [center_sums(packed, sets[0])]
                still = []
                for r, old, s in zip(moving, sets, sums):
                    filled = s[:, 0] > 0
                    moved = old.copy()
                    moved[filled] = s[filled, 2:] / s[filled, :1]
                    fits[r] = float(s[:, 1].sum()), r, moved, step
                    if ((moved - old) ** 2).sum(axis=1).max() > tol * tol:
                        still.append(r)
                moving = still
                if not moving:
                    break
        return fits
    finally:
        packed.unpersist()
