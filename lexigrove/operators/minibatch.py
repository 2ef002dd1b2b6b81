"""Mini-batch k-means: centres are running means over seeded batches of the points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, materialize, uniform_hash
from .kmeans import Clustering, as_points, batch_sums, center_sums, kmeans, label, require_k


def batch_table(rows: DataFrame, n_rows: int, batch_size: int, steps: int, seed: int) -> DataFrame:
    """``id, vec, step``: the rows of each step's batch, written one folder per step.

    In every epoch a hash of the id puts each row into one batch, so the points
    are scanned once for all steps and a step reads its own folder only.
    """
    per_epoch = max(1, math.ceil(n_rows / batch_size))
    epochs = math.ceil(steps / per_epoch)
    epoch = F.col("epoch")
    slot = uniform_hash(F.col("id"), F.concat_ws("-", F.lit(str(seed)), epoch.cast("string")))
    picked = (
        rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("step", (epoch * per_epoch + F.pmod(slot, F.lit(per_epoch))).cast("int"))
        .where(F.col("step") < steps)
        .select("id", "vec", "step")
    )
    return materialize(picked.repartition("step"), "batches", ["step"])


def update_centers(
    centers: np.ndarray, seen: np.ndarray, sums: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Running means after one batch; ``sums`` holds count, cost and vector sum per centre."""
    count = sums[:, 0]
    seen = seen + count
    rate = np.where(seen > 0, 1.0 / np.maximum(seen, 1.0), 0.0)
    return centers + rate[:, None] * (sums[:, 2:] - count[:, None] * centers), seen


def batch_totals(batch: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Count, cost and vector sum per centre over one batch, which has a bounded size."""
    if centers.nbytes > BROADCAST_BYTES:
        return center_sums(batch, centers)
    out = np.zeros((len(centers), centers.shape[1] + 2))
    for row in batch_sums(batch, centers).collect():
        out[row["cluster"]] += np.asarray(row["s"])
    return out


def seed_centers(rows: DataFrame, k: int, seed: int, n_init: int) -> np.ndarray:
    """``k`` starting centres from all rows, filled up with hashed points if seeding gives fewer.

    With fewer than ``k`` different points some centres repeat, and all but the first of
    them stay empty.
    """
    centers = kmeans(rows, k, seed, n_init, max_iter=1, id_col="id", vec_col="vec").centers
    if len(centers) < k:
        spare = rows.select("vec").distinct().orderBy(F.xxhash64(F.lit(seed), "vec"), "vec").limit(k)
        known = {tuple(c) for c in centers.tolist()}
        extra = [r["vec"] for r in spare.collect() if tuple(r["vec"]) not in known]
        centers = np.array([*centers.tolist(), *extra])
        centers = centers[np.arange(k) % len(centers)]
    return centers


def minibatch_kmeans(
    points: DataFrame,
    k: int,
    seed: int = 42,
    batch_size: int = 1024,
    steps: int = 100,
    n_init: int = 3,
    max_no_improvement: int | None = 10,
    init_centers: np.ndarray | None = None,
    id_col: str = "word_id",
    vec_col: str = "features",
) -> Clustering:
    """K-means on batches (Sculley, 2010); stops early when the smoothed cost stalls.

    ``converged`` says whether it did, or ran through all steps.
    """
    rows = as_points(points, id_col, vec_col)
    n_rows = rows.count()
    require_k(n_rows, k)
    batches = batch_table(rows, n_rows, max(batch_size, k), steps, seed)
    if init_centers is None:
        init_centers = seed_centers(rows, k, seed, n_init)
    centers = np.array(init_centers, np.float64)
    seen = np.zeros(len(centers))
    smooth = best = None
    step, stalled, converged = -1, 0, False
    weight = min(1.0, 2.0 * max(batch_size, k) / (n_rows + 1))
    for step in range(steps):
        sums = batch_totals(batches.where(F.col("step") == step).select("id", "vec"), centers)
        if not sums[:, 0].any():
            continue
        cost = sums[:, 1].sum() / sums[:, 0].sum()
        centers, seen = update_centers(centers, seen, sums)
        smooth = cost if smooth is None else smooth + weight * (cost - smooth)
        if best is None or smooth < best:
            best, stalled = smooth, 0
        else:
            stalled += 1
            if max_no_improvement is not None and stalled >= max_no_improvement:
                converged = True
                break
    labels = label(points, centers, id_col, vec_col)
    cost = float(center_sums(rows, centers)[:, 1].sum())
    return Clustering(labels, centers, cost, step + 1, converged)
