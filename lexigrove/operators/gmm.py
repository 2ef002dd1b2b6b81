"""Gaussian mixture with diagonal covariances, fitted by expectation-maximisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import check_broadcast_size
from .kmeans import Clustering, as_points, kmeans, require_k
from .vector_sums import list_column, matrix, sum_vectors

REG_COVAR = 1e-6


def log_joint(
    x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray
) -> np.ndarray:
    """log(weight_j N(x_i; mean_j, diag variance_j)) as an n x k matrix."""
    precision = 1.0 / variances
    quadratic = (
        (x * x) @ precision.T - 2.0 * x @ (means * precision).T + (means**2 * precision).sum(1)
    )
    const = np.log(weights) - 0.5 * np.log(2 * np.pi * variances).sum(axis=1)
    return const - 0.5 * quadratic


def _parameters(totals: np.ndarray, n_rows: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances from k x (1 + 2d) sums of r, rx and rx^2."""
    d = (totals.shape[1] - 1) // 2
    mass = totals[:, :1] + 10 * np.finfo(np.float64).eps
    means = totals[:, 1 : d + 1] / mass
    variances = np.maximum(totals[:, d + 1 :] / mass - means**2, 0.0) + REG_COVAR
    return mass[:, 0] / n_rows, means, variances


def _collect(partial: DataFrame, k: int, d: int) -> tuple[np.ndarray, float, float]:
    """k rows of sums, and the log-likelihood and row count kept under component -1."""
    totals = np.zeros((k, 1 + 2 * d))
    likelihood = n_rows = 0.0
    for row in sum_vectors(partial, ["component"], "s", combine=False).collect():
        if row["component"] < 0:
            likelihood, n_rows = row["s"][0], row["s"][1]
        else:
            totals[row["component"]] = row["s"]
    return totals, likelihood, n_rows


def _expectation(rows: DataFrame, params: tuple[np.ndarray, ...]) -> DataFrame:
    """``component, s``: one task's sums of r, rx and rx^2 per component."""
    shared = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        held = None
        likelihood = n_rows = 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("vec"))
            joint = log_joint(x, *shared.value)
            top = joint.max(axis=1, keepdims=True)
            norm = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
            r = np.exp(joint - norm)
            sums = np.hstack([r.sum(axis=0)[:, None], r.T @ x, r.T @ (x * x)])
            held = sums if held is None else held + sums
            likelihood += norm.sum()
            n_rows += len(x)
        if held is not None:
            tail = np.zeros((1, held.shape[1]))
            tail[0, :2] = likelihood, n_rows
            component = np.arange(-1, len(held), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(component), list_column(np.vstack([tail, held]))], ["component", "s"]
            )

    return rows.mapInArrow(run, "component int, s array<double>")


def fit_labels(
    rows: DataFrame, labels: DataFrame, k: int, n_rows: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixture parameters of a hard labeling, ``id, cluster``."""
    packed = F.concat(F.array(F.lit(1.0)), F.col("vec"), F.transform("vec", lambda v: v * v))
    partial = rows.join(labels, "id").select(F.col("cluster").alias("component"), packed.alias("s"))
    found = sum_vectors(partial, ["component"], "s").collect()
    totals: dict[int, list[float]] = {row["component"]: row["s"] for row in found}
    width = len(next(iter(totals.values())))
    return _parameters(np.array([totals.get(j, [0.0] * width) for j in range(k)]), n_rows)


def gmm_diag(
    points: DataFrame,
    k: int,
    seed: int = 42,
    max_iter: int = 100,
    tol: float = 1e-3,
    init_labels: DataFrame | None = None,
    id_col: str = "word_id",
    vec_col: str = "features",
) -> Clustering:
    """Hard labels of the most likely component; ``cost`` is the mean log-likelihood.

    Starts from k-means labels unless ``init_labels`` (id, cluster) is given. A
    task sends k x (2d + 1) numbers per iteration, whatever the number of rows.
    """
    rows = as_points(points, id_col, vec_col).persist()
    try:
        n_rows = rows.count()
        require_k(n_rows, k)
        if init_labels is None:
            init_labels = kmeans(rows, k, seed, n_init=1, id_col="id", vec_col="vec").labels
        else:
            init_labels = init_labels.select(F.col(id_col).alias("id"), "cluster")
        params = fit_labels(rows, init_labels, k, n_rows)
        d = params[1].shape[1]
        check_broadcast_size(2 * params[1].nbytes, "mixture parameters")
        previous, step, done = None, 0, False
        for step in range(1, max_iter + 1):
            totals, likelihood, seen = _collect(_expectation(rows, params), k, d)
            params = _parameters(totals, seen)
            current = likelihood / seen
            done = previous is not None and abs(current - previous) < tol
            previous = current
            if done:
                break
    finally:
        rows.unpersist()
    labels = _most_likely(points, params, id_col, vec_col)
    return Clustering(labels, params[1], previous, step, done)


def _most_likely(points, params, id_col, vec_col) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = log_joint(matrix(batch.column("vec")), *shared.value).argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(at.astype(np.int32))], ["id", "cluster"]
                )

    rows = as_points(points, id_col, vec_col)
    schema = f"id {dict(rows.dtypes)['id']}, cluster int"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
