"""Run the clustering suite for one or many k over the same vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.agglomerative import agglomerative
from ..operators.gmm import gmm_diag
from ..operators.kmeans import kmeans
from ..operators.metrics import evaluate
from ..operators.minibatch import minibatch_kmeans
from ..operators.spectral import spectral_labels, spectral_rows
from ..runtime import materialize

ALGORITHMS = (
    "MiniBatchKMeans",
    "Agglomerative_Cosine",
    "Spectral",
    "Voronoi_Partition",
    "Gaussian_Mixture",
)
# The cluster counts of the published sweep.
SWEEP_KS = (50, 100, 150, 200, 250, 300)
# Algorithms that run side by side, and fits of each.
PARALLEL_FITS = 5


def _together(run: Callable, items: Sequence, points: DataFrame) -> list:
    """``run`` of each item, in threads: most time of a fit is spent waiting for its many short jobs."""
    with ThreadPool(max(1, min(len(items), PARALLEL_FITS))) as pool:
        return pool.map(inheritable_thread_target(points.sparkSession)(run), items, chunksize=1)


def sweep(
    points: DataFrame,
    ks: Sequence[int] = SWEEP_KS,
    algorithms: Sequence[str] = ALGORITHMS,
    seed: int = 42,
    n_init: int = 10,
    id_col: str = "word_id",
    vec_col: str = "features",
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """``algorithm, k, id, cluster, inertia, iterations, converged`` for every algorithm and k, written once.

    A column ``word`` of the points stays with its id. ``inertia`` is the cost of the fit
    about its own centres, the same in all its rows; null where the fit has no centres.
    ``iterations`` and ``converged`` tell how the fit ended; null for the agglomeration, which has none.

    The fits do not depend on each other and run side by side.
    One merge tree serves every k of the agglomeration, and one set of spectral
    coordinates, at the largest k, serves every k of the spectral labels.
    """
    unknown = set(algorithms) - set(ALGORITHMS)
    if unknown:
        raise ValueError(f"unknown algorithms {sorted(unknown)}; choose from {ALGORITHMS}")
    options = options or {}
    ks = sorted(set(ks))
    cols = {"id_col": id_col, "vec_col": vec_col}
    named = [c for c in ("word",) if c in points.columns]
    points = points.select(id_col, *named, vec_col).persist()

    def fit(name: str) -> DataFrame:
        extra = options.get(name, {})
        if name == "Agglomerative_Cosine":
            return agglomerative(points, ks, **cols, **extra)
        if name == "Spectral":
            rows = spectral_rows(points, max(ks), seed, **cols, **extra)

            def one(k: int):
                return spectral_labels(rows, k, seed, n_init, id_col)
        elif name == "MiniBatchKMeans":
            def one(k: int):
                return minibatch_kmeans(points, k, seed, n_init=n_init, **cols, **extra)
        elif name == "Voronoi_Partition":
            def one(k: int):
                return kmeans(points, k, seed, n_init, **cols, **extra)
        else:
            def one(k: int):
                return gmm_diag(points, k, seed, **cols, **extra)
        fits = dict(zip(ks, _together(one, ks, points)))
        # only these fits have centres among the points, so that their cost is an inertia
        about = name in ("MiniBatchKMeans", "Voronoi_Partition")
        tables = [
            f.labels.select(
                "*", F.lit(k).alias("k"), F.lit(f.cost if about else None).alias("inertia"),
                F.lit(f.iterations).alias("iterations"), F.lit(f.converged).alias("converged"),
            )
            for k, f in fits.items()
        ]
        return reduce(DataFrame.unionByName, tables)

    try:
        parts = []
        for name, labels in zip(algorithms, _together(fit, algorithms, points)):
            ends = {"inertia": "double", "iterations": "int", "converged": "boolean"}
            ends = [(F.col(c) if c in labels.columns else F.lit(None)).cast(t).alias(c) for c, t in ends.items()]
            parts.append(
                labels.select(
                    F.lit(name).alias("algorithm"), F.col("k").cast("int"), id_col,
                    F.col("cluster").cast("int"), *ends,
                )
            )
        labels = reduce(DataFrame.unionByName, parts)
        if named:
            labels = labels.join(points.select(id_col, *named), id_col)
        return materialize(labels, "assignments", ["algorithm"])
    finally:
        points.unpersist()


def run_suite(points: DataFrame, k: int = 200, **kwargs) -> DataFrame:
    """The suite at one k."""
    return sweep(points, [k], **kwargs)


def metric_table(assignments: DataFrame, embeddings: DataFrame, **kwargs) -> DataFrame:
    """``k, Algorithm, WCSS, Silhouette, Davies_Bouldin, Calinski_Harabasz, Inertia, Iterations, Converged`` of a sweep.

    ``WCSS`` is about the member means, ``Inertia`` about the centres of the fit.
    """
    keys = ["algorithm", "k"]
    fits = assignments.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("inertia", "iterations", "converged")]
    )
    return evaluate(assignments, embeddings, keys, **kwargs).join(fits, keys).select(
        "k",
        F.col("algorithm").alias("Algorithm"),
        F.col("wcss").alias("WCSS"),
        F.col("silhouette").alias("Silhouette"),
        F.col("davies_bouldin").alias("Davies_Bouldin"),
        F.col("calinski_harabasz").alias("Calinski_Harabasz"),
        F.col("inertia").alias("Inertia"),
        F.col("iterations").alias("Iterations"),
        F.col("converged").alias("Converged"),
    )
