"""k nearest neighbours and the affinity graph built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .pruned import BLOCK_ROWS, cell_neighbours


def knn_graph(
    points: DataFrame,
    k: int = 10,
    id_col: str = "word_id",
    vec_col: str = "features",
    block_rows: int = BLOCK_ROWS,
    method: str = "exact",
    **options,
) -> DataFrame:
    """``(src, dst, rank, distance)``: the k nearest other points by Euclidean distance.

    ``method`` is ``exact``, which leaves out cells that cannot hold a neighbour, or ``approximate``,
    which looks into the ``probe`` nearest cells alone (``pruned.recall`` measures it). Ties go to the
    smaller id and a point is never its own neighbour.
    """
    if method not in ("exact", "approximate"):
        raise ValueError(f"no method {method}")
    options = {"probe": 8} | options if method == "approximate" else options
    return cell_neighbours(points, k, id_col, vec_col, method == "exact", block_rows=block_rows, **options).rows


def normalized_affinity(knn: DataFrame) -> DataFrame:
    """``(src, dst, w, src_degree, dst_degree, norm_w)`` of the symmetric kNN graph.

    ``w`` is (A + A^T) / 2 of the 0/1 neighbour matrix; ``norm_w`` is
    w / sqrt(d_src d_dst). Both directions of an edge are listed.
    """
    edges = knn.select("src", "dst")
    half = F.lit(0.5).alias("w")
    both = edges.select("src", "dst", half).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), half)
    )
    # a written copy: the degrees and the two lookups all read it
    sym = materialize(both.groupBy("src", "dst").agg(F.sum("w").alias("w")), "affinity")
    degree = sym.groupBy("src").agg(F.sum("w").alias("degree"))
    return (
        sym.join(degree.withColumnRenamed("degree", "src_degree"), "src")
        .join(
            degree.select(F.col("src").alias("dst"), F.col("degree").alias("dst_degree")), "dst"
        )
        .select(
            "src", "dst", "w", "src_degree", "dst_degree",
            (F.col("w") / F.sqrt(F.col("src_degree") * F.col("dst_degree"))).alias("norm_w"),
        )
    )
