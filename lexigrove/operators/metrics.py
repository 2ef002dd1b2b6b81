"""Internal cluster-quality metrics for many labelings at once.

A labeling is one combination of ``keys``, for example (algorithm, k). The
assignments table is long: ``keys + id + cluster``. Vectors are stored once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dot, l2, sq_l2
from ..runtime import materialize, uniform_hash
from .distances import sq_distances
from .ranking import with_rank
from .tiles import block_rows_for, strips, unordered_tiles, with_block, with_group_block
from .vector_sums import list_column, matrix, sum_vectors

KEYS = ("algorithm", "k")
# Memory for the distance sums that one task holds (rows of a block x clusters).
SUMS_BYTES = 32 * 1024 * 1024
NOISE = 1e-12


def _at_least_two(n_clusters: Column, value: Column, metric: str) -> Column:
    message = F.lit(f"{metric} needs at least two clusters")
    return F.when(n_clusters < 2, F.raise_error(message).cast("double")).otherwise(value)


def _labeled(assignments: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    return assignments.where(F.col("cluster").isNotNull()).select(*keys, id_col, "cluster")


def cluster_stats(
    assignments: DataFrame,
    embeddings: DataFrame,
    keys: list[str] | tuple[str, ...] = KEYS,
    id_col: str = "word_id",
    vec_col: str = "features",
) -> DataFrame:
    """``keys, cluster, n, sq_norms, total``: size, sum of squared norms and vector sum.

    Centroids, WCSS and Calinski-Harabasz all follow from these rows, so the
    vectors are read once for every labeling together.
    """
    keys = list(keys)
    x = F.col(vec_col).cast("array<double>")
    packed = embeddings.select(
        id_col, F.concat(F.array(F.lit(1.0), dot(x, x)), x).alias("s")
    )
    rows = _labeled(assignments, keys, id_col).join(packed, id_col)
    sums = sum_vectors(rows, [*keys, "cluster"], "s")
    return sums.select(
        *keys,
        "cluster",
        F.col("s")[0].cast("long").alias("n"),
        F.col("s")[1].alias("sq_norms"),
        F.slice("s", 3, F.size("s") - 2).alias("total"),
    )


def centroids_from(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.select(
        *keys, "cluster", "n", F.transform("total", lambda t: t / F.col("n")).alias("centroid")
    )


def centroids(assignments, embeddings, keys=KEYS, id_col="word_id", vec_col="features"):
    """``keys, cluster, n, centroid``: mean vector of each cluster."""
    keys = list(keys)
    return centroids_from(cluster_stats(assignments, embeddings, keys, id_col, vec_col), keys)


def _within() -> Column:
    """Sum of squares of one cluster about its own mean."""
    w = F.col("sq_norms") - dot("total", "total") / F.col("n")
    return F.when(w <= NOISE * F.col("sq_norms"), F.lit(0.0)).otherwise(w)


def wcss_from(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.groupBy(*keys).agg(F.sum(_within()).alias("wcss"))


def wcss(assignments, embeddings, keys=KEYS, id_col="word_id", vec_col="features"):
    """Within-cluster sum of squares about the member means; empty clusters add nothing."""
    keys = list(keys)
    return wcss_from(cluster_stats(assignments, embeddings, keys, id_col, vec_col), keys)


def inertia(
    assignments: DataFrame,
    embeddings: DataFrame,
    centers: DataFrame,
    keys: list[str] | tuple[str, ...] = KEYS,
    id_col: str = "word_id",
    vec_col: str = "features",
) -> DataFrame:
    """Sum of squared distances to the centres of the model, ``keys, cluster, center``."""
    keys = list(keys)
    rows = _labeled(assignments, keys, id_col).join(
        embeddings.select(id_col, F.col(vec_col).alias("x")), id_col
    )
    return (
        rows.join(centers.select(*keys, "cluster", "center"), [*keys, "cluster"])
        .groupBy(*keys)
        .agg(F.sum(sq_l2("x", "center")).alias("inertia"))
    )


def cluster_count_check(
    assignments: DataFrame, keys: list[str] | tuple[str, ...] = KEYS, k_col: str = "k"
) -> DataFrame:
    """Distinct clusters per labeling, and how many fewer than ``k`` they are."""
    return (
        assignments.groupBy(*keys)
        .agg(F.count_distinct("cluster").alias("n_clusters"))
        .select("*", F.greatest(F.col(k_col) - F.col("n_clusters"), F.lit(0)).alias("shortfall"))
    )


def calinski_harabasz_from(stats: DataFrame, keys: list[str]) -> DataFrame:
    grand = sum_vectors(stats, keys, "total").select(*keys, dot("total", "total").alias("g2"))
    parts = stats.groupBy(*keys).agg(
        F.sum(dot("total", "total") / F.col("n")).alias("s2"),
        F.sum(_within()).alias("w"),
        F.sum("n").alias("points"),
        F.count("*").alias("clusters"),
    )
    between = F.col("s2") - F.col("g2") / F.col("points")
    ratio = (between / (F.col("clusters") - 1)) / (
        F.col("w") / (F.col("points") - F.col("clusters"))
    )
    value = F.when(F.col("w") == 0, F.lit(1.0)).otherwise(ratio)
    return parts.join(grand, keys).select(
        *keys,
        _at_least_two(F.col("clusters"), value, "Calinski-Harabasz").alias("calinski_harabasz"),
    )


def calinski_harabasz(assignments, embeddings, keys=KEYS, id_col="word_id", vec_col="features"):
    """Between-cluster over within-cluster dispersion, each per degree of freedom."""
    keys = list(keys)
    stats = materialize(
        cluster_stats(assignments, embeddings, keys, id_col, vec_col), "cluster-stats"
    )
    return calinski_harabasz_from(stats, keys)


def davies_bouldin_from(
    stats: DataFrame,
    assignments: DataFrame,
    embeddings: DataFrame,
    keys: list[str],
    id_col: str = "word_id",
    vec_col: str = "features",
    block_rows: int = 1024,
) -> DataFrame:
    centers = centroids_from(stats, keys)
    spread = (
        _labeled(assignments, keys, id_col)
        .join(embeddings.select(id_col, F.col(vec_col).alias("x")), id_col)
        .join(centers, [*keys, "cluster"])
        .groupBy(*keys, "cluster")
        .agg(F.avg(l2("x", "centroid")).alias("spread"))
    )
    # cluster values may be of any type; the tiles use a row number of our own
    rows = centers.join(spread, [*keys, "cluster"]).withColumn(
        "cid", F.xxhash64(*keys, "cluster")
    )
    types = dict(stats.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "cluster"]) + ", worst double"

    def tile(a: pa.Table, b: pa.Table | None) -> pa.Table:
        x, sx = matrix(a["centroid"]), a["spread"].to_numpy()
        y, sy = (x, sx) if b is None else (matrix(b["centroid"]), b["spread"].to_numpy())
        names = [*keys, "cluster"]
        if x.size == 0 or y.size == 0:
            empty = a.slice(0, 0).select(names)
            return empty.append_column("worst", pa.array([], pa.float64()))
        d = np.sqrt(sq_distances(x, y))
        ratio = np.divide(sx[:, None] + sy[None, :], d, out=np.zeros_like(d), where=d > 0)
        if b is None:
            np.fill_diagonal(ratio, 0.0)
            return a.select(names).append_column("worst", pa.array(ratio.max(axis=1)))
        both = pa.concat_tables([a.select(names), b.select(names)])
        worst = np.concatenate([ratio.max(axis=1), ratio.max(axis=0)])
        return both.append_column("worst", pa.array(worst))

    blocked = with_group_block(rows, keys, "cid", block_rows)
    return (
        unordered_tiles(blocked, keys, tile, schema)
        .groupBy(*keys, "cluster")
        .agg(F.max("worst").alias("worst"))
        .groupBy(*keys)
        .agg(F.avg("worst").alias("db"), F.count("*").alias("clusters"))
        .select(
            *keys,
            _at_least_two(F.col("clusters"), F.col("db"), "Davies-Bouldin").alias(
                "davies_bouldin"
            ),
        )
    )


def davies_bouldin(
    assignments, embeddings, keys=KEYS, id_col="word_id", vec_col="features", block_rows=1024
):
    """Mean over clusters of the worst (s_i + s_j) / d_ij; coincident centroids are skipped."""
    keys = list(keys)
    stats = materialize(
        cluster_stats(assignments, embeddings, keys, id_col, vec_col), "cluster-stats"
    )
    return davies_bouldin_from(
        stats, assignments, embeddings, keys, id_col, vec_col, block_rows
    )


def sample_points(
    embeddings: DataFrame,
    sample_size: int | None,
    seed: int | str = 42,
    id_col: str = "word_id",
) -> DataFrame:
    """The first ``sample_size`` rows by a seeded hash of the id; all rows without a size."""
    if sample_size is None:
        return embeddings
    picked = (
        embeddings.select(id_col)
        .orderBy(uniform_hash(F.col(id_col), seed), id_col)
        .limit(sample_size)
    )
    return embeddings.join(picked, id_col, "left_semi")


def silhouette_samples(
    assignments: DataFrame,
    embeddings: DataFrame,
    keys: list[str] | tuple[str, ...] = KEYS,
    id_col: str = "word_id",
    vec_col: str = "features",
    block_rows: int | None = None,
    max_columns: int | None = None,
) -> DataFrame:
    """``keys, id, cluster_size, a, b, silhouette`` with Euclidean distances, exact.

    Distances do not depend on the labeling, so each tile is computed once and
    summed per cluster for all labelings. Clusters are numbered over all
    labelings and handled ``max_columns`` at a time.
    """
    keys = list(keys)
    labeled = _labeled(assignments, keys, id_col).join(
        embeddings.select(id_col), id_col, "left_semi"
    )
    sizes = labeled.groupBy(*keys, "cluster").agg(F.count("*").alias("size"))
    order = [F.col(c).asc_nulls_first() for c in [*keys, "cluster"]]
    clusters = materialize(with_rank(sizes, order, "col"), "clusters")
    labelings = clusters.groupBy(*keys).agg(
        F.min("col").alias("labeling"), F.count("*").alias("clusters")
    )
    # one row per labeling; its first column number names it
    ranges = [
        (r["labeling"], r["clusters"])
        for r in labelings.orderBy("labeling").collect()
    ]
    if any(n < 2 for _, n in ranges):
        raise ValueError("silhouette needs at least two clusters in every labeling")

    own = labeled.join(clusters, [*keys, "cluster"]).join(
        labelings.select(*keys, "labeling"), keys
    )
    # one entry per labeling, so the list is as long as the suite is
    tags = own.groupBy(F.col(id_col).alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("col", "labeling", "size"))).alias("tags")
    )
    points = materialize(
        embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).join(tags, "id"),
        "silhouette-points",
    )
    stat = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    row_bytes = 8 * (stat["d"] or 1)
    block_rows = block_rows or block_rows_for(points, stat["n"], row_bytes)
    width = max_columns or max(64, SUMS_BYTES // (8 * block_rows))
    total = ranges[-1][0] + ranges[-1][1] if ranges else 0

    blocked = with_block(
        points.select("id", "vec", F.col("tags.col").alias("cols")),
        "id", stat["n"], block_rows,
    )
    parts = None
    for lo in range(0, total, width):
        hi = min(total, lo + width)
        tile = _distance_sums(lo, hi)
        sums = unordered_tiles(blocked, [], tile, "id long, s array<double>")
        sums = sum_vectors(sums, ["id"], "s")
        # at most ``width`` rows
        in_range = clusters.where((F.col("col") >= lo) & (F.col("col") < hi)).orderBy("col")
        size = np.array([r["size"] for r in in_range.select("size").collect()])
        part = sums.join(points.select("id", "tags"), "id").mapInArrow(
            _own_and_nearest(lo, hi, size, ranges),
            "id long, labeling long, size long, a double, b double",
        )
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("id", "labeling").agg(
        F.max("size").alias("cluster_size"), F.max("a").alias("a"), F.min("b").alias("b")
    )
    largest = F.greatest("a", "b")
    value = F.when((F.col("cluster_size") == 1) | (largest == 0), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / largest
    )
    return merged.join(labelings, "labeling").select(
        *keys, F.col("id").alias(id_col), "cluster_size", "a", "b", value.alias("silhouette")
    )


def _distance_sums(lo: int, hi: int):
    """Tile function: per point the sum of distances to each cluster numbered lo..hi-1."""

    def members(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        cols = table["cols"].combine_chunks()
        row = np.repeat(np.arange(len(cols)), cols.value_lengths().to_numpy(False))
        col = cols.flatten().to_numpy(zero_copy_only=False)
        keep = (col >= lo) & (col < hi)
        order = np.argsort(col[keep], kind="stable")
        return row[keep][order], col[keep][order] - lo

    def across(d: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Per row of ``d`` its sums over the columns of each cluster."""
        out = np.zeros((d.shape[0], hi - lo))
        if len(row):
            present, starts = np.unique(col, return_index=True)
            for c, s, e in zip(present, starts, [*starts[1:], len(col)]):
                out[:, c] = d[:, row[s:e]].sum(axis=1)
        return out

    def tile(a: pa.Table, b: pa.Table | None) -> pa.Table:
        if b is not None and not (a.num_rows and b.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "s": list_column(np.zeros((0, 1)))})
        x, (row_a, col_a) = matrix(a["vec"]), members(a)
        y, (row_b, col_b) = (x, (row_a, col_a)) if b is None else (matrix(b["vec"]), members(b))
        to_b, to_a = np.zeros((len(x), hi - lo)), np.zeros((len(y) if b is not None else 0, hi - lo))
        for s, e in strips(len(x), len(y)):
            d = np.sqrt(sq_distances(x[s:e], y))
            to_b[s:e] = across(d, row_b, col_b)
            if b is not None:
                here = (row_a >= s) & (row_a < e)
                present, starts = np.unique(col_a[here], return_index=True)
                ends = [*starts[1:], int(here.sum())]
                for c, first, last in zip(present, starts, ends):
                    to_a[:, c] += d[row_a[here][first:last] - s].sum(axis=0)
        out = pa.table({"id": a["id"], "s": list_column(to_b)})
        if b is None:
            return out
        return pa.concat_tables([out, pa.table({"id": b["id"], "s": list_column(to_a)})])

    return tile


def _own_and_nearest(lo: int, hi: int, size: np.ndarray, ranges: list[tuple[int, int]]):
    """Mean distance to the own cluster and to the nearest other one, of clusters lo..hi-1."""
    spans = [(f, max(f, lo), min(f + n, hi)) for f, n in ranges if f < hi and f + n > lo]

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sums = matrix(batch.column("s"))
            tags = batch.column("tags")
            row_of = np.repeat(np.arange(len(tags)), tags.value_lengths().to_numpy(False))
            flat = tags.flatten()
            col, labeling, own_size = (
                flat.field(f).to_numpy(zero_copy_only=False) for f in range(3)
            )
            ids = batch.column("id").to_numpy()
            for first, start, end in spans:
                here = labeling == first
                rows, own, n_own = row_of[here], col[here], own_size[here]
                block = sums[rows, start - lo : end - lo]
                inside = (own >= start) & (own < end)
                at = np.where(inside, own - start, 0)
                index = np.arange(len(rows))
                a = np.where(inside, block[index, at] / np.maximum(n_own - 1, 1), -np.inf)
                means = block / size[start - lo : end - lo]
                means[index[inside], at[inside]] = np.inf
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": ids[rows],
                        "labeling": np.full(len(rows), first),
                        "size": n_own,
                        "a": a,
                        "b": means.min(axis=1),
                    }
                )

    return run


def silhouette(
    assignments: DataFrame,
    embeddings: DataFrame,
    keys: list[str] | tuple[str, ...] = KEYS,
    sample_size: int | None = None,
    seed: int | str = 42,
    id_col: str = "word_id",
    vec_col: str = "features",
    **options,
) -> DataFrame:
    """Mean silhouette per labeling and the points it is taken over: all, or a seeded sample."""
    keys = list(keys)
    points = sample_points(embeddings, sample_size, seed, id_col)
    values = silhouette_samples(assignments, points, keys, id_col, vec_col, **options)
    return values.groupBy(*keys).agg(
        F.avg("silhouette").alias("silhouette"), F.count("*").alias("silhouette_points")
    )


def evaluate(
    assignments: DataFrame,
    embeddings: DataFrame,
    keys: list[str] | tuple[str, ...] = KEYS,
    sample_size: int | None = None,
    seed: int | str = 42,
    id_col: str = "word_id",
    vec_col: str = "features",
    **options,
) -> DataFrame:
    """One row per labeling: points, clusters, the four metrics and the points of the silhouette."""
    keys = list(keys)
    stats = materialize(
        cluster_stats(assignments, embeddings, keys, id_col, vec_col), "cluster-stats"
    )
    counts = stats.groupBy(*keys).agg(
        F.sum("n").alias("n_points"), F.count("*").alias("n_clusters")
    )
    return (
        counts.join(wcss_from(stats, keys), keys)
        .join(
            silhouette(
                assignments, embeddings, keys, sample_size, seed, id_col, vec_col,
                **options,
            ),
            keys,
        )
        .join(davies_bouldin_from(stats, assignments, embeddings, keys, id_col, vec_col), keys)
        .join(calinski_harabasz_from(stats, keys), keys)
    )
