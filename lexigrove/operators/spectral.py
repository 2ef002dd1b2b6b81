"""Spectral clustering on the nearest-neighbour graph.

The embedding comes from block subspace iteration with a Chebyshev filter on the
normalised affinity S, whose eigenvalues lie in [-1, 1]; the largest belong to
the smoothest directions of the graph. The N x k basis stays a DataFrame; only
k x k products reach the driver. While the packed edges fit a task, it takes them
through all terms of the filter for some columns; larger graphs are joined with
the basis term by term.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import check_broadcast_size, materialize, parallelism
from .kmeans import Clustering, kmeans, require_k
from .knn import knn_graph, normalized_affinity
from .ranking import with_rank
from .vector_sums import list_column, matrix, sum_vectors


# A graph whose packed edges fit a task (12 bytes each) is multiplied there, with some columns of the basis.
EDGE_BYTES = 160 * 1024 * 1024
GRAPH_ROWS = 65_536  # of a block of the packed graph and basis
_BASIS = "block int, v binary"


@dataclass
class Embedding:
    """``id, features`` of every point, the Laplacian's eigenvalues, and how the rounds ended."""

    rows: DataFrame
    values: np.ndarray
    rounds: int
    converged: bool


def _start(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Values in [-0.5, 0.5) that depend on id, column and seed only (splitmix64)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)
        z = (z + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z.astype(np.float64) / 2.0**64 - 0.5


def _random_basis(ids: DataFrame, width: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _start(batch.column("id").to_numpy(), width, seed)
                yield pa.RecordBatch.from_arrays([batch.column("id"), list_column(v)], ["id", "v"])

    return ids.mapInArrow(run, "id long, v array<double>")


def _multiply(edges: DataFrame, basis: DataFrame, scale: float = 1.0) -> DataFrame:
    """Rows of S V times ``scale``, not yet added up; ``edges`` hold S as src, dst, s."""
    return edges.join(basis.withColumnRenamed("id", "dst"), "dst").select(
        F.col("src").alias("id"),
        F.transform("v", lambda x: x * F.col("s") * F.lit(scale)).alias("v"),
    )


def _scaled(basis: DataFrame, scale: float) -> DataFrame:
    return basis.select("id", F.transform("v", lambda x: x * F.lit(scale)).alias("v"))


def _filter(edges: DataFrame, basis: DataFrame, cut: float, degree: int) -> DataFrame:
    """Chebyshev polynomial of S applied to V: grows what lies above ``cut``.

    The polynomial stays within [-1, 1] on [-1, cut] and rises steeply above it.
    Every term is written out, since the next two terms both read it.
    """
    center, half = (cut - 1.0) / 2.0, (cut + 1.0) / 2.0

    def term(now: DataFrame, factor: float, before: DataFrame | None) -> DataFrame:
        parts = _multiply(edges, now, factor / half).unionByName(
            _scaled(now, -factor * center / half)
        )
        if before is not None:
            parts = parts.unionByName(_scaled(before, -1.0))
        return materialize(sum_vectors(parts, ["id"], "v"), "basis")

    before, now = basis, term(basis, 1.0, None)
    for _ in range(degree - 1):
        before, now = now, term(now, 2.0, before)
    return now


def _gram(basis: DataFrame, other: str | None = None) -> np.ndarray:
    """V^T V, or V^T W for a second column; k x k numbers per task."""

    def run(batches):
        held = 0.0
        seen = False
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                held = held + v.T @ (matrix(batch.column(other)) if other else v)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), list_column(held.reshape(1, -1))], ["one", "g"]
            )

    partial = basis.mapInArrow(run, "one int, g array<double>")
    flat = np.array(sum_vectors(partial, ["one"], "g", combine=False).first()["g"])
    return flat.reshape(int(round(len(flat) ** 0.5)), -1)


def _rotate(basis: DataFrame, rotation: np.ndarray) -> DataFrame:
    shared = basis.sparkSession.sparkContext.broadcast(rotation)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v")) @ shared.value
                yield pa.RecordBatch.from_arrays([batch.column("id"), list_column(v)], ["id", "v"])

    return basis.select("id", "v").mapInArrow(run, "id long, v array<double>")


class _Rows:
    """The graph and bases as one row per node: ``id, v``; edges as rows."""

    def __init__(self, edges: DataFrame, degrees: DataFrame):
        self.degrees = degrees
        self.edges = materialize(edges.repartition("dst"), "edges").persist()

    def start(self, width: int, seed: int) -> DataFrame:
        return materialize(_random_basis(self.degrees.select("id"), width, seed), "basis")

    def filter(self, basis: DataFrame, width: int, cut: float, degree: int) -> DataFrame:
        return _filter(self.edges, basis, cut, degree)

    def gram(self, basis: DataFrame, width: int) -> np.ndarray:
        return _gram(basis)

    def image_gram(self, basis: DataFrame, width: int) -> np.ndarray:
        """V^T S V."""
        image = sum_vectors(_multiply(self.edges, basis), ["id"], "v").withColumnRenamed("v", "w")
        return _gram(basis.join(image, "id"), "w")

    def rotate(self, basis: DataFrame, rotation: np.ndarray) -> DataFrame:
        return materialize(_rotate(basis, rotation), "basis")

    def rows(self, basis: DataFrame, k: int) -> DataFrame:
        return basis

    def close(self) -> None:
        self.edges.unpersist()


class _Blocks:
    """The graph and bases packed in blocks of ``GRAPH_ROWS`` numbered nodes.

    A task takes the whole graph and some columns of a basis, which do not depend on each other, through
    all terms of a polynomial. So edges are sent once per polynomial and group of columns, not once per
    term, and no term is sent at all.
    """

    def __init__(self, edges: DataFrame, degrees: DataFrame, n_rows: int):
        self.n_rows = n_rows
        at = with_rank(degrees, [F.col("id")], "at")
        at = materialize(at.withColumn("block", F.floor(F.col("at") / GRAPH_ROWS).cast("int")), "numbered")

        def nodes(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            ids, degree = table["id"].to_numpy(), table["degree"].to_numpy()
            return pa.table({"block": table["block"][:1], "ids": [ids.tobytes()], "degrees": [degree.tobytes()]})

        self.nodes = materialize(at.groupBy("block").applyInArrow(nodes, "block int, ids binary, degrees binary"), "nodes")
        ends = edges.join(at.select(F.col("id").alias("src"), "block", F.col("at").alias("from")), "src")
        ends = ends.join(at.select(F.col("id").alias("dst"), F.col("at").cast("int").alias("to")), "dst")

        def pack(table: pa.Table) -> pa.Table:
            block = table["block"][0].as_py()
            rows = table["from"].to_numpy() - block * GRAPH_ROWS
            order = np.lexsort((table["to"].to_numpy(), rows))
            counts = np.bincount(rows, minlength=min(GRAPH_ROWS, n_rows - block * GRAPH_ROWS)).astype(np.int32)
            to, s = table["to"].to_numpy()[order].astype(np.int32), table["s"].to_numpy()[order]
            return pa.table(
                {"block": table["block"][:1], "counts": [counts.tobytes()], "to": [to.tobytes()], "s": [s.tobytes()]}
            )

        packed = ends.select("block", "from", "to", "s").groupBy("block").applyInArrow(
            pack, "block int, counts binary, to binary, s binary"
        )
        self.graph = materialize(packed, "graph")

    def start(self, width: int, seed: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                for block, ids in zip(batch.column("block"), batch.column("ids")):
                    v = _start(np.frombuffer(ids.as_buffer(), np.int64), width, seed)
                    yield _packed(block.as_py(), v)

        return materialize(self.nodes.mapInArrow(run, _BASIS), "basis")

    def filter(self, basis: DataFrame, width: int, cut: float, degree: int) -> DataFrame:
        center, half = (cut - 1.0) / 2.0, (cut + 1.0) / 2.0

        def polynomial(times, v):
            before, now = v, (times(v) - center * v) / half
            for _ in range(degree - 1):
                before, now = now, 2.0 / half * (times(now) - center * now) - before
            return now

        return materialize(self._by_columns(basis, width, polynomial), "basis")

    def gram(self, basis: DataFrame, width: int) -> np.ndarray:
        return _gram_of_blocks(basis, width)

    def image_gram(self, basis: DataFrame, width: int) -> np.ndarray:
        """V^T S V."""
        image = self._by_columns(basis, width, lambda times, v: times(v)).withColumnRenamed("v", "w")
        return _gram_of_blocks(basis.join(image, "block"), width, "w")

    def rotate(self, basis: DataFrame, rotation: np.ndarray) -> DataFrame:
        shared = basis.sparkSession.sparkContext.broadcast(rotation)

        def run(batches):
            for batch in batches:
                for block, v in zip(batch.column("block"), batch.column("v")):
                    yield _packed(block.as_py(), _unpacked(v, len(shared.value)) @ shared.value)

        return materialize(basis.mapInArrow(run, _BASIS), "basis")

    def rows(self, basis: DataFrame, k: int) -> DataFrame:
        """``id, v`` of every node, the first ``k`` columns."""
        n_blocks = math.ceil(self.n_rows / GRAPH_ROWS)

        def run(batches):
            for batch in batches:
                for ids, v in zip(batch.column("ids"), batch.column("v")):
                    ids = np.frombuffer(ids.as_buffer(), np.int64)
                    v = _unpacked(v, len(v.as_buffer()) // (8 * len(ids)))[:, :k]
                    for s in range(0, len(ids), 8192):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[s : s + 8192]), list_column(np.ascontiguousarray(v[s : s + 8192]))], ["id", "v"]
                        )

        both = self.nodes.join(basis, "block")
        rows = both.repartition(n_blocks, "block").mapInArrow(run, "id long, v array<double>")
        return rows.repartition("id").sortWithinPartitions("id")

    def close(self) -> None:
        pass

    def _by_columns(self, basis: DataFrame, width: int, polynomial) -> DataFrame:
        """``polynomial(times, v)`` of the basis, where ``times`` multiplies columns by S."""
        n_groups = min(width, parallelism(basis.sparkSession))
        edge_of = np.linspace(0, width, n_groups + 1).astype(int)
        every = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("part")
        none = F.lit(None).cast("binary")

        def split(batches):
            for batch in batches:
                for block, v in zip(batch.column("block"), batch.column("v")):
                    v = _unpacked(v, width)
                    for part, (lo, hi) in enumerate(zip(edge_of, edge_of[1:])):
                        piece = pa.array([np.ascontiguousarray(v[:, lo:hi]).tobytes()], pa.binary())
                        ends = [pa.array([x], pa.int32()) for x in (part, block.as_py())]
                        yield pa.RecordBatch.from_arrays([*ends, piece], ["part", "block", "v"])

        columns = basis.mapInArrow(split, "part int, block int, v binary")
        columns = columns.select("part", "block", none.alias("counts"), none.alias("to"), none.alias("s"), "v")
        graph = self.graph.select(every, "block", "counts", "to", "s", none.alias("v"))

        def run(table: pa.Table) -> pa.Table:
            part = table["part"][0].as_py()
            n_columns = int(edge_of[part + 1] - edge_of[part])
            pieces, held = [], []
            for block, counts, to, s, v in zip(*(table[c] for c in ("block", "counts", "to", "s", "v"))):
                if v.is_valid:
                    held.append((block.as_py(), _unpacked(v, n_columns)))
                else:
                    counts, to = np.frombuffer(counts.as_buffer(), np.int32), np.frombuffer(to.as_buffer(), np.int32)
                    first = np.cumsum(counts, dtype=np.int64) - counts
                    filled = np.flatnonzero(counts)
                    pieces.append((block.as_py() * GRAPH_ROWS + filled, first[filled], to, np.frombuffer(s.as_buffer())))
            held.sort(key=lambda b: b[0])

            def times(v: np.ndarray) -> np.ndarray:
                out = np.zeros_like(v)
                for rows, first, to, s in pieces:
                    for c in range(v.shape[1]):
                        out[rows, c] = np.add.reduceat(s * v[to, c], first)
                return out

            out = polynomial(times, np.asfortranarray(np.concatenate([v for _, v in held])))
            cuts = np.cumsum([len(v) for _, v in held])[:-1]
            return pa.table(
                {
                    "part": pa.array([part] * len(held), pa.int32()),
                    "block": pa.array([b for b, _ in held], pa.int32()),
                    "v": [np.ascontiguousarray(v).tobytes() for v in np.split(out, cuts)],
                }
            )

        done = columns.unionByName(graph).groupBy("part").applyInArrow(run, "part int, block int, v binary")

        def together(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            parts = [_unpacked(v, int(edge_of[p.as_py() + 1] - edge_of[p.as_py()])) for p, v in zip(table["part"], table["v"])]
            return pa.table({"block": table["block"][:1], "v": [np.hstack(parts).tobytes()]})

        return done.groupBy("block").applyInArrow(together, _BASIS)


def _packed(block: int, v: np.ndarray) -> pa.RecordBatch:
    v = np.ascontiguousarray(v).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([v], pa.binary())], ["block", "v"])


def _unpacked(v: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(v.as_buffer(), np.float64).reshape(-1, width)


def _gram_of_blocks(basis: DataFrame, width: int, other: str = "v") -> np.ndarray:
    """V^T V, or V^T W for a second column; k x k numbers per block."""

    def run(batches):
        for batch in batches:
            for v, w in zip(batch.column("v"), batch.column(other)):
                g = _unpacked(v, width).T @ _unpacked(w, width)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), list_column(g.reshape(1, -1))], ["one", "g"])

    partial = basis.mapInArrow(run, "one int, g array<double>")
    return np.array(sum_vectors(partial, ["one"], "g", combine=False).first()["g"]).reshape(width, width)


def spectral_embedding(affinity: DataFrame, k: int, seed: int = 42, **options) -> tuple[DataFrame, np.ndarray]:
    """``id, features`` (k columns, smoothest first) and the Laplacian's k eigenvalues."""
    found = fit_embedding(affinity, k, seed, **options)
    return found.rows, found.values


def fit_embedding(
    affinity: DataFrame,
    k: int,
    seed: int = 42,
    rounds: int = 10,
    degree: int = 6,
    oversample: int = 8,
    tol: float = 1e-3,
) -> Embedding:
    """The k smoothest eigenvectors, as rows of k columns.

    ``affinity`` is the output of ``normalized_affinity``. Rows are the
    eigenvectors divided by the square root of the degree. Rounds end when no
    eigenvalue moves by more than ``tol``; ``converged`` says whether that was
    met within ``rounds``.
    """
    degrees = affinity.groupBy(F.col("src").alias("id")).agg(
        F.max("src_degree").alias("degree")
    )
    edges = materialize(affinity.select("src", "dst", F.col("norm_w").alias("s")), "edges")
    degrees = materialize(degrees, "degrees")
    n_rows = degrees.count()
    require_k(n_rows, k)
    width = min(n_rows, k + oversample)
    check_broadcast_size(8 * width * width, "the k x k products")
    graph = _Blocks(edges, degrees, n_rows) if 12 * edges.count() <= EDGE_BYTES else _Rows(edges, degrees)
    basis = graph.start(width, seed)
    cut, previous, done, converged = 0.0, None, 0, False
    try:
        for done in range(1, rounds + 1):
            grown = graph.filter(basis, width, cut, degree)
            values, vectors = np.linalg.eigh(graph.gram(grown, width))
            values = np.maximum(values, values.max() * 1e-14)
            unit = graph.rotate(grown, vectors / np.sqrt(values))
            # Rayleigh-Ritz: the best eigenvectors within the block
            product = graph.image_gram(unit, width)
            values, vectors = np.linalg.eigh((product + product.T) / 2)
            values, vectors = values[::-1], vectors[:, ::-1]
            basis = graph.rotate(unit, vectors)
            moved = None if previous is None else np.abs(values[:k] - previous).max()
            if width == n_rows or (moved is not None and moved < tol):
                converged = True
                break
            cut, previous = float(np.clip(values[-1], -0.9, 0.99)), values[:k]
        features = graph.rows(basis, k).join(degrees, "id").select(
            "id",
            F.transform(F.slice("v", 1, k), lambda x: x / F.sqrt("degree")).alias("features"),
        )
        return Embedding(materialize(features, "spectral"), 1.0 - values[:k], done, converged)
    finally:
        graph.close()


def spectral_rows(
    points: DataFrame,
    k: int,
    seed: int = 42,
    n_neighbors: int = 10,
    id_col: str = "word_id",
    vec_col: str = "features",
    **options,
) -> Embedding:
    """Spectral coordinates; ``n_neighbors`` counts the point itself, whose edge is left out."""
    graph = knn_graph(points, max(1, n_neighbors - 1), id_col, vec_col)
    return fit_embedding(normalized_affinity(graph), k, seed, **options)


def spectral_labels(
    embedding: Embedding, k: int, seed: int = 42, n_init: int = 10, id_col: str = "word_id"
) -> Clustering:
    """K-means on the first k spectral coordinates.

    ``iterations`` are the eigenvalue rounds and the steps of k-means; ``converged`` if both did.
    """
    first = embedding.rows.select("id", F.slice("features", 1, k).alias("features"))
    fit = kmeans(first, k, seed, n_init, id_col="id")
    fit.labels = fit.labels.withColumnRenamed("id", id_col)
    fit.iterations += embedding.rounds
    fit.converged = bool(fit.converged and embedding.converged)
    return fit


def spectral(
    points: DataFrame,
    k: int,
    seed: int = 42,
    n_neighbors: int = 10,
    n_init: int = 10,
    id_col: str = "word_id",
    vec_col: str = "features",
    **options,
) -> Clustering:
    """kNN graph, normalised affinity, k smoothest eigenvectors, k-means on the rows."""
    rows = spectral_rows(points, k, seed, n_neighbors, id_col, vec_col, **options)
    return spectral_labels(rows, k, seed, n_init, id_col)


def power_iteration(
    points: DataFrame,
    k: int,
    max_iter: int = 20,
    n_neighbors: int = 10,
    id_col: str = "word_id",
    vec_col: str = "features",
) -> DataFrame:
    """``(id, cluster)`` by power iteration on the same graph: cheaper, and not the labels of ``spectral``.

    One random vector is multiplied ``max_iter`` times by the row-normalised affinity, and its entries
    are clustered: a step costs one message per edge, whatever ``k``. Points of different components of
    the graph differ only by the component's start values, so few steps tell them apart by chance.
    """
    affinity = normalized_affinity(knn_graph(points, max(1, n_neighbors - 1), id_col, vec_col))
    edges = materialize(affinity.filter("src < dst").select("src", "dst", "w"), "power-edges")
    found = PowerIterationClustering(k=k, maxIter=max_iter, weightCol="w").assignClusters(edges)
    return found.select(F.col("id").alias(id_col), "cluster")
