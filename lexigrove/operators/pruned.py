"""Nearest neighbours over cells: exact with pruning by the triangle inequality, or by the nearest cells alone.

Points are dealt to the cell of their nearest pivot. For a point p and a cell with pivot b, whose
members are between ``low`` and ``high`` away from b, no member is nearer to p than

    max(dist(p, b) - high, low - dist(p, b), (dist(p, b) - dist(p, own pivot)) / 2),

the last because members are nearer to b than to any other pivot. A point looks into its nearest
cells first; the k-th distance found there then rules out most other cells, and it goes to the rest.

Pivots are a sample of the points by a hash of their id. Large cells are cut by hash into slots, and
the points that look into a cell into parts, so a task gets two blocks of bounded size whatever the sizes
of cells. Cells beyond the nearest lie many to a block: a point goes once to a block that has cells it
wants, and meets only those there, so rows moved follow the number of blocks and not that of cells.
Equal vectors are merged before and given back after, so copies cost no pairs. Points without
structure (uniform directions in many dimensions) rule out little; then the work is that of all pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import check_broadcast_size, materialize, parallelism, uniform_hash
from .distances import nearest_columns, sq_distances
from .tiles import strips
from .vector_sums import list_column, matrix

BLOCK_ROWS = 1024
FAR_BYTES = 16 * 1024 * 1024  # vectors of one side of a task that looks into many cells
MAX_CELLS = 8192
PIECE = 1 << 21  # distances to pivots that a task holds at a time
SCREEN_PAIRS = 1 << 18  # products in single precision at a time, which stay in a core's cache
OUT_ROWS = 2048  # rows of a batch with vectors that goes back to Spark
OUT_PAIRS = 1 << 21  # pairs found that a task holds before it keeps the nearest
_FOUND = "src long, dst long, sq double"
# bounds are widened by this share of the largest norm, far above the rounding of distances
_SLACK = 1e-6


@dataclass
class Neighbours:
    """``src, dst, rank, distance``; how many distances were computed, and how many all pairs have."""

    rows: DataFrame
    distances: int
    all_distances: int


@dataclass
class _Cells:
    """Points by cell, and what is known of each cell; a few numbers per cell on the driver."""

    points: DataFrame  # id, vec, cell, own, near
    pivots: np.ndarray
    sizes: np.ndarray
    asked: np.ndarray  # points that have the cell among their nearest
    low: np.ndarray
    high: np.ndarray
    block_rows: int


def _pieces(batches, n_rows: int):
    """Record batches of at most ``n_rows`` rows, one at least."""
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, n_rows)):
            yield batch.slice(at, max(1, n_rows))


def _roots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(sq_distances(x, pivots), 0.0))


def build_cells(points: DataFrame, n: int, d: int, probe: int, cells: int | None, block_rows: int) -> _Cells:
    """Deal ``n`` points (id, vec) to cells; ``near`` lists the ``probe`` nearest ones of each point."""
    spark = points.sparkSession
    wanted = cells or min(MAX_CELLS, max(1, math.ceil(n / block_rows)))
    check_broadcast_size(8 * wanted * d, "pivots")
    rows = points.orderBy(uniform_hash(F.col("id"), "pivot"), "id").limit(wanted).collect()
    pivots = np.array([r["vec"] for r in rows], float).reshape(len(rows), d)
    shared = spark.sparkContext.broadcast(pivots)
    probe = min(probe, len(pivots))

    def assign(batches):
        for batch in _pieces(batches, PIECE // max(1, len(shared.value))):
            far = _roots(matrix(batch.column("vec")), shared.value)
            near = np.argsort(far, axis=1, kind="stable")[:, :probe].astype(np.int32)
            own = far[np.arange(len(far)), near[:, 0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(near[:, 0]), pa.array(own), list_column(near, pa.int32())],
                names=["id", "vec", "cell", "own", "near"],
            )

    dealt = points.mapInArrow(assign, "id long, vec array<double>, cell int, own double, near array<int>")
    dealt = materialize(dealt, "cells")
    own = F.when(F.col("wanted") == F.col("cell"), F.col("own"))
    known = dealt.select("cell", "own", F.explode("near").alias("wanted")).groupBy("wanted").agg(
        F.count("*").alias("asked"), F.count(own).alias("n"), F.min(own).alias("lo"), F.max(own).alias("hi")
    )
    sizes, asked = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    low, high = np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in known.collect():  # one row per cell
        c = r["wanted"]
        sizes[c], asked[c], low[c], high[c] = r["n"], r["asked"], r["lo"] or 0.0, r["hi"] or 0.0
    return _Cells(dealt, pivots, sizes, asked, low, high, block_rows)


def _look(cells: _Cells, queries: DataFrame, asked: np.ndarray, k: int) -> tuple[DataFrame, int]:
    """The k nearest members of each cell that a query (id, vec, wanted) looks into, and the distances.

    ``asked``: queries for each cell.
    """
    spark = queries.sparkSession
    splits = [
        (int(c), -(-int(cells.sizes[c]) // cells.block_rows), -(-int(asked[c]) // (4 * cells.block_rows)))
        for c in np.flatnonzero((cells.sizes > 0) & (asked > 0))
    ]
    splits = F.broadcast(spark.createDataFrame(splits, "cell int, n_subs int, n_parts int"))  # a row per cell

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def lot(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")

    looking = queries.withColumnRenamed("wanted", "cell").join(splits, "cell")
    looking = looking.withColumn("part", lot("n_parts")).withColumn("sub", each("n_subs"))
    there = cells.points.join(splits, "cell").withColumn("sub", lot("n_subs")).withColumn("part", each("n_parts"))
    both = [side.select("cell", "sub", "part", "id", "vec", F.lit(q).alias("asks")) for q, side in ((True, looking), (False, there))]

    def tile(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, x = table["id"].to_numpy(), matrix(table["vec"])
        src, dst = ids[asks], ids[~asks]
        if not len(src) or not len(dst):
            return pa.table({"src": src[:0], "dst": src[:0], "sq": np.zeros(0)})
        d2 = sq_distances(x[asks], x[~asks])
        d2[src[:, None] == dst[None, :]] = np.inf
        row, found, sq = nearest_columns(d2, dst, k)
        return pa.table({"src": src[row], "dst": found, "sq": sq})

    found = both[0].unionByName(both[1]).groupBy("cell", "sub", "part").applyInArrow(tile, _FOUND)
    return found, int((cells.sizes * asked).sum())


def _first(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("src").orderBy("sq", "dst")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _bounded(cells: _Cells, found: DataFrame, k: int) -> DataFrame:
    """The points with ``bound``, the k-th distance found so far, infinite with fewer."""
    bounds = found.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.max("sq").alias("sq"))
    bound = F.when(F.col("n") >= k, F.sqrt("sq")).otherwise(F.lit(float("inf")))
    rows = cells.points.join(bounds, "id", "left").select("id", "vec", "own", "near", bound.alias("bound"))
    return materialize(rows, "bounds")


def _wanted(batch: pa.RecordBatch, known, slack: float) -> np.ndarray:
    """Points x cells: the cells beyond the nearest that can hold one of the k nearest."""
    pivots, sizes, low, high = known
    far = _roots(matrix(batch.column("vec")), pivots)
    own, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "bound"))
    least = np.maximum(np.maximum(far - high, low - far), (far - own[:, None]) / 2)
    wanted = (least <= bound[:, None] + slack) & (sizes > 0)
    np.put_along_axis(wanted, matrix(batch.column("near"), np.int64), False, axis=1)
    return wanted


def _blocks(sizes: np.ndarray, block_rows: int, n: int, d: int, cores: int) -> tuple[np.ndarray, int, int]:
    """Slots of each cell, slots to a block, and parts of the points: about four tasks a core or more."""
    most = max(block_rows, min(FAR_BYTES // (8 * d), math.ceil(n / math.ceil(math.sqrt(4 * cores)))))
    return -(-sizes // block_rows), max(1, most // block_rows), max(1, math.ceil(n / most))


def _look_further(cells: _Cells, rows: DataFrame, n: int, d: int, k: int) -> tuple[DataFrame, int]:
    """The k nearest members of each block of cells for the points of ``_bounded``, and the distances.

    A cell has one slot for every ``block_rows`` members; a block is a run of slots. A task gets
    the members of a block and a part of the points that want one of its cells.
    """
    sc = rows.sparkSession.sparkContext
    slots, per_block, n_parts = _blocks(cells.sizes, cells.block_rows, n, d, parallelism(rows.sparkSession))
    first = np.cumsum(slots) - slots
    starts = first // per_block  # the blocks of a cell
    ends = (first + slots - 1) // per_block
    n_blocks = int(slots.sum()) // per_block + 1
    known = sc.broadcast((cells.pivots, cells.sizes, cells.low, cells.high))
    slack = _SLACK * max(1.0, float(np.sqrt((cells.pivots**2).sum(axis=1).max(initial=0.0))))
    piece = PIECE // max(1, len(cells.pivots))

    def count(batches):
        total = sum(int((_wanted(b, known.value, slack) @ cells_sizes).sum()) for b in _pieces(batches, piece))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    cells_sizes = cells.sizes.astype(np.int64)
    counted = rows.select("vec", "own", "near", "bound").mapInArrow(count, "n long").agg(F.sum("n").alias("n")).first()
    sent = "id long, vec array<double>, bound double, wanted array<int>, block int"

    def send(batches):
        for batch in _pieces(batches, piece):
            wanted = _wanted(batch, known.value, slack)
            for block in range(n_blocks):
                inside = np.flatnonzero((starts <= block) & (ends >= block) & (cells_sizes > 0))
                here = wanted[:, inside]
                asks = np.flatnonzero(here.any(axis=1))
                for at in range(0, len(asks), OUT_ROWS):
                    some = asks[at : at + OUT_ROWS]
                    row, col = np.nonzero(here[some])
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(inside[col].astype(np.int32)))
                    take = pa.array(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(take), batch.column("vec").take(take),
                            batch.column("bound").take(take), lists, pa.array(np.full(len(some), block, np.int32)),
                        ],
                        names=["id", "vec", "bound", "wanted", "block"],
                    )

    asking = rows.mapInArrow(send, sent).select(
        "id", "vec", "bound", "wanted", "block",
        F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part"), F.lit(-1).alias("cell"),
    )
    # a row per cell
    places = F.broadcast(
        rows.sparkSession.createDataFrame(
            [(int(c), int(slots[c]), int(first[c])) for c in np.flatnonzero(slots)], "cell int, n_slots int, first int"
        )
    )
    slot = F.col("first") + F.pmod(F.xxhash64("id"), F.col("n_slots").cast("long")).cast("int")
    there = cells.points.join(places, "cell").select(
        "id", "vec", F.lit(None).cast("double").alias("bound"), F.lit(None).cast("array<int>").alias("wanted"),
        F.floor(slot / per_block).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "cell",
    )

    def tile(table: pa.Table) -> pa.Table:
        cell = table["cell"].to_numpy()
        asks, ids = cell < 0, table["id"].to_numpy()
        out = [_no_pairs()]
        if asks.any() and not asks.all():
            x = matrix(table["vec"])
            chosen = table.filter(pa.array(asks))
            lists = chosen["wanted"].combine_chunks()
            asker = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            target = lists.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(target, kind="stable")
            asker, target = asker[order], target[order]
            src, xs, limit = ids[asks], x[asks], (chosen["bound"].to_numpy() + slack) ** 2
            members = np.flatnonzero(~asks)
            members = members[np.argsort(cell[members], kind="stable")]
            of = cell[members]
            held, screen = 0, _Screen(x)
            for c in np.unique(of):
                rows_of = asker[np.searchsorted(target, c) : np.searchsorted(target, c, "right")]
                there = members[np.searchsorted(of, c) : np.searchsorted(of, c, "right")]
                members_here = screen.columns(x[there])
                for s, e in strips(len(rows_of), len(there)):
                    own = rows_of[s:e]
                    # what is beyond the k-th distance so far is not among the k nearest
                    row, col, sq = screen.within(xs, own, x[there], members_here, limit)
                    other = src[own][row] != ids[there][col]
                    row, col, sq = row[other], col[other], sq[other]
                    if not len(row):
                        continue
                    dst = ids[there][col]
                    order = np.lexsort((dst, sq, row))
                    row, dst, sq = row[order], dst[order], sq[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    last = np.flatnonzero(place == k - 1)
                    limit[own[row[last]]] = np.minimum(limit[own[row[last]]], (np.sqrt(sq[last]) + slack) ** 2)
                    near = place < k
                    out.append(pa.table({"src": src[own][row[near]], "dst": dst[near], "sq": sq[near]}))
                    held += int(near.sum())
                    if held > OUT_PAIRS:
                        out, held = [_best_of(out, k)], 0
        return _best_of(out, k)

    found = asking.unionByName(there).groupBy("block", "part").applyInArrow(tile, _FOUND)
    return found, int(counted["n"] or 0)


class _Screen:
    """Rules pairs out by products in single precision; distances of those left are computed in doubles."""

    def __init__(self, x: np.ndarray):
        self.most = float(np.einsum("ij,ij->i", x, x).max(initial=0.0))
        # twice what |x|^2 / 2 - x.y is off by, for vectors no longer than these
        self.slack = 2 * (x.shape[1] + 8) * 2.0**-23 * max(self.most, np.finfo(np.float32).tiny)

    def columns(self, y: np.ndarray) -> np.ndarray:
        """Vectors as columns, with a last row that takes off half of the squared norm."""
        return np.column_stack([y, np.einsum("ij,ij->i", y, y) / -2]).astype(np.float32).T

    def within(self, xs: np.ndarray, own: np.ndarray, y: np.ndarray, columns: np.ndarray, limit: np.ndarray):
        """Row, column and squared distance of the pairs of ``xs[own]`` with ``y`` within the ``limit`` of the row."""
        x = xs[own]
        least = (np.einsum("ij,ij->i", x, x) - limit[own]) / 2 - self.slack
        rows = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
        step = max(1, SCREEN_PAIRS // columns.shape[1])
        pairs = []
        for s in range(0, len(x), step):
            part = slice(s, s + step)
            # rounded down, so that a bound in single precision rules out no more
            floor = np.nextafter(least[part].astype(np.float32), np.float32(-np.inf))
            at = np.flatnonzero(rows[part] @ columns >= floor[:, None])
            row, col = np.divmod(at, columns.shape[1])
            if len(at) > SCREEN_PAIRS // 16:  # too many to take one by one
                sq = sq_distances(x[part], y)[row, col]
            else:
                a, b = x[part][row], y[col]
                scale = np.einsum("ij,ij->i", a, a) + np.einsum("ij,ij->i", b, b)
                sq = scale - 2.0 * np.einsum("ij,ij->i", a, b)
                sq[sq <= 1e-14 * scale] = 0.0
            close = sq <= limit[own[part]][row]
            pairs.append((row[close] + s, col[close], sq[close]))
        return tuple(np.concatenate(part) for part in zip(*pairs))


def _no_pairs() -> pa.Table:
    none = np.zeros(0, np.int64)
    return pa.table({"src": none, "dst": none, "sq": np.zeros(0)})


def _best_of(tables: list[pa.Table], k: int) -> pa.Table:
    """Per source the k nearest of several tables, ties to the smaller id."""
    table = pa.concat_tables(tables)
    src, dst, sq = (table[c].to_numpy() for c in ("src", "dst", "sq"))
    order = np.lexsort((dst, sq, src))
    ordered = src[order]
    place = np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
    return table.take(pa.array(order[place < k]))


def cell_neighbours(
    points: DataFrame,
    k: int = 10,
    id_col: str = "word_id",
    vec_col: str = "features",
    exact: bool = True,
    probe: int = 3,
    cells: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> Neighbours:
    """The k nearest other points of each point by Euclidean distance, ties to the smaller id.

    ``exact=False`` looks into the ``probe`` nearest cells alone: less work, and neighbours are lost
    beyond them; ``recall`` measures how many.
    """
    rows = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    merged = materialize(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "distinct")
    size = merged.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"), F.max("copies").alias("copies")).first()
    built = build_cells(merged.select("id", "vec"), size["n"], size["d"] or 1, probe, cells, block_rows)
    near = built.points.select("id", "vec", F.explode("near").alias("wanted"))
    found, n_distances = _look(built, near, built.asked, k)
    if exact and len(built.pivots) > probe:
        found = materialize(_first(found, k).drop("rank"), "near-cells")
        more, n_more = _look_further(built, _bounded(built, found, k), size["n"], size["d"] or 1, k)
        found, n_distances = found.unionByName(more), n_distances + n_more
    if (size["copies"] or 0) > 1:
        found = _with_copies(rows, merged, _first(found, k).drop("rank"), k)
    out = _first(found, k).select("src", "dst", "rank", F.sqrt("sq").alias("distance"))
    return Neighbours(out, n_distances, size["n"] ** 2)


def _with_copies(rows: DataFrame, merged: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Neighbours of every point from those of distinct vectors, which go by their smallest id.

    A point sees at most the k + 1 smallest ids of a vector, so larger groups of copies are cut there.
    """
    twins = rows.join(merged.where("copies > 1").select("vec", F.col("id").alias("rep")), "vec").select("rep", "id")
    twins = materialize(twins, "copies")
    smallest = Window.partitionBy("rep").orderBy("id")
    shown = twins.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1).select("rep", "id")
    ends = shown.withColumnRenamed("rep", "dst")
    spread = found.join(ends, "dst", "left").select("src", F.coalesce("id", "dst").alias("dst"), "sq")
    spread = spread.unionByName(shown.select(F.col("rep").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("sq")))
    best = _first(spread, k + 1).drop("rank")
    starts = twins.withColumnRenamed("rep", "src")
    every = best.join(starts, "src", "left").select(F.coalesce("id", "src").alias("src"), "dst", "sq")
    return every.where(F.col("src") != F.col("dst"))


def recall(graph: DataFrame, points: DataFrame, k: int, share: float, id_col: str = "word_id", vec_col: str = "features") -> float:
    """Share of the true neighbours that ``graph`` has, over a sample of the points by a hash of the id.

    The sample, at most 256 MiB of vectors, meets all points in blocks.
    """
    rows = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("recall"), "id"), F.lit(1 << 20)) < int(share * (1 << 20))).collect()
    ids, x = np.array([r["id"] for r in chosen], np.int64), np.array([r["vec"] for r in chosen], float)
    check_broadcast_size(x.nbytes, "the sample")
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def task(batches):
        own, queries = shared.value
        for batch in batches:
            if batch.num_rows and len(own):
                there = batch.column("id").to_numpy()
                d2 = sq_distances(queries, matrix(batch.column("vec")))
                d2[own[:, None] == there[None, :]] = np.inf
                row, dst, sq = nearest_columns(d2, there, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(dst), pa.array(sq)], names=["src", "dst", "sq"])

    true = _first(rows.mapInArrow(task, _FOUND), k).select("src", "dst")
    both = true.join(graph.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    got = both.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return got["hits"] / got["n"] if got["n"] else 1.0
