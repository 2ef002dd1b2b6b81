"""Average-linkage agglomeration on cosine distance, exact.

On unit vectors the mean pairwise cosine distance between clusters A and B is
1 - S_A.S_B / (n_A n_B), with S the vector sum. Average linkage is reducible:
no merge brings a cluster nearer to others than its parts were. So the merges up
to some height happen inside the components of the pairs up to that height, and
all reciprocal nearest pairs can be merged together; both give the tree of
one-at-a-time merging.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector_norm
from ..runtime import materialize, parallelism
from .kmeans import as_points, require_k
from .tiles import BLOCK_BYTES, MIN_BLOCK_ROWS, STRIP_PAIRS, blocks_of, strips
from .vector_sums import list_column, matrix

# Heights are compared at this many decimals, so equal heights fall back to ids.
DIGITS = 12
FOUND = "id long, height double, nn long"
EDGES = "id long, height double, nn long, level int"
GROUPS = "id long, bin long, pair long, most double"
# A phase writes the clusters after it and, in rows without id, its merges.
STEP = "id long, n long, total array<double>, left long, right long, height double, size long"
STEP_COLUMNS = ["id", "n", "total", "left", "right", "height", "size"]
TASK_CLUSTERS = 16_384  # that a task merges among themselves
BIN_CLUSTERS = 4_096  # of small components that go to a task together
SAMPLE = 512  # clusters whose nearest partners tell the heights of a phase
SHARES = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75)  # of clusters with a partner, where a phase may stop
CHUNK_COLUMNS, CHUNK_PAIRS = 2_048, 1 << 18  # products that stay in a core's cache
HELD_PAIRS = 1 << 18  # close pairs that a tile holds before it reduces them


def _by_id(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(table["vec"])[order]


def _lowest(a: pa.Table, b: pa.Table | None, both: bool) -> pa.Table:
    """Per row of ``a``, and with ``both`` of ``b``, the lowest height, ties to the smallest partner.

    Without ``b`` the rows of ``a`` among themselves.
    """
    if not a.num_rows or (b is not None and not b.num_rows):
        none = np.zeros(0, np.int64)
        return _found(none, np.zeros(0), none)
    ids_a, x = _by_id(a)
    ids_b, y = (ids_a, x) if b is None else _by_id(b)
    low_a, nn_a = np.zeros(len(x)), np.zeros(len(x), np.int64)
    low_b, nn_b = np.full(len(y), np.inf), np.zeros(len(y), np.int64)
    for s, e in strips(len(x), len(y)):
        h = _heights(x[s:e], y)
        if b is None:
            h[np.arange(e - s), np.arange(s, e)] = np.inf
        elif not both:
            h[ids_a[s:e, None] == ids_b[None, :]] = np.inf
        nn_a[s:e] = h.argmin(axis=1)
        low_a[s:e] = h[np.arange(e - s), nn_a[s:e]]
        if both:
            at = h.argmin(axis=0)
            low = h[at, np.arange(len(y))]
            lower = low < low_b
            low_b[lower], nn_b[lower] = low[lower], at[lower] + s
    found = _found(ids_a, low_a, ids_b[nn_a])
    return pa.concat_tables([found, _found(ids_b, low_b, ids_a[nn_b])]) if both else found


def _found(ids: np.ndarray, low: np.ndarray, nn: np.ndarray) -> pa.Table:
    known = np.isfinite(low)
    return pa.table({"id": ids[known], "height": low[known], "nn": nn[known]})


def _heights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.round(1.0 - x @ y.T, DIGITS)


def _components(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component, from those known (``label``, overwritten) and further edges."""
    while True:
        lo, hi = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        apart = lo != hi
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        np.minimum.at(label, hi[apart], lo[apart])
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def _slack(d: int) -> np.float32:
    """Twice what a product of two vectors, no longer than 1, is off by in single precision."""
    return np.float32(2 * (d + 4) * 2.0**-24 + 10.0**-DIGITS)


def _pair_heights(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Heights of rows ``u`` of ``x`` with rows ``v`` of ``y``, the same from either side."""
    step = max(1, STRIP_PAIRS // max(1, x.shape[1]))
    parts = [
        np.round(1.0 - np.einsum("ij,ij->i", x[u[s : s + step]], y[v[s : s + step]]), DIGITS)
        for s in range(0, len(u), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


class _Near:
    """What a tile knows of its nodes: the nearest partner, and who hangs together up to each height of ``levels``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: np.ndarray):
        self.ids, self.vectors, self.levels = ids, vectors, levels
        self.low, self.nn = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
        self.labels = [np.arange(len(ids)) for _ in levels]
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.held.append((u, v))
        self.n_held += len(u)
        if self.n_held > HELD_PAIRS:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        u, v = (np.concatenate(part) for part in zip(*self.held))
        self.held, self.n_held = [], 0
        h = _pair_heights(self.vectors, self.vectors, u, v)
        close = h <= self.levels[-1]
        u, v, h = u[close], v[close], h[close]
        node, other, height = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([h, h])
        order = np.lexsort((self.ids[other], height, node))
        order = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
        node, nn, height = node[order], self.ids[other[order]], height[order]
        lower = (height < self.low[node]) | ((height == self.low[node]) & (nn < self.nn[node]))
        self.low[node[lower]], self.nn[node[lower]] = height[lower], nn[lower]
        for at, most in enumerate(self.levels):
            self.labels[at] = _components(self.labels[at], u[h <= most], v[h <= most])

    def edges(self) -> pa.Table:
        """The nearest partner of each node that has one, and edges without height that join its components.

        ``level`` is the first height of ``levels`` that an edge holds up to.
        """
        self.flush()
        has = np.isfinite(self.low)
        parts = [(self.ids[has], self.low[has], self.nn[has], np.searchsorted(self.levels, self.low[has]))]
        below = np.arange(len(self.ids))
        for at, label in enumerate(self.labels):
            joined = label != below
            n, below = joined.sum(), label
            parts.append((self.ids[joined], np.full(n, np.nan), self.ids[label[joined]], np.full(n, at)))
        id_, height, nn, level = (np.concatenate(part) for part in zip(*parts))
        height = pa.array(height, mask=np.isnan(height))
        return pa.table({"id": id_, "height": height, "nn": nn, "level": pa.array(level, pa.int32())})


def _close_pairs(ids: np.ndarray, vectors: np.ndarray, n_first: int, levels: np.ndarray) -> pa.Table:
    """Edges, as ``_Near.edges``, of the pairs up to the last level: the first rows with the others, or with themselves.

    Products in single precision rule pairs out; those left are computed in doubles.
    """
    near = _Near(ids, vectors, levels)
    rows = vectors.astype(np.float32)
    own = n_first == len(ids)
    columns = np.ascontiguousarray((rows if own else rows[n_first:]).T)
    first_column = 0 if own else n_first
    floor = np.float32(1.0 - levels[-1]) - _slack(vectors.shape[1])
    width = min(CHUNK_COLUMNS, max(1, columns.shape[1]))
    step = max(1, CHUNK_PAIRS // width)
    for c in range(0, columns.shape[1], width):
        there = columns[:, c : c + width]
        for s in range(0, min(n_first, c + width) if own else n_first, step):
            found = np.flatnonzero(rows[s : min(s + step, n_first)] @ there >= floor)
            if len(found):
                u, v = np.divmod(found, there.shape[1])
                u, v = u + s, v + c + first_column
                if own:
                    u, v = u[u < v], v[u < v]
                near.add(u, v)
    return near.edges()


def _blocks_at(ids: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of each id (splitmix64)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((z ^ (z >> np.uint64(27))) % np.uint64(n_blocks)).astype(np.int32)


def _edges(state: DataFrame, count: int, levels: np.ndarray, block_rows: int) -> DataFrame:
    """``id, height, nn, level`` of the clusters with a partner up to the last level.

    More rows, without height, join the components of each level.

    Tiles of two blocks, whose rows travel packed: each row goes to as many tiles as there are blocks.
    """
    n_blocks = blocks_of(count, block_rows)

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            vectors = matrix(batch.column("total")) / batch.column("n").to_numpy()[:, None]
            at = _blocks_at(ids, n_blocks)
            for block in np.unique(at):
                here = at == block
                packed = [[int(block)], [ids[here].tobytes()], [vectors[here].tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(packed[0], pa.int32()), pa.array(packed[1]), pa.array(packed[2])], ["block", "ids", "vecs"]
                )

    packed = state.mapInArrow(pack, "block int, ids binary, vecs binary")
    sent = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        "block", "ids", "vecs",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
    )

    def tile(table: pa.Table) -> pa.Table:
        block = table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        first = int((block == block[order[0]]).sum())
        whole = block[order[0]] == block[order[-1]]
        if whole and table["lo"][0].as_py() != table["hi"][0].as_py():  # the other block is empty
            return _Near(np.zeros(0, np.int64), np.zeros((0, 1)), levels).edges()
        pieces = [np.frombuffer(table["ids"][int(i)].as_buffer(), np.int64) for i in order]
        ids = np.concatenate(pieces)
        vectors = [np.frombuffer(table["vecs"][int(i)].as_buffer(), np.float64) for i in order]
        vectors = np.concatenate(vectors).reshape(len(ids), -1)
        return _close_pairs(ids, vectors, sum(map(len, pieces[:first])), levels)

    return sent.groupBy("lo", "hi").applyInArrow(tile, EDGES)


def _groups(levels: np.ndarray, limit: int, bin_rows: int):
    """Task function: from edges, ``id, bin, pair, most`` of the clusters that merge with others of their bin.

    Components of at most ``limit`` clusters lie whole in a bin, and merge up to ``most``, the last level
    at which they are that small. Of what is left, pairs that name each other merge alone; ``pair`` tells
    them apart. A bin has one level.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, at = np.unique(np.concatenate([table["id"].to_numpy(), table["nn"].to_numpy()]), return_inverse=True)
        u, v = at[: table.num_rows], at[table.num_rows :]
        named, level = pc.is_valid(table["height"]).to_numpy(), table["level"].to_numpy()
        here = np.arange(len(ids))
        group, last = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        for up_to in reversed(range(len(levels))):
            edge = (level <= up_to) & (group[u] < 0) & (group[v] < 0)
            label = _components(here.copy(), u[edge], v[edge])
            size = np.bincount(label, minlength=len(ids))[label]
            small = (group < 0) & (size > 1) & (size <= limit)
            group[small], last[small] = label[small], up_to
        u, v, height = u[named], v[named], table["height"].to_numpy(zero_copy_only=False)[named]
        order = np.lexsort((v, height, u))
        order = order[np.flatnonzero(np.diff(u[order], prepend=-1))]
        nn = np.full(len(ids), -1)
        nn[u[order]] = v[order]
        mutual = (group < 0) & (nn >= 0) & (group[nn] < 0) & (nn[nn] == here)
        group[mutual], last[mutual] = np.minimum(here, nn)[mutual], len(levels)
        chosen = np.flatnonzero(group >= 0)
        chosen = chosen[np.lexsort((chosen, group[chosen], last[chosen]))]
        starts = np.flatnonzero(np.diff(group[chosen], prepend=-1))
        before = np.repeat(starts, np.diff(np.append(starts, len(chosen))))
        alone = mutual[chosen]
        return pa.table(
            {
                "id": ids[chosen],
                "bin": before // bin_rows * (len(levels) + 1) + last[chosen],
                "pair": pa.array(group[chosen], pa.int64(), mask=~alone),
                "most": np.append(levels, levels[-1])[last[chosen]],
            }
        )

    return run


def _nearest_rows(
    x: np.ndarray, columns: np.ndarray, wanted: np.ndarray, gone: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``wanted`` of ``x`` the lowest height to another row that is not ``gone``, and the first such row.

    ``columns`` holds ``x`` as columns in single precision.
    """
    slack, gone = _slack(x.shape[1]), np.flatnonzero(gone)
    best = np.full(len(wanted), -np.inf, np.float32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low, nn, n_found = np.full(len(wanted), np.inf), np.full(len(wanted), len(x)), 0
    width = min(CHUNK_COLUMNS, len(x))
    step = max(1, CHUNK_PAIRS // width)

    def settle() -> None:
        u, v = (np.concatenate(part) for part in zip(*found))
        h = _pair_heights(x, x, wanted[u], v)
        order = np.lexsort((v, h, u))
        order = order[np.flatnonzero(np.diff(u[order], prepend=-1))]
        u, v, h = u[order], v[order], h[order]
        lower = (h < low[u]) | ((h == low[u]) & (v < nn[u]))
        low[u[lower]], nn[u[lower]] = h[lower], v[lower]
        found.clear()

    for c in range(0, len(x), width):
        there = columns[:, c : c + width]
        skip = gone[(gone >= c) & (gone < c + width)] - c
        for s in range(0, len(wanted), step):
            asks = wanted[s : s + step]
            near = x[asks].astype(np.float32) @ there
            near[:, skip] = -np.inf
            own = np.flatnonzero((asks >= c) & (asks < c + width))
            near[own, asks[own] - c] = -np.inf
            least = np.maximum(near.max(axis=1), best[s : s + step])
            best[s : s + step] = least
            at = np.flatnonzero(near >= np.maximum(least - slack, np.float32(-4))[:, None])
            if len(at):
                u, v = np.divmod(at, there.shape[1])
                found.append((u + s, v + c))
                n_found += len(at)
                if n_found > HELD_PAIRS:
                    settle()
                    n_found = 0
    if found:
        settle()
    return low, nn


def _merge_up_to(
    ids: np.ndarray, n: np.ndarray, total: np.ndarray, most: float
) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """Merges up to the height ``most`` as (left, right, height, size), and the clusters left; ids ascend.

    Each round merges all pairs that name each other; a cluster whose partner is gone looks again.
    """
    merges, n, total = [], n.copy(), total.copy()
    mean = total / n[:, None]
    columns = np.ascontiguousarray(mean.astype(np.float32).T)
    gone = np.zeros(len(ids), bool)
    low, nn = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
    look = np.arange(len(ids))
    while len(ids) - gone.sum() > 1:
        low[look], nn[look] = _nearest_rows(mean, columns, look, gone)
        here = np.arange(len(ids))
        ready = ~gone & (low <= most)
        if not ready.any():
            break
        left = np.flatnonzero(ready & (nn[nn] == here) & (here < nn))
        if not len(left):  # only rounding can break reciprocity: take the lowest pair
            side = np.flatnonzero(ready)
            a, b = np.minimum(side, nn[side]), np.maximum(side, nn[side])
            first = np.lexsort((b, a, low[side]))[0]
            left, right, height = a[first : first + 1], b[first : first + 1], low[side[first : first + 1]]
        else:
            right, height = nn[left], low[left]
        total[left] += total[right]
        n[left] += n[right]
        mean[left] = total[left] / n[left][:, None]
        columns[:, left] = mean[left].T
        merges.append((ids[left], ids[right], height, n[left]))
        gone[right] = True
        taken = here.copy()
        taken[right] = left
        merged = np.zeros(len(ids), bool)
        merged[left] = True
        again = np.flatnonzero(~gone & ~merged & (merged | gone)[nn])
        # no other cluster is nearer than the partner was before it grew
        now = taken[nn[again]]
        height = _pair_heights(mean, mean, again, now)
        same = height <= low[again]
        nn[again[same]] = now[same]
        look = np.union1d(left, again[~same])
        if gone.sum() > len(ids) // 8:
            keep = ~gone
            place = np.cumsum(keep) - 1
            look = place[look]
            ids, n, total, mean, low = ids[keep], n[keep], total[keep], mean[keep], low[keep]
            columns = np.ascontiguousarray(columns[:, keep])
            nn, gone = np.maximum(place[nn[keep]], 0), np.zeros(len(ids), bool)
    return merges, ids[~gone], n[~gone], total[~gone]


def _merged(table: pa.Table) -> pa.Table:
    """The clusters of a bin after their merges up to its height, and the merges, as rows of ``STEP``."""
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    ids, n = table["id"].to_numpy()[order], table["n"].to_numpy()[order]
    total = matrix(table["total"])[order]
    if not table["pair"].null_count:
        by_pair = np.argsort(table["pair"].to_numpy()[order], kind="stable")
        a, b = by_pair[::2], by_pair[1::2]
        mean = total / n[:, None]
        merges = [(ids[a], ids[b], _pair_heights(mean, mean, a, b), n[a] + n[b])]
        ids, n, total = ids[a], n[a] + n[b], total[a] + total[b]
    else:
        merges, ids, n, total = _merge_up_to(ids, n, total, table["most"][0].as_py())
    left, right, height, size = (np.concatenate(part) for part in zip(*merges)) if merges else ([], [], [], [])
    clusters = pa.table({"id": ids, "n": n, "total": list_column(total)})
    steps = pa.table(
        {
            "left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64()),
            "height": pa.array(height, pa.float64()), "size": pa.array(size, pa.int64()),
        }
    )
    return pa.concat_tables([clusters, steps], promote_options="default").select(STEP_COLUMNS)


def _levels(state: DataFrame, count: int) -> np.ndarray:
    """Heights below which the ``SHARES`` of the clusters have a partner, from a sample by a hash of the id."""
    modulus = max(1, count // SAMPLE)
    mean = F.transform("total", lambda t: t / F.col("n")).alias("vec")
    everyone = state.select("id", mean)
    chosen = everyone.where(F.pmod(F.xxhash64(F.lit(count), "id"), F.lit(modulus)) == 0).limit(4 * SAMPLE).collect()
    chosen = chosen or everyone.limit(SAMPLE).collect()
    sample = pa.table(
        {"id": np.array([r["id"] for r in chosen], np.int64), "vec": list_column(np.array([r["vec"] for r in chosen], float))}
    )
    shared = state.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _lowest(shared.value, pa.Table.from_batches([batch]), False).to_batches()

    lowest = everyone.mapInArrow(run, FOUND).groupBy("id").agg(F.min("height").alias("height")).collect()
    if not lowest:
        return np.array([math.inf])
    # above the rounding of heights, so that some pair is below
    return np.unique(np.quantile([r["height"] for r in lowest], SHARES, method="higher")) + 2 * 10.0**-DIGITS


def _without_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Clusters ``id, n, total`` of equal vectors, and their merges, if there are any: the smallest id takes all."""
    hashed = rows.withColumn("hash", F.xxhash64("total"))
    if not hashed.groupBy("hash").count().where(F.col("count") > 1).limit(1).count():
        return rows.select("id", F.lit(1).cast("long").alias("n"), "total"), None
    by_id = Window.partitionBy("hash", "total").orderBy("id")
    all_of = Window.partitionBy("hash", "total")
    numbered = materialize(
        hashed.select(
            "id", "total", F.row_number().over(by_id).cast("long").alias("place"),
            F.min("id").over(all_of).alias("left"), F.count("*").over(all_of).alias("n"),
        ),
        "copies",
    )
    merges = numbered.where("place > 1").select(
        "left", F.col("id").alias("right"), F.lit(0.0).alias("height"), F.col("place").alias("size")
    )
    first = numbered.where("place = 1")
    return first.select("id", "n", F.transform("total", lambda t: t * F.col("n")).alias("total")), merges


def dendrogram(
    points: DataFrame,
    finish_at: int = 256,
    block_rows: int | None = None,
    id_col: str = "word_id",
    vec_col: str = "features",
) -> DataFrame:
    """All merges: ``left, right, height, size``; a merged cluster takes its smaller id.

    A phase takes heights below which some shares of the clusters have a partner. Average linkage is
    reducible, so merges up to a height stay inside the components of the pairs up to it; a task takes
    whole components, of at most ``TASK_CLUSTERS`` clusters, and merges them up to that height. Of larger
    components, pairs that name each other merge. The last clusters, at most ``finish_at`` or what a task
    takes anyway, go to one task; with ``block_rows``, the rows of a block of a tile, at most ``finish_at``.
    Vectors are scaled to unit length.
    """
    rows = as_points(points, id_col, vec_col).withColumn("norm", vector_norm("vec"))
    if rows.where(F.col("norm") == 0).limit(1).count():
        raise ValueError("cosine distance is undefined for a zero vector")
    unit = rows.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda v: v / F.col("norm")).alias("total"))
    clusters, merges = _without_copies(unit)
    state = materialize(clusters, "clusters")
    count = state.count()
    if count == 0:
        raise ValueError("no points")
    d = max(1, state.select(F.size("total")).first()[0])
    limit = max(2, min(TASK_CLUSTERS, BLOCK_BYTES // (8 * d)))
    last = max(1, finish_at, limit if block_rows is None else 1)
    out = [] if merges is None else [merges]
    while count > last:
        levels = _levels(state, count)
        edges = _edges(state, count, levels, block_rows or _rows_of_a_block(state, count, d))
        # one task: a few numbers for each cluster that has a partner
        groups = materialize(
            edges.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_groups(levels, limit, BIN_CLUSTERS), GROUPS),
            "groups",
        )
        both = state.join(groups, "id", "left")
        idle = both.where(F.col("bin").isNull()).select("id", "n", "total")
        busy = both.where(F.col("bin").isNotNull()).groupBy("bin").applyInArrow(_merged, STEP)
        step = materialize(busy.unionByName(idle, allowMissingColumns=True), "clusters")
        state, merged = step.where(F.col("id").isNotNull()).select("id", "n", "total"), step.where(F.col("id").isNull())
        count -= merged.count()
        out.append(merged.select("left", "right", "height", "size"))
    whole = state.select("*", F.lit(0).alias("one"), F.lit(None).cast("long").alias("pair"), F.lit(math.inf).alias("most"))
    whole = whole.groupBy("one").applyInArrow(_merged, STEP)
    out.append(whole.where(F.col("id").isNull()).select("left", "right", "height", "size"))
    return materialize(reduce(DataFrame.unionByName, out), "dendrogram")


def _rows_of_a_block(state: DataFrame, count: int, d: int) -> int:
    """About four tiles per core, within half of what a task can hold: few copies of each row in the shuffle."""
    blocks = math.ceil(math.sqrt(8 * parallelism(state.sparkSession)))
    return max(MIN_BLOCK_ROWS, min(math.ceil(count / blocks), BLOCK_BYTES // (16 * d)))


def cut(
    merges: DataFrame, points: DataFrame, ks: list[int], id_col: str = "word_id"
) -> DataFrame:
    """``k, id, cluster`` for every k, from one tree: all but the k - 1 highest merges.

    A merged-away cluster points to the one that took it; chains of pointers are
    halved per round. Clusters are numbered by their smallest id.
    """
    top = Window.orderBy(F.desc("height"), F.desc("left"), F.desc("right"))
    # at most max(ks) - 1 rows
    highest = (
        merges.orderBy(F.desc("height"), F.desc("left"), F.desc("right"))
        .limit(max(1, max(ks) - 1))
        .select("right", F.row_number().over(top).alias("place"))
    )
    # rows that share an id merge with each other, and are one node here
    parents = merges.where(F.col("left") != F.col("right")).select("left", "right").join(highest, "right", "left")
    each_k = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    ids = points.select(F.col(id_col).alias("id"))
    keep = F.col("left").isNotNull() & (F.col("place").isNull() | (F.col("place") >= F.col("k")))
    state = materialize(
        ids.distinct().join(parents.withColumnRenamed("right", "id"), "id", "left")
        .select("id", "left", "place", each_k)
        .select("k", "id", F.when(keep, F.col("left")).otherwise(F.col("id")).alias("ptr")),
        "pointers",
    )
    while True:
        step = state.select("k", F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        following = materialize(
            state.join(step, ["k", "ptr"]).select(
                "k", "id", F.col("next").alias("ptr"), (F.col("next") != F.col("ptr")).alias("moved")
            ),
            "pointers",
        )
        moved = following.where("moved").limit(1).count()
        state = following.drop("moved")
        if not moved:
            break
    # k rows per k
    roots = state.where(F.col("id") == F.col("ptr")).select(
        "k",
        "ptr",
        (F.row_number().over(Window.partitionBy("k").orderBy("ptr")) - 1).alias("cluster"),
    )
    return state.join(roots, ["k", "ptr"]).join(ids, "id").select("k", F.col("id").alias(id_col), "cluster")


def agglomerative(
    points: DataFrame,
    k: int | list[int],
    finish_at: int = 256,
    block_rows: int | None = None,
    id_col: str = "word_id",
    vec_col: str = "features",
) -> DataFrame:
    """``k, id, cluster`` for one k or for several from the same tree."""
    ks = [k] if isinstance(k, int) else list(k)
    n_rows = points.count()
    for one in ks:
        require_k(n_rows, one)
    merges = dendrogram(points, finish_at, block_rows, id_col, vec_col)
    return cut(merges, points, ks, id_col)


__all__ = ["agglomerative", "cut", "dendrogram"]
