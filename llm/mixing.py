"""Mixing sources to target weights by fitting subset sums.

Sources by code point, null last, weigh 1, 2, 3, repeating. They share all words by weight; a
source's target stops at ``max_copies`` times its size and the excess is shared again by weight.
Every document is taken as often as the target holds the whole source; what is left is a budget
of words. Documents are counted by exact length, the budget is spread over the lengths in
proportion, and bounded-knapsack dynamic programming over the lengths left fits the rest. Where
that misses, the best sum of the source's lengths up to the budget is searched from the start;
``fit_counts`` names the sizes from which it may not be found. Which documents of a length are
taken is drawn by a seeded hash of the id; reruns agree.

Lengths and counts are all that meets in one task. Null texts have size 0; documents of size 0
are never taken. Documents that share an id, source and size are alike to the draw.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.runtime import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)
DRAW_ROWS = 256  # documents of one length ranked in one group
HALF_SUMS = 1 << 21  # sums of one half of the lengths
TABLE_BITS = 1 << 31  # bits of all tables of reachable sums held at once
TRIES = 4  # draws for one length of the table


def targets(sizes: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size)."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source is ranked in one task
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialize(
        total.withColumn("weight", F.get(listed, F.pmod(place, F.lit(len(weights))).cast("int"))),
        "mix-sources",
    )
    most = max_copies * F.col("source_size")
    level = 0.0
    while True:  # a source that is above its most stays so, as the level only rises
        above = F.col("weight") * F.lit(level) > most
        row = sources.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(above, most).otherwise(0)).alias("fixed"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        new = (row["words"] - row["fixed"]) / row["weight"]
        if new <= level:
            break
        level = new
    target = F.when(F.col("weight") * F.lit(level) > most, most.cast("double")).otherwise(
        F.col("weight") * F.lit(level)
    )
    return sources.select("source", "source_size", target.alias("target"))


def _knapsack(lengths: np.ndarray, free: np.ndarray, cap: int, order: list[int]) -> tuple[np.ndarray, int]:
    """Documents of each length, ``free`` at most, of the largest sum up to ``cap``, and that sum.

    Bit b of ``reach`` says that b words can be made. Every m-th ``reach`` is kept, the ones between
    are made again on the way back; about twice the root of the steps are held.
    """
    taken, full, steps = np.zeros(len(lengths), np.int64), (1 << (cap + 1)) - 1, []
    for i in order:
        length, n, size = int(lengths[i]), int(free[i]), 1
        n = min(n, cap // length)
        while n > 0:  # counts as powers of two
            size = min(size, n)
            steps.append((i, size, length * size))
            n, size = n - size, size * 2
    every, reach, kept, done = max(1, math.isqrt(len(steps))), 1, [], 0
    for at, (_, _, words) in enumerate(steps):
        if reach >> cap & 1:
            break
        if at % every == 0:
            kept.append(reach)
        reach |= (reach << words) & full
        done = at + 1
    best = left = reach.bit_length() - 1
    for block in range(len(kept) - 1, -1, -1):
        part = steps[block * every : min(done, (block + 1) * every)]
        states = [kept[block]]
        for _, _, words in part[:-1]:
            states.append(states[-1] | (states[-1] << words) & full)
        for (i, size, words), before in zip(reversed(part), reversed(states)):
            if not before >> left & 1:
                taken[i] += size
                left -= words
    return taken, best


def _halves(lengths: np.ndarray, free: np.ndarray, cap: int, most: int) -> np.ndarray | None:
    """As ``_knapsack`` by all sums of two halves of the lengths; None if one has over ``most``."""
    free = np.minimum(free, cap // lengths)
    halves, combos = ([], []), [1, 1]
    for i in np.argsort(-free, kind="stable").tolist():
        h = int(combos[1] < combos[0])
        halves[h].append(i)
        combos[h] *= int(free[i]) + 1
        if combos[h] > most:
            return None
    sums = []
    for half in halves:
        made = np.zeros(1, np.int64)
        for i in half:
            made = (made[None, :] + (np.arange(free[i] + 1) * lengths[i])[:, None]).ravel()
        sums.append(made)
    order = np.argsort(sums[1], kind="stable")
    place = np.searchsorted(sums[1][order], cap - sums[0], side="right") - 1
    total = np.where(place >= 0, sums[0] + sums[1][order][np.maximum(place, 0)], -1)
    first = int(np.argmax(total))
    taken = np.zeros(len(lengths), np.int64)
    for half, at in zip(halves, (first, int(order[place[first]]))):
        for i in half:
            at, taken[i] = divmod(at, int(free[i]) + 1)
    return taken


def _narrowed(lengths: np.ndarray, counts: np.ndarray, budget: int, width: int, order: list[int]) -> np.ndarray:
    """Documents taken in proportion and then one by one, until at most ``width`` words are left."""
    total = int((lengths * counts).sum())
    share = max(0, budget - width // 2)
    taken = np.array([int(c) * share // total for c in counts], np.int64)
    left = budget - int((lengths * taken).sum())
    for i in order:
        if left <= width:
            break
        n = min(int(counts[i] - taken[i]), 1, max(0, (left - width // 2)) // int(lengths[i]))
        taken[i] += n
        left -= n * int(lengths[i])
    for i in np.argsort(-lengths, kind="stable").tolist():
        if left <= width:
            break
        n = min(int(counts[i] - taken[i]), left // int(lengths[i]))
        taken[i] += n
        left -= n * int(lengths[i])
    return taken


def fit_counts(
    lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0, table: int = 1 << 16
) -> np.ndarray:
    """How many documents of each length make up ``budget`` words, or the most words below it.

    First the budget is spread in proportion and a knapsack of ``table`` words fits what is left.
    If that misses, nothing taken so far stands: the best sum is searched over all documents, by
    all sums of two halves where lengths or documents are few, or by a table as long as the budget.
    Where both are above ``HALF_SUMS`` and ``TABLE_BITS``, tables of growing length, each after
    a new draw, end with the best sum found; only then it may not be the best there is.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return taken
    common = int(np.gcd.reduce(lengths))
    lengths, budget = lengths // common, budget // common
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()

    rng = np.random.default_rng(seed)

    def attempt(width: int) -> tuple[np.ndarray, int]:
        order = rng.permutation(len(lengths)).tolist()
        base = _narrowed(lengths, counts, budget, width, order)
        left = budget - int((lengths * base).sum())
        if left > width:  # no document fits any more
            return base, left
        more, made = _knapsack(lengths, counts - base, left, order)
        return base + more, left - made

    best, missed = attempt(min(table, budget))
    if not missed:
        return best
    exact = _halves(lengths, counts, budget, HALF_SUMS)
    if exact is not None:
        return exact
    # steps of the table, and the words that fit the memory for about twice their root of tables
    free = np.minimum(counts, budget // lengths)
    steps = sum(int(n).bit_length() for n in free)
    most = TABLE_BITS // (2 * math.isqrt(steps) + 3)
    if budget <= most:
        return _knapsack(lengths, counts, budget, rng.permutation(len(lengths)).tolist())[0]
    width = min(table, most)
    while missed:
        for _ in range(TRIES):
            found, gap = attempt(width)
            if gap < missed:
                best, missed = found, gap
            if not missed:
                break
        if width == most:
            break
        width = min(4 * width, most)
    return best


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_copies: int = 3,
    seed: int = 0,
    draw_col: str | None = None,
) -> DataFrame:
    """Per row: id, source, size, source_size, target, ``copies`` and ``taken`` (words).

    ``draw_col``: the column whose hash draws the documents, by default the id.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(draw_col or id_col).alias("drawn"), F.col(source_col).cast("string").alias("source"), size.alias("size")
        ),
        "mix-sizes",
    )
    aims = materialize(targets(rows, max_copies), "mix-targets")
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("n"))

    def plan(table: pa.Table) -> pa.Table:
        """Whole copies and further single ones for each length of a source."""
        table = table.sort_by("size")
        lengths, n = table["size"].to_numpy(), table["n"].to_numpy()
        words, target = table["source_size"][0].as_py(), table["target"][0].as_py()
        whole = min(max_copies, int(target // words)) if words else 0
        budget = min(round(target) - whole * words, (max_copies - whole) * words)
        real = lengths > 0
        extra = np.zeros(len(n), np.int64)
        extra[real] = fit_counts(lengths[real], n[real], budget, seed)
        return pa.table(
            {
                "source": table["source"],
                "size": lengths,
                "n": n,
                "whole": np.where(real, whole, 0).astype(np.int64),
                "extra": extra,
                "source_size": table["source_size"],
                "target": table["target"],
            }
        )

    with_aim = counts.withColumnRenamed("source", "s").join(aims, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    plans = with_aim.groupBy("source").applyInArrow(
        plan, "source string, size long, n long, whole long, extra long, source_size long, target double"
    )
    plans = materialize(plans, "mix-plans")
    # the draw: ranks by hash within groups of bounded size, and the rows of the groups before
    groups = plans.select(
        F.col("source").alias("s"), F.col("size").alias("z"), "n", "whole", "extra", "source_size", "target"
    )
    lot = F.pmod(F.xxhash64(F.lit(seed), "drawn", "size"), F.lit(1 << 40))
    drawn = rows.join(groups, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))).drop("s", "z")
    drawn = drawn.withColumn("lot", lot).withColumn(
        "cell", F.floor(F.col("lot") * F.ceil(F.col("n") / DRAW_ROWS) / float(1 << 40))
    )
    cells = drawn.groupBy("source", "size", "cell").agg(F.count("*").alias("in_cell"))
    before = F.sum("in_cell").over(
        Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = cells.select(
        F.col("source").alias("s"),
        F.col("size").alias("z"),
        F.col("cell").alias("c"),
        F.coalesce(before, F.lit(0)).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("lot", "drawn", "id"))
    ranked = drawn.withColumn("rank", rank).join(
        cells,
        F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")) & (F.col("c") == F.col("cell")),
    )
    copies = F.col("whole") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")
    return ranked.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are numbered in a table in shared storage, so that null and repeated ids do not meet.
    """
    row = "mix_row"
    while row in docs.columns:
        row += "_"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = mix(numbered, row, text_col, source_col, draw_col=id_col).filter("copies > 0").select(
        F.col(row).alias("r"), F.col("copies").cast("int").alias("times")
    )
    joined = numbered.join(plan, F.col("r") == F.col(row))
    return joined.withColumn("t", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
