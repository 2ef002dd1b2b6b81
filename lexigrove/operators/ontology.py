"""Scoring words and clusters against a hypernym ontology held in two edge tables.

``synsets`` is (word, synset_id); ``hypernyms`` is (synset_id, hypernym_id). Two
synsets are as similar as 1 / (1 + length of the shortest path over a common
ancestor), or, without a common ancestor, as the Jaccard overlap of their direct
hypernyms. Two words are as similar as their best pair of synsets; a best value
of 0 counts as no value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .tiles import unordered_tiles, with_group_block
from .word_pairs import distinct_pairs, scored_senses

CLUSTER_KEYS = ("algorithm", "cluster")

LIFTS = 3  # doublings of the edges that a round of ancestors moves up


def canonical_pairs(pairs: DataFrame, a: str = "w1", b: str = "w2") -> DataFrame:
    """Distinct word pairs with w1 <= w2, so a pair is scored once however often it occurs."""
    return distinct_pairs(pairs.select(F.least(a, b).alias("w1"), F.greatest(a, b).alias("w2")))


@dataclass
class SensePairs:
    """All senses of one word with all senses of the other, listed only in the tasks that score them."""

    words: DataFrame
    synsets: DataFrame


def synset_pairs(pairs: DataFrame, synsets: DataFrame, listed: bool = True) -> DataFrame | SensePairs:
    """``w1, w2, s1, s2``: all senses of one word with all senses of the other.

    Words without a synset drop out. Unless ``listed``, the pairs are for the measures below.
    """
    if not listed:
        return SensePairs(pairs, synsets)
    senses = synsets.select("word", "synset_id").distinct()
    first = senses.select(F.col("word").alias("w1"), F.col("synset_id").alias("s1"))
    second = senses.select(F.col("word").alias("w2"), F.col("synset_id").alias("s2"))
    return pairs.join(first, "w1").join(second, "w2").select("w1", "w2", "s1", "s2")


def hypernym_jaccard(pairs: DataFrame | SensePairs, hypernyms: DataFrame) -> DataFrame:
    """``s1, s2, jaccard`` for given synset pairs; 0 where either has no hypernym.

    Overlaps of listed pairs are counted by joins on the hypernym, never as collected sets.
    """
    if isinstance(pairs, SensePairs):
        return scored_senses(pairs.words, pairs.synsets, hypernyms, None, False, "jaccard")
    edges = hypernyms.select("synset_id", "hypernym_id").distinct()
    size = edges.groupBy(F.col("synset_id").alias("s2")).agg(F.count("*").alias("n2"))
    first = edges.select(F.col("synset_id").alias("s1"), "hypernym_id")
    second = edges.select(F.col("synset_id").alias("s2"), "hypernym_id", F.lit(1).alias("hit"))
    counts = (
        pairs.select("s1", "s2")
        .distinct()
        .join(first, "s1", "left")
        .join(second, ["s2", "hypernym_id"], "left")
        .groupBy("s1", "s2")
        .agg(F.count("hypernym_id").alias("n1"), F.count("hit").alias("shared"))
    )
    union = F.col("n1") + F.coalesce("n2", F.lit(0)) - F.col("shared")
    return counts.join(size, "s2", "left").select(
        "s1",
        "s2",
        F.when(F.col("shared") > 0, F.col("shared") / union).otherwise(F.lit(0.0)).alias("jaccard"),
    )


def ancestors(synsets: DataFrame, hypernyms: DataFrame, direct_only: bool = False) -> DataFrame:
    """``synset_id, ancestor, up``: every synset itself (0) and what lies above it.

    Ways of up to 2 ** ``LIFTS`` edges are joined together once; a round moves the frontier
    up by that many, until it finds nothing new, which also ends cycles. ``direct_only``
    stops at the direct hypernyms.
    """
    start = synsets.select("synset_id").distinct()
    reached = frontier = materialize(
        start.select("synset_id", F.col("synset_id").alias("ancestor"), F.lit(0).alias("up")),
        "ancestors",
    )
    ways = hypernyms.select(
        F.col("synset_id").alias("ancestor"), F.col("hypernym_id").alias("top"), F.lit(1).alias("more")
    ).where("ancestor != top").distinct()
    lifts = 0 if direct_only else LIFTS
    for _ in range(lifts):
        longer = ways.join(ways.toDF("top", "over", "further"), "top").select(
            "ancestor", F.col("over").alias("top"), (F.col("more") + F.col("further")).alias("more")
        )
        both = ways.unionByName(longer.where("ancestor != top"))
        ways = materialize(both.groupBy("ancestor", "top").agg(F.min("more").alias("more")), "ways")
    depth = 0
    while True:
        depth += 2**lifts
        step = (
            frontier.join(ways, "ancestor")
            .groupBy("synset_id", F.col("top").alias("ancestor"))
            .agg(F.min(F.col("up") + F.col("more")).alias("up"))
            .join(reached.select("synset_id", "ancestor"), ["synset_id", "ancestor"], "left_anti")
        )
        found = materialize(step, "ancestors")
        reached = reached.unionByName(found)
        # a shortest way further up passes one of the rows at exactly this depth
        frontier = found.where(F.col("up") == depth)
        if direct_only or not frontier.limit(1).count():
            return reached


def _above(hypernyms: DataFrame) -> DataFrame:
    """What lies above each hypernym; edges of synsets that are none are not needed for it."""
    inner = hypernyms.where("hypernym_id is not null").select(F.col("hypernym_id").alias("synset_id")).distinct()
    return ancestors(inner, hypernyms.join(inner, "synset_id", "left_semi"))


def path_similarity(
    pairs: DataFrame | SensePairs, hypernyms: DataFrame, up: DataFrame | None = None
) -> DataFrame:
    """``s1, s2, path_sim``: 1 / (1 + shortest path over a common ancestor), null if none."""
    if isinstance(pairs, SensePairs):
        above = _above(hypernyms)
        return scored_senses(pairs.words, pairs.synsets, hypernyms, above, False, "path_sim")
    wanted = pairs.select("s1", "s2").distinct()
    if up is None:
        wanted = materialize(wanted, "synset-pairs")
        both = wanted.select(F.explode(F.array("s1", "s2")).alias("synset_id"))
        up = ancestors(both, hypernyms)
    first = up.select(F.col("synset_id").alias("s1"), "ancestor", F.col("up").alias("u1"))
    second = up.select(F.col("synset_id").alias("s2"), "ancestor", F.col("up").alias("u2"))
    return (
        wanted.join(first, "s1", "left")
        .join(second, ["s2", "ancestor"], "left")
        .groupBy("s1", "s2")
        .agg((F.lit(1.0) / (1 + F.min(F.col("u1") + F.col("u2")))).alias("path_sim"))
    )


def pair_similarity(
    pairs: DataFrame,
    synsets: DataFrame,
    hypernyms: DataFrame,
    use_path: bool = True,
) -> DataFrame:
    """``w1, w2, sim`` for given word pairs; null without synsets or with a best value of 0.

    Synsets that share a direct hypernym have a path, so paths need no second measure.
    """
    above = _above(hypernyms) if use_path else None
    return scored_senses(canonical_pairs(pairs), synsets, hypernyms, above, True, "sim")


def _with_lineage(senses: DataFrame, hypernyms: DataFrame, use_path: bool) -> DataFrame:
    """``senses`` with ``lineage``, what lies above each with distances, or ``direct``, its direct hypernyms.

    Only what lies above hypernyms is followed up, as most synsets are none. An ancestor may come
    once for each direct hypernym that it lies above.
    """
    kind = dict(hypernyms.dtypes)["hypernym_id"]
    none = F.array().cast(f"array<struct<ancestor:{kind},up:int>>")
    edges = hypernyms.select("synset_id", "hypernym_id").where("synset_id != hypernym_id")
    if not use_path:
        direct = edges.groupBy("synset_id").agg(F.collect_set("hypernym_id").alias("direct"))
        return senses.join(direct, "synset_id", "left").select(
            "word", "synset_id", none.alias("lineage"), F.coalesce("direct", F.array().cast(f"array<{kind}>")).alias("direct")
        )
    own = edges.join(senses.select("synset_id").distinct(), "synset_id", "left_semi").distinct()
    inner = own.select(F.col("hypernym_id").alias("synset_id")).distinct()
    tops = edges.select(F.col("hypernym_id").alias("synset_id")).distinct()
    above = ancestors(inner, edges.join(tops, "synset_id", "left_semi")).groupBy(
        F.col("synset_id").alias("hypernym_id")
    ).agg(F.collect_list(F.struct("ancestor", (F.col("up") + 1).alias("up"))).alias("above"))
    over = own.join(above, "hypernym_id").groupBy("synset_id").agg(F.flatten(F.collect_list("above")).alias("over"))
    itself = F.array(F.struct(F.col("synset_id").alias("ancestor"), F.lit(0).alias("up")))
    return senses.join(over, "synset_id", "left").select(
        "word",
        "synset_id",
        F.concat(itself, F.coalesce("over", none)).alias("lineage"),
        F.array().cast(f"array<{kind}>").alias("direct"),
    )


def _require_ontology(synsets: DataFrame, allow_empty: bool) -> None:
    if not allow_empty and not synsets.limit(1).count():
        raise ValueError("the ontology has no synsets; pass allow_empty=True to go on")


def cluster_coherence(
    clusters: DataFrame,
    synsets: DataFrame,
    hypernyms: DataFrame,
    use_path: bool = True,
    count_zero: bool = False,
    block_rows: int = 1024,
    allow_empty: bool = False,
) -> DataFrame:
    """Mean similarity over the word pairs of each cluster.

    ``algorithm, cluster, n_words, n_with_synsets, n_pairs, coherence``. Pairs are
    never listed: words with the same senses are merged into one row with a
    count, a cluster of any size is cut into tiles, and a task returns one sum
    per tile. ``count_zero`` lets pairs of similarity 0 into the mean.
    """
    _require_ontology(synsets, allow_empty)
    keys = list(CLUSTER_KEYS)
    members = clusters.where(F.col("cluster").isNotNull()).select(
        *keys, F.col("word").cast("string").alias("word")
    )
    words = members.where(F.col("word").isNotNull())
    senses = synsets.select("word", "synset_id").distinct()
    used = senses.join(words.select("word").distinct(), "word", "left_semi").where("synset_id is not null")
    # per word: its senses, as many as the dictionary lists for it
    profile = (
        _with_lineage(used, hypernyms, use_path)
        .groupBy("word")
        .agg(F.sort_array(F.collect_list(F.struct("synset_id", "lineage", "direct"))).alias("sense"))
        .withColumn("signature", F.col("sense.synset_id"))
    )
    profile = materialize(profile, "profiles")
    known = words.join(profile.select("word", "signature"), "word")
    found = known.groupBy(*keys).agg(F.count("*").alias("n_with_synsets"))
    several = found.where(F.col("n_with_synsets") > 1).select(*keys)
    weighted = known.join(several, keys).groupBy(*keys, "signature").agg(
        F.count("*").alias("copies"), F.first("word").alias("word")
    )
    rows = weighted.join(profile.select("word", "sense"), "word")
    blocked = with_group_block(rows, keys, "signature", block_rows)
    types = dict(clusters.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys)
    tiles = unordered_tiles(
        blocked, keys, _coherence_tile(keys, use_path),
        f"{schema}, total double, scored double, zero double",
    )
    sums = tiles.groupBy(*keys).agg(
        F.sum("total").alias("total"), F.sum("scored").alias("scored"), F.sum("zero").alias("zero")
    )
    pairs = F.coalesce(F.col("scored"), F.lit(0.0))
    if count_zero:
        pairs = pairs + F.coalesce(F.col("zero"), F.lit(0.0))
    return (
        members.groupBy(*keys)
        .agg(F.count("word").alias("n_words"))
        .join(found, keys, "left")
        .join(sums, keys, "left")
        .select(
            *keys,
            "n_words",
            F.coalesce("n_with_synsets", F.lit(0)).alias("n_with_synsets"),
            pairs.cast("long").alias("n_pairs"),
            F.when(pairs > 0, F.col("total") / pairs).alias("coherence"),
        )
    )


def _unpack(table: pa.Table):
    """Sense rows of a block: first sense of each word, synset ancestors and direct hypernyms."""
    senses = table["sense"].combine_chunks()
    counts = senses.value_lengths().to_numpy(zero_copy_only=False)
    flat = senses.flatten()

    def edges(name: str):
        lists = flat.field(name)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(False))
        return row, lists.flatten()

    up_row, up = edges("lineage")
    direct_row, direct = edges("direct")
    ancestor, steps = up.field("ancestor"), up.field("up").to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return starts, len(flat), (up_row, ancestor, steps), (direct_row, direct)


# Matches between two blocks that are expanded at once.
MATCHES = 4_000_000


def _matches(a_names: pa.Array, b_names: pa.Array):
    """Positions in ``a`` and in ``b`` of all entries with equal names, in slices."""
    names = pa.chunked_array([a_names, b_names]).combine_chunks().dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    a, b = codes[: len(a_names)], codes[len(a_names) :]
    order = np.argsort(b, kind="stable")
    first = np.searchsorted(b[order], a, "left")
    n = np.searchsorted(b[order], a, "right") - first
    ends = np.cumsum(n)
    start = 0
    while start < len(a):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + MATCHES, "right")))
        count = n[start:stop]
        at_a = np.repeat(np.arange(start, stop), count)
        within = np.arange(len(at_a)) - np.repeat(np.cumsum(count) - count, count)
        yield at_a, order[np.repeat(first[start:stop], count) + within]
        start = stop


def _word_similarity(a: pa.Table, b: pa.Table, use_path: bool) -> np.ndarray:
    """Best synset similarity of every word of ``a`` with every word of ``b``.

    Synsets that share a direct hypernym have a path over it, so one of the two measures is enough.
    """
    starts_a, n_a, up_a, direct_a = _unpack(a)
    starts_b, n_b, up_b, direct_b = _unpack(b)
    if use_path:
        sim = _path_similarity(up_a, up_b, n_a, n_b)
    else:
        sim = _direct_overlap(direct_a, direct_b, n_a, n_b)
    return _best_sense(_best_sense(sim, starts_a).T, starts_b).T


def _best_sense(sim: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest of the rows of each word; few words have several."""
    best, counts = sim[starts], np.diff(starts, append=len(sim))
    several, step = np.flatnonzero(counts > 1), 1
    while len(several):
        best[several] = np.maximum(best[several], sim[starts[several] + step])
        step += 1
        several = several[counts[several] > step]
    return best


def _direct_overlap(direct_a, direct_b, n_a: int, n_b: int) -> np.ndarray:
    shared = np.zeros(n_a * n_b)
    for at_a, at_b in _matches(direct_a[1], direct_b[1]):
        cell = direct_a[0][at_a] * n_b + direct_b[0][at_b]
        shared += np.bincount(cell, minlength=n_a * n_b)
    shared = shared.reshape(n_a, n_b)
    size_a = np.bincount(direct_a[0], minlength=n_a)
    size_b = np.bincount(direct_b[0], minlength=n_b)
    union = size_a[:, None] + size_b[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def _path_similarity(up_a, up_b, n_a: int, n_b: int) -> np.ndarray:
    length = np.full(n_a * n_b, np.inf)
    for at_a, at_b in _matches(up_a[1], up_b[1]):
        cell = up_a[0][at_a] * n_b + up_b[0][at_b]
        np.minimum.at(length, cell, (up_a[2][at_a] + up_b[2][at_b]).astype(np.float64))
    return 1.0 / (1.0 + length.reshape(n_a, n_b))


def _coherence_tile(keys: list[str], use_path: bool):
    def tile(a: pa.Table, b: pa.Table | None) -> pa.Table:
        names = a.slice(0, 1).select(keys) if a.num_rows else b.slice(0, 1).select(keys)
        total = scored = zero = 0.0
        if a.num_rows and (b is None or b.num_rows):
            sim = _word_similarity(a, a if b is None else b, use_path)
            n = a["copies"].to_numpy().astype(np.float64)
            m = n if b is None else b["copies"].to_numpy().astype(np.float64)
            hit = (sim > 0).astype(np.float64)
            total, scored = float(n @ (sim @ m)), float(n @ (hit @ m))
            pairs = float(n.sum() * m.sum())
            if b is None:
                # different signatures once, and pairs among words of one signature
                total = (total - float(n @ np.diag(sim))) / 2
                scored = (scored - float(n @ np.diag(hit))) / 2
                pairs = (pairs - float(n.sum())) / 2
            zero = pairs - scored
        for name, value in (("total", total), ("scored", scored), ("zero", zero)):
            names = names.append_column(name, pa.array([value]))
        return names

    return tile


def coherence_summary(
    clusters: DataFrame, synsets: DataFrame, hypernyms: DataFrame, **options
) -> DataFrame:
    """One row per algorithm, in their order: mean and population deviation of the cluster values.

    Clusters of one word and clusters without a value count as skipped; an
    algorithm without any value keeps a row with nulls.
    """
    scores = cluster_coherence(clusters, synsets, hypernyms, **options)
    value = F.when(F.col("n_words") >= 2, F.col("coherence"))
    per_algorithm = scores.groupBy("algorithm").agg(
        F.round(F.avg(value), 4).alias("Mean_WordNet_Coherence"),
        F.round(F.stddev_pop(value), 4).alias("Std_WordNet_Coherence"),
        F.count(value).cast("int").alias("Clusters_Evaluated"),
        (F.count("*") - F.count(value)).cast("int").alias("Clusters_Skipped"),
        F.sum("n_words").alias("Words"),
        F.sum("n_with_synsets").alias("Words_With_Synsets"),
    )
    everyone = clusters.select("algorithm").distinct()
    return everyone.join(per_algorithm, "algorithm", "left").select(
        F.col("algorithm").alias("Algorithm"),
        "Mean_WordNet_Coherence",
        "Std_WordNet_Coherence",
        F.coalesce("Clusters_Evaluated", F.lit(0)).alias("Clusters_Evaluated"),
        F.coalesce("Clusters_Skipped", F.lit(0)).alias("Clusters_Skipped"),
        F.coalesce("Words", F.lit(0)).alias("Words"),
        F.coalesce("Words_With_Synsets", F.lit(0)).alias("Words_With_Synsets"),
    ).orderBy("Algorithm")
