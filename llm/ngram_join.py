"""Self-join of texts by the Jaccard similarity of their word n-grams, over parity sketches.

Each shingle flips one bit of a sketch, so the Hamming distance of two sketches is at most the
symmetric difference of their sets. Sets of similarity ``t`` differ in at most
``(1 - t) / (1 + t)`` of their summed sizes. Per band of sizes that gives a bound ``D``: the
sketch has more than ``D`` blocks, and at most ``D`` of them differ. Each set posts its
``D + 1`` heaviest blocks in a total order (set bits, then place). One of them is equal in a
similar set, and there it is posted as well: of the two posting thresholds take the stricter.

Posted blocks that no other chunk of documents holds are dropped. Equal sets are one class.
Classes that share a block are compared by pivots first: the most central members of a large
group with all others, every pair of a small one. What is linked so is one component, and its
pairs say nothing new. Groups that still hold several components are compared in tiles of
bounded size: only pairs of different components whose folded sketches are near enough leave a
tile. So the pairs of a group of copies are not listed, and no link between components is
missed. All pairs that are listed are verified on the whole sets, once sizes and folded sketches
allow a link. Sets are not stored: those of such pairs are made again from the chunks.

A-Z are lower-cased. Fewer words than ``n`` make one shingle. Texts without words, and rows
with a null id, link with nothing. Rows that share an id are one document; its component is
that of all its texts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.runtime import materialize, scratch_path

from . import chunks
from .components import components
from .words import hash_words, mix, one_array, rank_words, split_words, window_hash

BAND = 1.2  # largest over smallest size of a band
BLOCKS_PER_BOUND = 1.6  # sketch blocks for each posted one
BLOCK_BITS = 4096  # few blocks of unlike sets are equal by chance, even with two bits set
SMALL_GROUP = 4  # members up to which every pair of a group is compared at once
PIVOTS = 2  # of a larger group that the first one leaves in several components
FOLD_BITS = 2048  # of the folded sketch that a tile compares
TILE_ROWS = 1024


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, largest difference) for each band that the smaller set of a pair may be in.

    The bound is that of the largest pair of the band. Bands whose sets may not differ at
    all are left out: equal sets are one class already.
    """
    low = -(-size * percent // 100)
    out = []
    for band in range(_band(low), _band(size) + 1):
        top = _first(band + 1) - 1
        other = top * 100 // percent
        bound = (top + other) * (100 - percent) // (100 + percent)
        if bound:
            out.append((band, bound))
    return out


def _first(band: int) -> int:
    return math.ceil(BAND**band)


def _band(size: int) -> int:
    band = max(0, int(math.log(size, BAND)) - 1)
    while _first(band + 1) <= size:
        band += 1
    return band


def posted_blocks(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the sketch blocks that a set of hashed shingles posts."""
    keys = []
    for band, bound in bands(len(shingles), percent):
        blocks = math.ceil((bound + 1) * BLOCKS_PER_BOUND)
        own = mix(shingles ^ np.uint64(band + 1))
        block = (own >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        # the set bits of the sketch as places, as nearly all of its bits are 0
        place, hits = np.unique(block * np.uint64(BLOCK_BITS) + (own & np.uint64(BLOCK_BITS - 1)), return_counts=True)
        place = place[hits & 1 == 1]
        block = (place // np.uint64(BLOCK_BITS)).astype(np.int64)
        weight = np.bincount(block, minlength=blocks)
        content = np.zeros(blocks, np.uint64)
        if len(place):
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            content[block[starts]] = np.add.reduceat(mix(place), starts)
        chosen = np.argsort(-weight, kind="stable")[: bound + 1]
        seed = mix((chosen.astype(np.uint64) << np.uint64(16)) | np.uint64(band))
        keys.append(mix(seed ^ content[chosen]))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def shingle_sets(
    distinct: pa.Array, codes: np.ndarray, counts: np.ndarray, n: int
) -> list[np.ndarray]:
    """Sorted distinct hashed shingles of each text."""
    hashes = hash_words(distinct)[codes]
    windows, out, at = window_hash(hashes, n), [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(windows[at : at + count - n + 1]))
        elif count:
            out.append(window_hash(hashes[at : at + count], count) ^ np.uint64(count))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def folded(shingles: np.ndarray) -> bytes:
    """One sketch of fixed size: its Hamming distance is at most the symmetric difference."""
    bit = (mix(shingles) & np.uint64(FOLD_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=FOLD_BITS) & 1).astype(np.uint8)).tobytes()


def _sketches(
    docs: DataFrame, n: int, percent: int, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """Per row: id, set size, set digest, the posted keys that others share, the folded sketch, and the
    row's place in its chunk; and the bodies of the chunks."""
    parts = chunks.n_parts(docs.sparkSession)

    def make(table: pa.Table):
        words, counts = split_words(table[text_col])
        distinct, codes = rank_words(pc.ascii_lower(words))
        rows = chunks.dump_table(pa.table({id_col: one_array(table[id_col])}))
        listed = chunks.dump_words(distinct)
        yield chunks.BODY, chunks.dumps(
            np.frombuffer(rows, np.uint8), np.frombuffer(listed, np.uint8), codes, counts
        )
        sets = shingle_sets(distinct, codes, counts, n)
        keys = [posted_blocks(s, percent) for s in sets if len(s)]
        known, seen = np.unique(np.concatenate(keys + [np.zeros(0, np.uint64)]), return_counts=True)
        yield from chunks.hash_blocks(known, parts, (seen > 1).astype(np.uint8))

    def reply(payloads: list[bytes]) -> list[bytes | None]:
        """The keys of a block that another block holds, or that its own chunk holds twice."""
        blocks = [chunks.loads(p) for p in payloads]
        everything = np.sort(np.concatenate([b[0] for b in blocks]))
        shared = np.unique(everything[1:][everything[1:] == everything[:-1]])
        kept = [k[chunks.member(k, shared) | (twice > 0)] for k, twice in blocks]
        return [chunks.dumps(k) if len(k) else None for k in kept]

    def finish(chunk: int, body: bytes, replies: list[bytes]) -> pa.Table:
        rows, listed, codes, counts = chunks.loads(body)
        shared = chunks.gathered(replies)
        sets = shingle_sets(chunks.load_words(listed.tobytes()), codes, counts, n)
        sizes = np.array([len(s) for s in sets], np.int64)
        digests, keys, folds = [], [], []
        for own in sets:
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            mine = posted_blocks(own, percent) if len(own) else own
            mine = mine[chunks.member(mine, shared)]
            keys.append(mine.view(np.int64))
            folds.append(np.frombuffer(folded(own), np.int64) if len(mine) else None)
        longs = pa.list_(pa.int64())
        return pa.table(
            {
                id_col: chunks.load_table(rows.tobytes()).column(0),
                "n_shingles": sizes,
                "digest": pa.array(digests, pa.binary()),
                "keys": pa.array(keys, longs),
                "fold": pa.array(folds, longs),
                "chunk": np.full(len(sets), chunk, np.int64),
                "place": np.arange(len(sets), dtype=np.int64),
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, n_shingles long, digest binary, keys array<long>, "
        "fold array<long>, chunk long, place long"
    )
    path = scratch_path(docs.sparkSession, "ngram-chunks")
    bodies, blocks = chunks.build(docs.select(id_col, text_col), text_col, make, "ngram-chunks", path=path)
    rows = materialize(chunks.meet(bodies, chunks.exchange(blocks, reply), finish, schema), "ngram-sketches")
    chunks.drop_blocks(docs.sparkSession, path)
    return rows, bodies


def _sets(bodies: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, n, shingles) of the wanted (node, chunk, place), made again from the bodies of their chunks.

    Bodies are stored by chunk, so only the wanted places are shuffled.
    """

    def task(body: pa.Table, rows: pa.Table) -> pa.Table:
        nodes, sets = rows["node"], []
        if len(nodes):
            _, listed, codes, counts = chunks.loads(body["payload"][0].as_py())
            distinct = chunks.load_words(listed.tobytes())
            ends, place = np.cumsum(counts), rows["place"].to_numpy()
            mine = [codes[ends[i] - counts[i] : ends[i]] for i in place]
            sets = shingle_sets(distinct, np.concatenate(mine), counts[place], n)
        return pa.table(
            {
                "node": nodes,
                "n": pa.array([len(x) for x in sets], pa.int64()),
                "shingles": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
            }
        )

    kind = wanted.schema["node"].dataType.simpleString()
    return bodies.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(
        task, f"node {kind}, n long, shingles array<long>"
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, remake) -> DataFrame:
    """The pairs whose sets are similar enough.

    Sizes and folded sketches rule most others out; ``remake`` gives the sets of what is left.
    """

    def joined(rows, table, *columns):
        for s in "ab":
            side = table.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
            rows = rows.join(side, s)
        return rows

    n = F.col("n_a") + F.col("n_b")
    sized = joined(pairs, sets, "n").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    differing = F.zip_with("fold_a", "fold_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(differing, F.lit(0), lambda total, x: total + x)
    near = joined(sized, sets, "fold").filter((100 + percent) * apart <= (100 - percent) * n)
    near = materialize(near.select("a", "b").distinct(), "ngram-near")
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = sets.select("node", "chunk", "place").join(wanted, "node", "left_semi")
    moved = materialize(remake(wanted), "ngram-moved")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return joined(near, moved, "n", "shingles").filter(100 * common >= percent * (n - common)).select("a", "b")


def _links(posts: DataFrame, sets: DataFrame, percent: int, remake) -> DataFrame:
    """Verified links (a, b) that connect every component of similar classes.

    ``posts`` has (key, node), ``sets`` (node, n, fold, chunk, place).
    """
    groups = posts.groupBy("key").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("who")
    )
    # groups of the same members say the same
    one = groups.filter("members > 1").groupBy("members", "who").agg(F.min("key").alias("key"))
    posts = materialize(posts.join(one.select("key", "members"), "key"), "ngram-posts")
    weight = posts.groupBy("node").agg(F.sum("members").alias("weight"))
    large = materialize(
        posts.filter(F.col("members") > SMALL_GROUP).join(weight, "node"), "ngram-large"
    )

    small = posts.filter(F.col("members") <= SMALL_GROUP).groupBy("key").agg(
        F.sort_array(F.collect_set("node")).alias("nodes")
    )
    each = small.select(F.col("nodes"), F.posexplode("nodes").alias("i", "a"))
    pairs = each.select("a", F.explode(F.expr("slice(nodes, i + 2, size(nodes))")).alias("b"))
    pivot = F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot")
    first = large.groupBy("key").agg(pivot)
    star = large.join(first, "key").filter("node != pivot")
    links = materialize(_verified(pairs.unionByName(_ordered(star)).distinct(), sets, percent, remake), "ngram-links")

    named = materialize(_mixed(large, links), "ngram-mixed")
    size = named.groupBy("key", "component").agg(F.count("*").alias("size"))
    slots = named.join(size, ["key", "component"]).withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)))
    # members of the largest component first, as the others are most likely to link to it
    order = F.struct("size", "weight", -F.col("node"))
    more = slots.groupBy("key", "slot").agg(
        F.max_by(F.struct(F.col("node").alias("pivot"), F.col("component").alias("home")), order).alias("best")
    ).select("key", "best.*")
    star = named.join(more, "key").filter("component != home")
    links = links.unionByName(_verified(_ordered(star).distinct(), sets, percent, remake))
    links = materialize(links, "ngram-links")

    near = _near(_mixed(large, links), sets, percent)
    return links.unionByName(_verified(near, sets, percent, remake))


def _ordered(star: DataFrame) -> DataFrame:
    return star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _mixed(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups that lie in several components, with the component of each member."""
    label = components(links, "a", "b").withColumnRenamed("node", "n0")
    named = groups.join(label, F.col("n0") == F.col("node"), "left")
    named = named.withColumn("component", F.coalesce("component", "node")).drop("n0")
    several = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return named.join(several.filter("lo != hi").select("key"), "key")


def _near(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of a group in different components whose folded sketches allow a link."""
    bins = 4 * int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = named.join(sets.select("node", "n", "fold"), "node")
    blocks = F.ceil(F.col("members") / F.lit(TILE_ROWS)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64(F.lit("tile"), "node"), F.col("blocks")).cast("int")
    )
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "node", "component", "n", "fold", "block",
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
        F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"),
    )

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key, node, component, n, block = (
            table[c].to_numpy() for c in ("key", "node", "component", "n", "block")
        )
        folds = one_array(table["fold"]).flatten().to_numpy().view(np.uint64).reshape(len(key), -1)
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
        found = []
        for start, stop in zip(cuts, cuts[1:]):
            rows = np.arange(start, stop)
            left, right = (rows, rows) if lo == hi else (rows[block[rows] == lo], rows[block[rows] == hi])
            strip = max(1, (1 << 19) // max(1, len(right) * folds.shape[1]))
            for at in range(0, len(left), strip):
                i = left[at : at + strip, None]
                both = n[i] + n[right]
                fits = (component[i] != component[right]) & (
                    100 * np.minimum(n[i], n[right]) >= percent * np.maximum(n[i], n[right])
                )
                apart = np.bitwise_count(folds[i] ^ folds[right]).sum(axis=2, dtype=np.int64)
                fits &= (100 + percent) * apart <= (100 - percent) * both
                x, y = np.nonzero(fits)
                a, b = node[i[x, 0]], node[right[y]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        pairs = np.unique(np.concatenate(found + [np.zeros((0, 2), np.int64)]), axis=0)
        return pa.table({"a": pairs[:, 0].astype(np.int64), "b": pairs[:, 1].astype(np.int64)})

    return tiles.groupBy("bin", "lo", "hi").applyInArrow(tile, "a long, b long").distinct()


def similarity_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by
    links of at least ``percent`` % Jaccard similarity (null for a null id)."""
    rows, bodies = _sketches(docs, n, percent, id_col, text_col)
    rows = rows.withColumnRenamed(id_col, "node")
    known = rows.filter("node is not null")
    full = known.filter("n_shingles > 0")
    # a class is its smallest id, and of that the first row; its members link to it
    row = F.struct("node", "chunk", "place")
    classes = full.groupBy("digest").agg(F.min(row).alias("rep")).select("digest", "rep.*")
    classes = classes.withColumnRenamed("node", "rep")
    in_class = full.select("node", "digest").join(classes, "digest").filter("node != rep")
    same = in_class.select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    # an id with several texts keeps them apart here, as their sets differ
    posting = full.filter(F.size("keys") > 0).select(
        "node", F.col("n_shingles").alias("n"), "keys", "fold", "chunk", "place"
    )
    reps = materialize(
        posting.join(classes.select("chunk", "place"), ["chunk", "place"], "left_semi"), "ngram-classes"
    )
    posts = reps.select("node", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    links = _links(posts, reps.drop("keys"), percent, lambda wanted: _sets(bodies, wanted, n)).unionByName(same)
    label = components(materialize(links, "ngram-edges"), "a", "b")
    return rows.select(F.col("node").alias(id_col), "n_shingles").join(
        label.select(F.col("node").alias(id_col), "component"), id_col, "left"
    ).select(
        id_col, "n_shingles", F.coalesce("component", id_col).alias("component_id")
    )


def keep_first(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component: that of the smallest id, of repeated rows the largest.

    Rows with a null id stay.
    """
    found = similarity_components(docs, n, percent, id_col, text_col).filter(F.col(id_col).isNotNull())
    mark = "is_first"
    while mark in docs.columns:
        mark += "_"
    # ids that do not simply stay
    marked = found.groupBy(id_col).agg(
        F.count("*").alias("n_rows"), (F.min("component_id") == F.col(id_col)).alias(mark)
    ).filter(~F.col(mark) | (F.col("n_rows") > 1)).select(id_col, mark)
    joined = docs.join(marked, id_col, "left").select(*[F.col(f"`{c}`") for c in docs.columns], mark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = joined.filter(mark).groupBy(id_col).agg(F.max(row).alias("row")).select("row.*")
    return joined.filter(F.col(mark).isNull()).drop(mark).unionByName(repeated)
