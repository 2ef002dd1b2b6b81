"""Merkle manifest of a table: leaf hashes, places by bitmap rank, slot arrays, inclusion paths.

Places come from bitmaps instead of a sort. Per group, ids are bits of 64-bit words; tasks or
their own bits together and Spark merges the words of all tasks (words without a bit are left
out, which keeps the bitmap small for thin ids). A directory of counts over the words, in
levels under one parent each, gives the number of rows before a word; the
rank of a row is that plus the bits below its own. Rows of words in which an id occurs more than
once are the exception: equal rows are merged with their count first, and counts by the leading
digits of the leaf hash take the place of bits, so no id however frequent meets in one task.

Ranks key the slots of arrays of 1,024 nodes, which are put in place and folded ten levels at a
time. Each node has one or two children: an odd last one is hashed alone while more than one is
left in its group.

Order: groups by their UTF-8 bytes, null first; ids ascending, null first; rows that share an id
by leaf hash. Equal rows are told apart by nothing and take the places of their leaf in any order.
Null fields hash as ``-``. An empty table gives no rows. Columns named like those made here may
be kept: made columns have their own names inside, and the result names are checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.ranking import with_rank
from lexigrove.runtime import materialize

SLOT_BITS = 10  # nodes of one slot array: 2 ** SLOT_BITS
_WORD_BITS = 6
_STEPS = (10, 24, 24)  # bits of a directory level; with those of a word, 64
_COPIES = 65_536  # equal rows written by one task at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_MADE = ("leaf", "subroot", "root", "place", "siblings")


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Hex digest of the fields of one row."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def fold(leaf: Column, siblings: Column, place: Column) -> Column:
    """The root that a leaf leads to: its siblings from the leaf upwards, null where it has none."""
    steps = F.transform(siblings, lambda s, i: F.struct(s.alias("hash"), F.getbit(place, i).alias("right")))

    def up(node, step):
        pair = F.when(step["right"] == 1, F.concat(step["hash"], node)).otherwise(F.concat(node, step["hash"]))
        return F.sha2(F.coalesce(pair, node), 256)

    return F.aggregate(steps, leaf, up)


# --- places ----------------------------------------------------------------------------------

def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null; the right side's keys are dropped."""
    renamed = b.select(*[F.col(c).alias(f"_r{c}" if c in keys else c) for c in b.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in keys]
    return a.join(renamed, on).drop(*[f"_r{c}" for c in keys])


def _before(nodes: DataFrame, parent: list[str], order: list[str], n: str) -> Column:
    """Sum of ``n`` over the entries under the same parent that come earlier."""
    w = Window.partitionBy(*parent).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` (_g, _word, _bits, _n) with ``_base``: the rows of the group before the word."""
    levels = [words.select("_g", F.col("_word").alias("_k0"), "_n")]
    for i, step in enumerate(_STEPS):
        up = F.shiftright(f"_k{i}", step).alias(f"_k{i + 1}")
        levels.append(levels[-1].groupBy("_g", up).agg(F.sum("_n").alias("_n")))
    top = f"_k{len(_STEPS)}"
    found = levels[-1].withColumn("_base", _before(levels[-1], ["_g"], [top], "_n")).drop("_n")
    for i in reversed(range(len(_STEPS))):
        own = levels[i].withColumn("_up", F.shiftright(f"_k{i}", _STEPS[i]))
        own = own.withColumn("_in", _before(own, ["_g", "_up"], [f"_k{i}"], "_n")).drop("_n")
        above = found.select("_g", F.col(f"_k{i + 1}").alias("_up"), F.col("_base").alias("_above"))
        found = _same(own, above, ["_g", "_up"]).select(
            "_g", f"_k{i}", (F.col("_above") + F.col("_in")).alias("_base")
        )
    return _same(words, found.withColumnRenamed("_k0", "_word"), ["_g", "_word"])


def ranks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (_g, _id, _leaf, ...) with ``_rank`` in their group, and the size of each group."""
    columns = rows.columns
    word, bit = F.shiftright("_id", _WORD_BITS), F.col("_id").bitwiseAND(F.lit(63)).cast("int")
    words = rows.groupBy("_g", word.alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"), F.count("*").alias("_n")
    )
    words = materialize(words, "manifest-bitmap")
    sizes = words.groupBy("_g").agg(F.sum("_n").alias("_size"))
    placed = materialize(directory(words), "manifest-directory")
    found = _same(rows.withColumn("_word", word), placed, ["_g", "_word"])
    crowded = F.col("_n") > F.coalesce(F.bit_count("_bits"), F.lit(0))
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    single = found.filter(~crowded).select(
        *columns, (F.col("_base") + F.bit_count(F.col("_bits").bitwiseAND(below))).alias("_rank")
    )
    # words in which an id comes more than once
    merged = materialize(
        found.filter(crowded)
        .groupBy(*columns, "_word", "_base", F.substring("_leaf", 1, 4).alias("_head"))
        .agg(F.count("*").alias("_copies")),
        "manifest-shared-ids",
    )
    heads = merged.groupBy("_g", "_word", "_id", "_head").agg(F.sum("_copies").alias("_n"))
    heads = heads.withColumn("_start", _before(heads, ["_g", "_word"], ["_id", "_head"], "_n")).drop("_n")
    rest = [c for c in columns if c not in ("_g", "_id")]
    merged = merged.withColumn("_in", _before(merged, ["_g", "_word", "_id", "_head"], rest, "_copies"))
    merged = _same(merged, heads, ["_g", "_word", "_id", "_head"])
    first = F.col("_base") + F.col("_start") + F.col("_in")
    blocks = merged.select(
        *columns, first.alias("_first"), "_copies",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_copies - 1) div %d" % _COPIES))).alias("_block"),
    ).repartition("_g", "_id", "_leaf", "_block")
    lo = F.col("_block") * _COPIES
    hi = F.least(lo + _COPIES, F.col("_copies")) - 1
    several = blocks.select(*columns, F.col("_first"), F.explode(F.sequence(lo, hi)).alias("_copy"))
    several = several.select(*columns, (F.col("_first") + F.col("_copy")).alias("_rank"))
    return single.unionByName(several), sizes


# --- slot arrays -------------------------------------------------------------------------------

def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _fold_slots(table: pa.Table) -> pa.Table:
    """One slot array: each node's siblings, and the array's top in the row of slot 0."""
    left = table["_left"][0].as_py()
    levels = min(SLOT_BITS, (left - 1).bit_length())
    places = [i & ((1 << SLOT_BITS) - 1) for i in table["_rank"].to_pylist()]
    slots = [None] * len(places)
    for place, value in zip(places, table["_leaf"].to_pylist()):
        slots[place] = value
    rows = [slots]
    for _ in range(levels):
        last = rows[-1]
        rows.append([_digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])

    def siblings(place):
        out = []
        for level in range(levels):
            other = (place >> level) ^ 1
            out.append(rows[level][other] if other < len(rows[level]) else None)
        return out

    paths = pa.array([siblings(p) for p in places], pa.list_(pa.string()))
    tops = pa.array([rows[-1][0] if p == 0 else None for p in places], pa.string())
    return table.append_column("_path", paths).append_column("_top", tops)


def _reduce(nodes: DataFrame, largest: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (_g, _rank, _leaf, _left, ...) with ``_path`` up to the root of their group; the roots.

    ``_left``: nodes of the group, at most ``largest``.
    """
    levels = []
    while True:
        kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
        schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", _path array<string>, _top string"
        keyed = nodes.groupBy("_g", F.shiftright("_rank", SLOT_BITS).alias("_up"))
        folded = materialize(keyed.applyInArrow(_fold_slots, schema), name)
        levels.append(folded)
        up = F.shiftright("_rank", SLOT_BITS).alias("_rank")
        left = F.expr(f"(_left + {2**SLOT_BITS - 1}) div {2**SLOT_BITS}").alias("_left")
        nodes = folded.filter("_top is not null").select("_g", up, F.col("_top").alias("_leaf"), left)
        if largest <= 2**SLOT_BITS:
            break
        largest = -(-largest // 2**SLOT_BITS)
    found = levels[-1].drop("_top")
    for level in reversed(levels[:-1]):
        above = found.select("_g", F.col("_rank").alias("_up"), F.col("_path").alias("_rest"))
        own = level.drop("_top").withColumn("_up", F.shiftright("_rank", SLOT_BITS))
        found = own.join(above, ["_g", "_up"]).withColumn("_path", F.concat("_path", "_rest")).drop("_up", "_rest")
    return found, nodes.select("_g", F.col("_leaf").alias("_root"))


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``id_col``, ``group_col``, ``keep``, and ``leaf, subroot, root, place, siblings`` per row.

    ``siblings`` lists the partners on the way to the root (null where a node has none), and bit i of
    ``place`` tells whether the node of level i is the right one of its pair.
    """
    shown = list(dict.fromkeys([id_col, group_col, *keep]))
    if clash := set(_MADE) & set(shown):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    named = {c: f"_c{i}" for i, c in enumerate(shown)}
    group = F.col(group_col).cast("string")
    rows = materialize(
        docs.select(
            F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("_g"),
            F.col(id_col).cast("long").alias("_id"),
            leaf_hash(*[F.col(c) for c in fields]).alias("_leaf"),
            *[F.col(c).alias(n) for c, n in named.items()],
        ),
        "manifest-leaves",
    )
    ranked, sizes = ranks(rows)
    sizes = materialize(sizes, "manifest-groups")
    largest = sizes.agg(F.max("_size"), F.count("*")).first()
    nodes = ranked.join(sizes.withColumnRenamed("_size", "_left"), "_g")
    leaves, subroots = _reduce(nodes, largest[0] or 1, "manifest-slots")
    numbered = with_rank(subroots, [F.col("_g").asc()], "_rank")
    tops = numbered.select(
        F.lit("").alias("_g"), "_rank", F.col("_root").alias("_leaf"), F.lit(largest[1]).cast("long").alias("_left"),
        F.col("_g").alias("_group"),
    )
    groups, root = _reduce(tops, largest[1] or 1, "manifest-roots")
    groups = groups.join(root, "_g").select(
        F.col("_group").alias("_g"), F.col("_rank").alias("_at"), F.col("_leaf").alias("_subroot"),
        F.col("_path").alias("_rest"), "_root",
    )
    # levels of the group's own tree: bits of its size less one
    depth = F.length(F.regexp_replace(F.bin(F.col("_left") - 1), "^0+", ""))
    return leaves.join(groups, "_g").select(
        *[F.col(n).alias(c) for c, n in named.items()],
        F.col("_leaf").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        (F.col("_rank") + F.call_function("shiftleft", F.col("_at"), depth)).alias("place"),
        F.concat("_path", "_rest").alias("siblings"),
    )
