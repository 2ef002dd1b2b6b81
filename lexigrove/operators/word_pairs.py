"""Word pairs as packed blocks: distinct pairs, and senses scored without listing their pairs in a shuffle.

Words are dealt to blocks by hash. A tile is a block of first words and a block of second
words; it gets its word pairs and the senses of both blocks, each packed and compressed
with neighbours alike. Pairs of senses come into being in the task that returns them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, parallelism

# What a task holds while it packs.
PACK_ROWS = 1 << 21
PACK_BYTES = 64 * 1024 * 1024
BLOCK_SENSES = 1 << 19
# Pairs, of words or of senses, that a task returns at once.
STRIP_PAIRS = 1 << 18

PACKED = "tile int, payload binary"
PAIRS, FIRST, SECOND, ABOVE_FIRST, ABOVE_SECOND = range(5)


def _dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _load(payloads: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in payloads]).combine_chunks()


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of bounded size; never empty."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _payloads(tiles: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(tiles, pa.int32()), pa.array(payloads, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["tile", "payload"])


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of a tile as a sorted list of words and places in it."""
    for table in _held(batches):
        both = pa.chunked_array([*table["w1"].chunks, *table["w2"].chunks]).combine_chunks()
        coded = both.dictionary_encode("encode")
        order = pc.sort_indices(coded.dictionary)
        words = coded.dictionary.take(order)
        rank = np.empty(len(words), np.uint64)
        rank[order.to_numpy()] = np.arange(len(words), dtype=np.uint64)
        codes, n = rank[coded.indices.to_numpy()], np.uint64(len(words))
        a, b = codes[: len(table)], codes[len(table) :]
        tile = table["tile"].to_numpy().astype(np.uint64)
        key = np.unique((tile * n + a) * n + b)
        key, b = np.divmod(key, n)
        tile, a = np.divmod(key, n)
        cuts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])).tolist() + [len(tile)]
        tiles, payloads = [], []
        for start, stop in zip(cuts, cuts[1:]):
            x, y = a[start:stop], b[start:stop]
            own = np.unique(np.concatenate([x, y]))
            steps = np.diff(np.searchsorted(own, x), prepend=0).astype(np.int32)
            places = np.searchsorted(own, y).astype(np.int32)
            columns = {
                "words": words.take(pa.array(own.astype(np.int64))),
                "a": pa.array(steps),
                "b": pa.array(places),
            }
            row = pa.table({k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in columns.items()})
            tiles.append(int(tile[start]))
            payloads.append(_dump(row))
        yield _payloads(tiles, payloads)


def _load_pairs(payloads: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, and the distinct pairs as places in them, in order."""
    words, a, b, at = [], [], [], 0
    for payload in payloads:
        row = _load([payload])
        steps, places = (_array(row[c]).flatten().to_numpy() for c in "ab")
        words.append(_array(row["words"]).flatten())
        a.append(np.cumsum(steps, dtype=np.int64) + at)
        b.append(places.astype(np.int64) + at)
        at += len(words[-1])
    coded = pa.concat_arrays(words).dictionary_encode("encode")
    codes, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    key = np.unique(codes[np.concatenate(a)] * n + codes[np.concatenate(b)])
    return coded.dictionary, key // n, key % n


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a tile, sorted by their next column."""
    for table in _held(batches):
        names = [c for c in table.column_names if c != "tile"]
        table = table.combine_chunks().sort_by([("tile", "ascending"), (names[0], "ascending")])
        tile = table["tile"].to_numpy()
        cuts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])).tolist() + [len(tile)]
        slices = [table.slice(i, j - i).select(names) for i, j in zip(cuts, cuts[1:])]
        yield _payloads(tile[cuts[:-1]].tolist(), [_dump(s.combine_chunks()) for s in slices])


def _block(word: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(blocks)).cast("int")


def _tiled(pairs: DataFrame, blocks: int) -> DataFrame:
    tile = _block("w1", blocks) * blocks + _block("w2", blocks)
    return pairs.select("w1", "w2", tile.alias("tile")).mapInArrow(_pack_pairs, PACKED)


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """The distinct rows of ``w1, w2``."""
    pairs = pairs.select("w1", "w2")
    blocks = math.ceil(math.sqrt(2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, a, b = _load_pairs([p for batch in batches for p in batch.column("payload").to_pylist()])
        for start in range(0, len(a), STRIP_PAIRS):
            w1, w2 = (words.take(pa.array(x[start : start + STRIP_PAIRS])) for x in (a, b))
            yield pa.RecordBatch.from_arrays([w1, w2], ["w1", "w2"])

    return _tiled(pairs, blocks).groupBy("tile").applyInArrow(unpack, pairs.schema)


class _Side:
    """The senses of a block, by word."""

    def __init__(self, payloads: list[bytes], above: list[bytes], use_path: bool):
        table = _load(payloads)
        coded = _array(table["word"]).dictionary_encode()
        codes = coded.indices.to_numpy()
        table = table.take(pa.array(np.argsort(codes, kind="stable"))).combine_chunks()
        self.words = coded.dictionary
        self.count = np.bincount(codes, minlength=len(self.words))
        self.start = np.cumsum(self.count) - self.count
        self.synset = _array(table["synset_id"])
        self.sole = _array(table["sole"]).to_numpy(zero_copy_only=False)
        over = _array(table["over"])
        self.size = over.value_lengths().to_numpy() + _array(table["gap"]).to_numpy(zero_copy_only=False)
        rows, names = np.repeat(np.arange(len(over)), over.value_lengths().to_numpy()), over.flatten()
        up = np.zeros(len(rows), np.int64)
        if use_path:
            own = np.flatnonzero(self.synset.is_valid().to_numpy(zero_copy_only=False))
            rows, higher, up = _lineage(rows, names, _load(above) if above else None)
            rows = np.concatenate([own, rows])
            names = pa.concat_arrays([self.synset.take(pa.array(own)), higher])
            up = np.concatenate([np.zeros(len(own), np.int64), up])
        self.rows, self.names, self.up = rows, names, up

    def find(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)

    def counts(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.count[at], 0)


def _lineage(rows: np.ndarray, names: pa.Array, above: pa.Table | None):
    """Per sense and direct hypernym what lies above it, with the distance from the sense."""
    if above is None:
        return rows[:0], names.slice(0, 0), np.zeros(0, np.int64)
    coded = pa.concat_arrays([_array(above["synset_id"]), names]).dictionary_encode()
    codes = coded.indices.to_numpy()
    top, code = codes[: len(above)], codes[len(above) :]
    order = np.argsort(top, kind="stable")
    first = np.searchsorted(top[order], code, "left")
    n = np.searchsorted(top[order], code, "right") - first
    at = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
    up = _array(above["up"]).to_numpy()[at].astype(np.int64) + 1
    return np.repeat(rows, n), _array(above["ancestor"]).take(pa.array(at)), up


def _scorer(first: _Side, second: _Side, use_path: bool) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``score(i, j)``: similarity of sense ``i`` of one side with ``j`` of the other; NaN without a path."""
    coded = pa.concat_arrays([first.names, second.names]).dictionary_encode()
    codes, k = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))

    def entries(side: _Side, code: np.ndarray):
        # the nearest of equal ancestors
        key = side.rows * k + code
        order = np.lexsort((side.up, key))
        order = order[np.append(True, np.diff(key[order]) != 0)] if len(key) else order
        return key[order], side.up[order]

    key_1, up_1 = entries(first, codes[: len(first.rows)])
    key_2, up_2 = entries(second, codes[len(first.rows) :])
    count = np.bincount(key_1 // k, minlength=len(first.synset))
    start, code = np.cumsum(count) - count, key_1 % k

    def score(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = count[i]
        at = np.repeat(np.arange(len(i)), n)
        entry = np.repeat(start[i] - np.cumsum(n) + n, n) + np.arange(len(at))
        wanted = j[at] * k + code[entry]
        place = np.searchsorted(key_2, wanted)
        place[place == len(key_2)] = 0
        hit = np.flatnonzero(key_2[place] == wanted) if len(key_2) else np.zeros(0, np.int64)
        if use_path:
            length = np.full(len(i), np.inf)
            np.minimum.at(length, at[hit], (up_1[entry[hit]] + up_2[place[hit]]).astype(np.float64))
            return np.where(np.isinf(length), np.nan, 1.0 / (1.0 + length))
        shared = np.bincount(at[hit], minlength=len(i))
        union = n + second.size[j] - shared
        return np.divide(shared, union, out=np.zeros(len(i)), where=shared > 0)

    return score


def _strips(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of pairs whose sense pairs, and which themselves, are at most ``STRIP_PAIRS``, or one pair."""
    ends, start = np.cumsum(np.maximum(n, 1)), 0
    while start < len(n):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + STRIP_PAIRS, "right")))
        yield start, stop
        start = stop


def _score_tile(use_path: bool, by_word: bool, sole: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[] for _ in range(5)]
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist()):
                got[kind].append(payload)
        if not got[PAIRS]:
            return
        words, a, b = _load_pairs(got[PAIRS])
        n = np.zeros(len(a), np.int64)
        if got[FIRST] and got[SECOND]:
            first = _Side(got[FIRST], got[ABOVE_FIRST], use_path)
            second = _Side(got[SECOND], got[ABOVE_SECOND], use_path)
            score = _scorer(first, second, use_path)
            at_1, at_2 = first.find(words)[a], second.find(words)[b]
            n_2 = second.counts(at_2)
            n = first.counts(at_1) * n_2
        for start, stop in _strips(n):
            count = n[start:stop]
            pair = np.repeat(np.arange(start, stop), count)
            i = j = pair
            value = np.zeros(0)
            if len(pair):
                within = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
                by, step = np.divmod(within, n_2[pair])
                i, j = first.start[at_1[pair]] + by, second.start[at_2[pair]] + step
            if by_word:
                best = np.zeros(stop - start)
                if len(pair):
                    np.fmax.at(best, pair - start, score(i, j))
                value = pa.array(best, mask=best <= 0)
                ends = [words.take(pa.array(x[start:stop])) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*ends, value], names)
            elif len(pair):
                keep = (first.sole[i] & second.sole[j]) == sole
                i, j = i[keep], j[keep]
                value = score(i, j)
                ends = [first.synset.take(pa.array(i)), second.synset.take(pa.array(j))]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(value, mask=np.isnan(value))], names)

    return run


def scored_senses(
    words: DataFrame,
    synsets: DataFrame,
    hypernyms: DataFrame,
    above: DataFrame | None,
    by_word: bool,
    value: str,
) -> DataFrame:
    """Similarity of the senses of word pairs: ``s1, s2`` once each, or ``w1, w2`` with that of the best.

    With ``above`` (synset_id, ancestor, up: what lies above each hypernym) by paths, else by the overlap of
    direct hypernyms. By word, a best value of 0 is null, as are pairs without senses.
    """
    senses = synsets.select("word", "synset_id").where("word is not null").distinct()
    owners = senses.groupBy("synset_id").agg((F.min("word") == F.max("word")).alias("sole"))
    over = hypernyms.groupBy("synset_id").agg(
        F.collect_set("hypernym_id").alias("over"), F.max(F.col("hypernym_id").isNull()).alias("gap")
    )
    profile = senses.join(owners, "synset_id", "left").join(over, "synset_id", "left").select(
        "word",
        "synset_id",
        F.coalesce("sole", F.lit(False)).alias("sole"),
        F.coalesce("gap", F.lit(False)).alias("gap"),
        F.coalesce("over", F.array().cast(dict(over.dtypes)["over"])).alias("over"),
    )
    profile = materialize(profile, "sense-profiles")
    blocks = max(
        math.ceil(math.sqrt(2 * parallelism(words.sparkSession))), math.ceil(profile.count() / BLOCK_SENSES)
    )
    placed = profile.withColumn("tile", _block("word", blocks))
    parts = _tiled(words, blocks).withColumn("kind", F.lit(PAIRS))
    parts = parts.unionByName(_spread(placed, blocks, FIRST, SECOND))
    if above is not None:
        met = placed.select("tile", F.explode("over").alias("synset_id")).distinct()
        parts = parts.unionByName(_spread(met.join(above, "synset_id"), blocks, ABOVE_FIRST, ABOVE_SECOND))
    tiles = parts.groupBy("tile")
    kinds = dict(words.dtypes) if by_word else dict.fromkeys(("s1", "s2"), dict(synsets.dtypes)["synset_id"])
    names = ["w1", "w2", value] if by_word else ["s1", "s2", value]
    schema = f"{names[0]} {kinds[names[0]]}, {names[1]} {kinds[names[1]]}, {value} double"
    out = tiles.applyInArrow(_score_tile(above is not None, by_word, True, names), schema)
    if by_word or not profile.where(~F.col("sole")).limit(1).count():
        return out
    # a synset of several words may meet another in several tiles
    several = tiles.applyInArrow(_score_tile(above is not None, by_word, False, names), schema)
    return out.unionByName(several.dropDuplicates(["s1", "s2"]))


def _spread(rows: DataFrame, blocks: int, first: int, second: int) -> DataFrame:
    """Packed rows of a block, sent to the tiles of which it is the first or the second."""
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    block = F.col("tile")
    to = F.explode(
        F.concat(
            F.transform(others, lambda x: F.struct((block * blocks + x).alias("tile"), F.lit(first).alias("kind"))),
            F.transform(others, lambda x: F.struct((x * blocks + block).alias("tile"), F.lit(second).alias("kind"))),
        )
    ).alias("to")
    names = ["tile", *[c for c in rows.columns if c != "tile"]]
    packed = rows.select(*names).mapInArrow(_pack_rows, PACKED)
    return packed.select(to, "payload").select("to.tile", "payload", "to.kind")
