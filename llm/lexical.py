"""Ranked lexical search: sharded posting lists in blocks, Block-Max MaxScore, merged heaps.

A shard is a bounded run of documents, one row of the index. Its lists are cut at fixed document
ranges into blocks, compressed one by one. A block also holds its skyline: the (tf, length) pairs
that no other posting of it beats in both, from which its largest score follows exactly for any
corpus statistics; so the index is built before they are known and stays valid when they change.

A search walks a shard range by range. Terms are ordered by their global bound, the best score any
document of the corpus gets from them. The lists whose bounds together stay below the current tenth
score are non-essential: they cannot bring in a document of their own. Candidates come from the
essential lists, a candidate whose score so far plus the block maxima of the other lists is below
the threshold goes, and only the blocks of those that are left are decompressed. Each shard gives
its heap, and the heaps are merged per query. Ties at the threshold stay in, so the result is exact.

Score: integers as in ``impact`` and ``term_weight``. Equal scores rank by ascending id, null ids last.
Null and empty texts have no terms and take no part; rows that share an id are documents of their
own; rows that share a query id are one query with the terms of all. Empty tables give no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.runtime import materialize

from .chunks import _slices
from .words import one_array

SHARD_BYTES = 8 * 1024 * 1024  # of text; a longer text is a shard of its own
RANGE = 512  # documents of a block
QUERY_TERMS = 200_000  # (query, term) pairs that are searched for in one pass
INDEX = (
    "shard long, n_docs long, n_terms long, ids array<long>, lengths array<int>, terms array<string>, df array<int>, "
    "list_at array<int>, block_range array<int>, block_at array<int>, sky_at array<int>, sky_tf array<int>, "
    "sky_len array<int>, data binary"
)

# digits, letters and all bytes beyond ASCII are term bytes; only A-Z change
_TERM = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_lo:_hi] = np.arange(_lo, _hi)
_TERM[0x41:0x5B] += 0x20


def split_terms(texts) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the number of terms of each text."""
    texts = pc.fill_null(one_array(texts).cast(pa.large_string()), "")
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = _TERM[raw]
    inside = np.empty(len(plain) + 1, bool)
    inside[:-1] = plain != 0x20
    inside[-1] = False
    # a text's first byte starts a term whatever stands before it
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    bounds = offsets - offsets[0]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[first] = inside[first]
    stop = inside[:-1] & ~inside[1:]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    stop[last] = inside[last]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    counts = np.diff(np.searchsorted(begin, bounds))
    sizes = end - begin
    at = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(plain[inside[:-1]]))
    return words, counts


def term_weight(n_docs, df) -> np.ndarray:
    return np.floor(1000.0 * np.log((2.0 * n_docs + 2.0) / (2.0 * np.asarray(df, np.float64) + 1.0))).astype(np.int64)


def impact(tf, length, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting gives for a weight of 1."""
    tf, length = np.asarray(tf, np.int64), np.asarray(length, np.int64)
    m = 100 - 90 + (90 * length * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- index -------------------------------------------------------------------------------------

def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 256 else np.uint16 if top < 65_536 else np.uint32)


def _pack(docs: np.ndarray, tfs: np.ndarray) -> bytes:
    """Places in the range, which is below 65,536, as gaps, and term frequencies."""
    gaps, tfs = _narrow(np.diff(docs, prepend=0)), _narrow(tfs)
    raw = gaps.tobytes() + tfs.tobytes()
    small = pa.compress(raw, codec="lz4", asbytes=True) if len(raw) > 64 else raw
    if len(small) >= len(raw):
        small = raw
    return struct.pack("<IBBI", len(docs), gaps.itemsize, tfs.itemsize, len(raw) if small is not raw else 0) + small


def _unpack(block: memoryview) -> tuple[np.ndarray, np.ndarray]:
    n, a, b, raw_len = struct.unpack_from("<IBBI", block)
    raw = block[struct.calcsize("<IBBI") :]
    if raw_len:
        raw = pa.decompress(pa.py_buffer(raw), raw_len, codec="lz4", asbytes=True)
    gaps = np.frombuffer(raw, f"<u{a}", n)
    return np.cumsum(gaps, dtype=np.int64), np.frombuffer(raw, f"<u{b}", n, n * a).astype(np.int64)


def _shard(shard: int, ids: pa.Array, texts, wanted: pa.Array | None) -> list:
    """The index row of one run of documents."""
    words, lengths = split_terms(texts)
    n_docs, n_terms = int((lengths > 0).sum()), int(lengths.sum())
    doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    if wanted is None:
        coded = words.dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    else:
        found = pc.index_in(words, wanted.cast(pa.large_string()))
        doc = doc[found.is_valid().to_numpy(zero_copy_only=False)]
        codes = found.drop_null().to_numpy().astype(np.int64)
        used, codes = np.unique(codes, return_inverse=True)
        terms = wanted.take(pa.array(used))
    # postings by term, range and place
    pairs, tfs = np.unique(codes * len(lengths) + doc, return_counts=True)
    term, doc = np.divmod(pairs, max(1, len(lengths)))
    ranges = doc // RANGE
    new_list = np.ones(len(term), bool)
    new_list[1:] = term[1:] != term[:-1]
    new_block = new_list.copy()
    new_block[1:] |= ranges[1:] != ranges[:-1]
    starts = np.flatnonzero(new_block)
    ends = np.append(starts[1:], len(term))
    data, sizes = [], []
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        data.append(_pack(doc[lo:hi] - doc[lo] // RANGE * RANGE, tfs[lo:hi]))
        sizes.append(len(data[-1]))
    # skylines: by falling tf, a pair stays if its text is shorter than all before it in the block
    block = np.cumsum(new_block) - 1
    size = lengths[doc]
    order = np.lexsort((size, -tfs, block))
    low = size[order] - block[order] * (int(lengths.max(initial=0)) + 1)
    keep = np.ones(len(order), bool)
    keep[1:] = low[1:] < np.minimum.accumulate(low)[:-1]
    kept = order[keep]
    ints = lambda a: pa.array(np.asarray(a), pa.int32())
    at = np.concatenate([[0], np.cumsum(sizes)]) if sizes else np.zeros(1)
    values = [
        pa.scalar(shard, pa.int64()), pa.scalar(n_docs, pa.int64()), pa.scalar(n_terms, pa.int64()), ids,
        ints(lengths), terms.cast(pa.string()), ints(np.diff(np.append(np.flatnonzero(new_list), len(term)))),
        ints(np.append(np.searchsorted(starts, np.flatnonzero(new_list)), len(starts))), ints(ranges[starts]),
        ints(at), ints(np.searchsorted(block[kept], np.arange(len(starts) + 1))), ints(tfs[kept]), ints(size[kept]),
        pa.scalar(b"".join(data), pa.binary()),
    ]
    one = []
    for v in values:
        if isinstance(v, pa.Array):
            one.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
        else:
            one.append(pa.array([v.as_py()], v.type))
    return one


def build_index(
    docs: DataFrame, terms: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per shard. With ``terms`` only their lists are kept; statistics cover all texts."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    wanted = None if terms is None else docs.sparkSession.sparkContext.broadcast(sorted(set(terms)))

    def task(batches):
        first = TaskContext.get().partitionId() << 32
        listed = None if wanted is None else pa.array(wanted.value, pa.string())
        for i, table in enumerate(_slices(batches, "_text", shard_bytes)):
            ids = one_array(table["_id"])
            yield pa.RecordBatch.from_arrays(_shard(first + i, ids, table["_text"], listed), names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(task, INDEX)


# --- search ------------------------------------------------------------------------------------

class _Lists:
    """A shard's lists as a search needs them: block maxima at hand, blocks unpacked when asked for."""

    def __init__(self, row: dict, best: dict, n_docs: int, n_terms: int):
        self.row, self.data = row, memoryview(row["data"])
        self.n_ranges = -(-len(row["lengths"]) // RANGE)
        self.place = {t: i for i, t in enumerate(row["terms"]) if t in best}
        top = impact(row["sky_tf"], row["sky_len"], n_docs, n_terms)
        self.maxima = np.maximum.reduceat(top, row["sky_at"][:-1]) if len(top) else top
        self.impacts = lambda doc, tf: impact(tf, row["lengths"][doc], n_docs, n_terms)
        self.unpacked, self.n_unpacked = {}, 0

    def blocks(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        """For each range, the term's block (-1: none) and its largest impact."""
        lo, hi = self.row["list_at"][self.place[term] : self.place[term] + 2]
        at, top = np.full(self.n_ranges, -1), np.zeros(self.n_ranges, np.int64)
        at[self.row["block_range"][lo:hi]] = np.arange(lo, hi)
        top[self.row["block_range"][lo:hi]] = self.maxima[lo:hi]
        return at, top

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the range, and their impacts; kept for the other queries of the shard."""
        found = self.unpacked.get(block)
        if found is None:
            lo, hi = self.row["block_at"][block : block + 2]
            places, tfs = _unpack(self.data[lo:hi])
            doc = places + int(self.row["block_range"][block]) * RANGE
            found = self.unpacked[block] = places, self.impacts(doc, tfs)
            self.n_unpacked += 1
        return found


def _order(ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, ~known, -scores))


def top_of_shard(lists: _Lists, terms: list[tuple[str, int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of at least the ``k`` best documents of a shard, ties at the end included.

    ``terms``: (term, weight, global bound of an impact).
    """
    own = sorted((w * bound, t, w) for t, w, bound in terms if t in lists.place and w > 0)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not own:
        return docs, scores
    weights = np.array([w for _, _, w in own], np.int64)
    below = np.cumsum([u for u, _, _ in own])  # bound of a list and all before it
    tables = [lists.blocks(t) for _, t, _ in own]
    at = np.stack([a for a, _ in tables])
    tops = np.stack([b for _, b in tables]) * weights[:, None]
    reach = tops.sum(axis=0)
    threshold = 1
    for r in np.argsort(-reach, kind="stable").tolist():  # the likeliest ranges first
        if reach[r] < threshold:
            break
        essential = int(np.searchsorted(below, threshold))  # lists before it stay below the threshold
        total, seen = np.zeros(RANGE, np.int64), np.zeros(RANGE, bool)
        for j in range(essential, len(own)):
            if at[j, r] >= 0:
                places, impacts = lists.read(int(at[j, r]))
                total[places] += weights[j] * impacts
                seen[places] = True
        places = np.flatnonzero(seen)
        sums = total[places]
        left = int(tops[:essential, r].sum())
        for j in range(essential - 1, -1, -1):
            near = sums + left >= threshold
            places, sums = places[near], sums[near]
            if not len(places):
                break
            left -= int(tops[j, r])
            if at[j, r] >= 0:
                found, impacts = lists.read(int(at[j, r]))
                spot = np.searchsorted(found, places)
                spot[spot == len(found)] = 0
                sums = sums + np.where(found[spot] == places, weights[j] * impacts[spot], 0)
        near = sums >= threshold
        docs = np.concatenate([docs, places[near] + r * RANGE])
        scores = np.concatenate([scores, sums[near]])
        if len(scores) >= k:
            threshold = max(threshold, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            docs, scores = docs[scores >= threshold], scores[scores >= threshold]
    return docs, scores


def _rows(batch: pa.RecordBatch):
    """The index rows of a batch, lists as NumPy arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            value = batch.column(name)[i]
            if name == "terms":
                row[name] = value.as_py()
            elif isinstance(value, pa.ListScalar):
                row[name] = value.values if name == "ids" else value.values.to_numpy().astype(np.int64)
            else:
                row[name] = value.as_buffer() if name == "data" else value.as_py()
        yield row


def _search(index: DataFrame, queries: list[tuple[int, list]], stats, k: int) -> DataFrame:
    """(query, doc_id, score): the heaps of all shards."""
    n_docs, n_terms = stats
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def task(batches):
        best = {t for _, terms in sent.value for t, _, _ in terms}
        for batch in batches:
            for row in _rows(batch):
                lists = _Lists(row, best, n_docs, n_terms)
                known = row["ids"].is_valid().to_numpy(zero_copy_only=False)
                ids = pc.fill_null(row["ids"], 0).to_numpy()
                q, d, s = [], [], []
                for query, terms in sent.value:
                    docs, scores = top_of_shard(lists, terms, k)
                    top = _order(ids[docs], known[docs], scores)[:k]
                    q.append(np.full(len(top), query))
                    d.append(docs[top])
                    s.append(scores[top])
                d = np.concatenate(d) if d else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(q) if q else d, pa.int64()),
                        row["ids"].take(pa.array(d)),
                        pa.array(np.concatenate(s) if s else d, pa.int64()),
                    ],
                    names=["query", "doc_id", "score"],
                )

    return index.mapInArrow(task, "query long, doc_id long, score long")


def query_terms(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """Distinct (item, term) of the query texts, by the same rule as for documents."""
    rows = queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("text"))

    def task(batches):
        for batch in batches:
            words, counts = split_terms(batch.column("text"))
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            items = one_array(batch.column("item")).take(owner)
            yield pa.RecordBatch.from_arrays([items, words.cast(pa.string())], names=["item", "term"])

    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(task, f"item {kind}, term string").distinct()


def term_bounds(index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(term, df, bound): document frequency and the largest impact of each term of the corpus."""

    def task(batches):
        for batch in batches:
            for row in _rows(batch):
                top = impact(row["sky_tf"], row["sky_len"], n_docs, n_terms)
                first = row["sky_at"][row["list_at"][:-1]]
                bound = np.maximum.reduceat(top, first) if len(top) else top
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["terms"], pa.string()), pa.array(row["df"]), pa.array(bound)],
                    names=["term", "df", "bound"],
                )

    columns = index.select("terms", "df", "list_at", "sky_at", "sky_tf", "sky_len")
    found = columns.mapInArrow(task, "term string, df long, bound long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.max("bound").alias("bound"))


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    query_id: str = "item_id",
    query_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``k`` best documents of each query, scores above 0 only.

    The queries are a stated set that goes to every task, about ``QUERY_TERMS`` (query, term) pairs
    at a time; larger sets are searched for in several passes over the index, which is written once.
    Its lists are those of the queries' terms while these fit one pass, and all lists otherwise.
    """
    spark = docs.sparkSession
    asked = materialize(query_terms(queries, query_id, query_text), "query-terms")
    passes = max(1, -(-asked.count() // QUERY_TERMS))
    only = [r["term"] for r in asked.select("term").distinct().collect()] if passes == 1 else None
    index = materialize(build_index(docs, only, id_col, text_col), "lexical-index")
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0
    weighed = asked.join(term_bounds(index, n_docs, n_terms), "term")
    if passes > 1:  # read once for each pass
        weighed = materialize(weighed, "query-bounds")
    kind = queries.schema[query_id].dataType
    found = None
    for one in range(passes):
        mine = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == one)
        by_item: dict = {}
        for r in mine.collect():
            by_item.setdefault(r["item"], []).append((r["term"], int(term_weight(n_docs, r["df"])), r["bound"]))
        heaps = _search(index, list(enumerate(by_item.values())), (n_docs, n_terms), k)
        names = spark.createDataFrame(list(enumerate(by_item)), T.StructType().add("query", "long").add(query_id, kind))
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        merged = heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        merged = merged.join(names, "query").select(query_id, "rank", F.col("doc_id").alias(id_col), "score")
        found = merged if found is None else found.unionByName(merged)
    return found
