"""Token ids in binary shards, compressed by a pair grammar (Re-Pair).

Documents are sorted by id over the whole table and encoded; a shard holds the ids of
consecutive documents. Per shard, frequent pairs of neighbouring symbols are replaced by
nonterminals, many per round, until no pair is frequent enough or 16-bit symbols are used up;
that bounds the grammar, not the content. A shard stores the rules, the
number of ids each symbol expands to, and the symbols, so a document is found by summing
expansion lengths and decoded without its neighbours.

A shard is a row of a Parquet table: its number, its ids' count, the smallest and largest
document id, and ``payload``: "RPR1", then the number of arrays and for each its type, its
length and its Zstandard data: document ids, nulls, token counts, rules (left, right),
expansion lengths of the rules, symbols.

Null and empty texts have the end id alone. Null document ids come first; repeated ids are
separate documents, in the order of their texts. An empty table gives no shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .bpe import encode_chunks
from .words import one_array

MAGIC = b"RPR1"
_SPREAD = np.uint32(0x9E3779B1)
SHARD = "shard long, n_docs long, n_tokens long, first_doc long, last_doc long, payload binary"


def compress(
    ids: np.ndarray, n_symbols: int, rounds: int | None = None, per_round: int = 4096, least: int = 16
) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule r stands for symbol ``n_symbols + r`` and holds two symbols.

    Goes on until no pair occurs ``least`` times or the symbols are used up, unless ``rounds`` ends it.
    """
    seq = ids.astype(np.uint32)
    rules = [np.zeros((0, 2), np.int64)]
    top, done = n_symbols, 0
    while rounds is None or done < rounds:
        done += 1
        room = min(per_round, (1 << 16) - top)
        if len(seq) < 2 or room <= 0:
            break
        pairs = seq[:-1] << np.uint32(16)
        pairs |= seq[1:]
        ordered = np.sort(pairs)
        # a pair that occurs often enough is met again ``least - 1`` places further on
        again = ordered[: max(0, len(ordered) - least + 1)]
        again = again[again == ordered[least - 1 :]]
        del ordered
        edge = np.flatnonzero(np.append(True, again[1:] != again[:-1])[: len(again)])
        values, count = again[edge], np.diff(np.append(edge, len(again))) + least - 1
        if not len(values):
            break
        if len(values) > room:
            best = np.argpartition(-count, room - 1)[:room]
            values, count = values[best], count[best]
        order = np.argsort(values)
        values, count = values[order], count[order]
        rank = np.empty(len(values), np.int32)
        rank[np.lexsort((values, -count))] = np.arange(len(values))
        # places of the pairs, by a hash; of values that share one, those left out are searched for
        slot = np.zeros(1 << 21, np.uint16)
        slot[values * _SPREAD >> np.uint32(11)] = np.arange(1, len(values) + 1)
        found = slot[pairs * _SPREAD >> np.uint32(11)]
        maybe = np.flatnonzero(found > 0)
        at, wanted = found[maybe].astype(np.int64) - 1, pairs[maybe]
        del pairs, found
        hit = values[at] == wanted
        missed = np.flatnonzero(~hit)
        at[missed] = np.minimum(np.searchsorted(values, wanted[missed]), len(values) - 1)
        hit[missed] = values[at[missed]] == wanted[missed]
        maybe, own = maybe[hit], rank[at[hit]]
        del at, wanted, hit, missed
        # of overlapping pairs the more frequent one goes first
        touch = maybe[1:] == maybe[:-1] + 1
        first = np.ones(len(own), bool)
        first[1:] = ~touch | (own[1:] < own[:-1])
        first[:-1] &= ~touch | (own[:-1] <= own[1:])
        chosen, own = maybe[first], own[first]
        used = np.flatnonzero(np.bincount(own, minlength=len(values)))
        symbol = np.zeros(len(values), np.uint32)
        symbol[used] = np.arange(top, top + len(used))
        by_rank = np.empty(len(values), np.int64)
        by_rank[rank] = values
        made = by_rank[used]
        rules.append(np.stack([made >> 16, made & 0xFFFF], axis=1))
        seq[chosen] = symbol[own]
        keep = np.ones(len(seq), bool)
        keep[chosen + 1] = False
        seq = seq[keep]
        top += len(used)
    return np.concatenate(rules), seq


def expansion_lengths(rules: np.ndarray, n_symbols: int) -> np.ndarray:
    """Ids that each rule expands to; rules refer to earlier rules only."""
    out = np.ones(n_symbols + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        out[n_symbols + r] = out[a] + out[b]
    return out[n_symbols:]


def expand(symbols: np.ndarray, rules: np.ndarray, n_symbols: int) -> np.ndarray:
    """The ids that symbols stand for: each rule is written out once, then gathered."""
    sizes = np.append(np.ones(n_symbols, np.int64), expansion_lengths(rules, n_symbols))
    starts = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.uint32)
    ids[:n_symbols] = np.arange(n_symbols)
    ends = (starts + sizes).tolist()
    begins = starts.tolist()
    for r, (a, b) in enumerate(rules.tolist(), n_symbols):
        middle = begins[r] + ends[a] - begins[a]
        ids[begins[r] : middle] = ids[begins[a] : ends[a]]
        ids[middle : ends[r]] = ids[begins[b] : ends[b]]
    symbols = symbols.astype(np.int64)
    long = sizes[symbols]
    shift = starts[symbols] - (np.cumsum(long) - long)
    return ids[np.repeat(shift, long) + np.arange(int(long.sum()))]


class Shard:
    """A shard that is read: whole, or one document at a time."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        meta, self.ids, self.nulls, self.counts, pairs, self.lengths, self.symbols = chunks.loads(payload[4:])
        self.n_symbols = int(meta[0])
        self.rules = pairs.reshape(2, -1).T.astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def tokens(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.n_symbols)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, from the symbols that overlap it alone."""
        symbols = self.symbols.astype(np.int64)
        size = np.ones(len(symbols), np.int64)
        big = symbols >= self.n_symbols
        size[big] = self.lengths[symbols[big] - self.n_symbols]
        ends = np.cumsum(size)
        start, stop = int(self.starts[i]), int(self.starts[i] + self.counts[i])
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        found = expand(symbols[lo : hi + 1], self.rules, self.n_symbols)
        before = int(ends[lo] - size[lo]) if lo < len(ends) else start
        return found[start - before : stop - before]


def pack(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, n_symbols: int, **how) -> bytes:
    rules, symbols = compress(ids, n_symbols, **how)
    lengths = expansion_lengths(rules, n_symbols)
    return MAGIC + chunks.dumps(
        np.array([n_symbols], np.int64),
        doc_ids.astype(np.int64),
        nulls.astype(np.uint8),
        counts.astype(np.int64),
        rules.T.ravel().astype(np.uint16),
        lengths.astype(np.int32),
        symbols.astype(np.uint16),
    )


def write(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    end_id: int = 2,
    vocabulary: int = 49_408,
    id_col: str = "doc_id",
    text_col: str = "text",
    **how,
) -> None:
    """Encode ``docs``, end each document with ``end_id`` and write the shards to ``out``.

    ``vocabulary`` is the number of ids, at most 65,536.
    """
    if not 0 <= end_id < vocabulary <= 1 << 16:
        raise ValueError("ids and rules share 16-bit symbols")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kept = kept.repartitionByRange(n, F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def shard(chunk, ids, counts, tokens):
        ids = one_array(ids)
        full = np.insert(tokens, np.cumsum(counts), end_id)
        doc_ids = ids.fill_null(0).to_numpy()
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        payload = pack(doc_ids, nulls, counts + 1, full, vocabulary, **how)
        real = doc_ids[~nulls]
        bounds = [[int(real.min())], [int(real.max())]] if len(real) else [[None], [None]]
        return pa.table(
            [
                pa.array([chunk], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([len(full)], pa.int64()),
                pa.array(bounds[0], pa.int64()),
                pa.array(bounds[1], pa.int64()),
                pa.array([payload], pa.binary()),
            ],
            names=["shard", "n_docs", "n_tokens", "first_doc", "last_doc", "payload"],
        )

    encode_chunks(kept, tokenizer, shard, SHARD, "doc_id", "text").write.parquet(out)


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def _rows(table: DataFrame, value, kind: str, name: str) -> DataFrame:
    """A row per document: doc_id, start, n_tokens and ``value`` of its ids."""
    # one row per shard is summed up in one task
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = table.select("shard", F.coalesce(before, F.lit(0)).alias("before"))

    def task(batches):
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist()):
                s = Shard(payload)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(s.ids), pa.int64()),
                        pa.array(s.ids, mask=s.nulls.astype(bool)),
                        pa.array(s.starts),
                        pa.array(s.counts),
                        value(s.tokens(), s.counts),
                    ],
                    names=["shard", "doc_id", "start", "n_tokens", name],
                )

    rows = table.select("shard", "payload").mapInArrow(
        task, f"shard long, doc_id long, start long, n_tokens long, {name} {kind}"
    )
    return rows.join(starts, "shard").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", name
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start is the number of ids of all documents before."""

    def lists(tokens, counts):
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.astype(np.int32)))

    return _rows(shards(spark, path), lists, "array<int>", "ids")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): checksums of the ids as little-endian 32-bit numbers."""

    def sums(tokens, counts):
        data = memoryview(tokens.astype("<u4").tobytes())
        ends = (np.cumsum(counts) * 4).tolist()
        starts = [0, *ends[:-1]]
        return pa.array([zlib.crc32(data[a:b]) for a, b in zip(starts, ends)], pa.int64())

    return _rows(shards(spark, path), sums, "long", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: shards by their bounds, ids by random access."""
    wanted = sorted(set(doc_ids))
    near = F.exists(
        F.array(*[F.lit(int(i)).cast("long") for i in wanted]) if wanted else F.array().cast("array<long>"),
        lambda i: i.between(F.col("first_doc"), F.col("last_doc")),
    )

    def task(batches):
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                s = Shard(payload)
                places = np.flatnonzero(np.isin(s.ids, wanted) & (s.nulls == 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.ids[places], pa.int64()),
                        pa.array([s.document(int(i)) for i in places], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "ids"],
                )

    return shards(spark, path).filter(near).select("payload").mapInArrow(task, "doc_id long, ids array<int>")
