"""Removal of repeated byte strings by distributed prefix doubling over a sparse set of suffixes.

A window is ``length`` consecutive bytes of one text. A byte goes if a window over it also starts
in a document with a smaller id. Prefix doubling gives every position the rank of the string of
2^k bytes that starts there, from the pair of ranks at the position and at the offset 2^(k-1).
Only equality counts here, so a rank is a 64-bit name: tasks make the names of their positions
from pairs at growing offsets, Spark sorts them at two lengths, and what is unique is left out.

- Seeds, ``seed`` bytes: all positions would be far more than the texts, so a position takes part
  if its name is the least of a window's (the leftmost of equal ones). This depends on the
  window's content alone, so equal windows have their seed at the same offset, and one in ten
  to twenty positions is left. Names that one document holds alone drop out.
- Stretches: the windows of a seed are consecutive, and together they are one string, named by
  its first and last window and its length. Equal stretches are settled at once by the smallest
  id that has them; a seed whose stretches are all equal needs no more. Long copies end here.
- Past the threshold: for seeds with several stretches, one document of each stretch names all
  its windows, and the smallest id of each decides.

Between chunks windows count by two names (96 bits), stretches by their own and that of their
seed, which is a part of them. Each chunk sends a name once, so frequent strings are merged
before the shuffle, and the number of parts follows the bytes of the texts. A chunk holds whole
texts, so a task needs about 60 bytes of memory for each byte of the longest one.

Null texts are empty; texts shorter than a window lose nothing. Rows with a null id come last and
count as one document, as do rows that share an id. An empty table gives no rows. Columns named
like those made here are refused before any work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.runtime import materialize

from . import chunks
from .words import mix, one_array, window_hash

NULL_ID = np.iinfo(np.int64).max
CHUNK_BYTES = 4 * 1024 * 1024
PART_BYTES = 8 * 1024 * 1024  # of text for each part of an exchange
_STRIDE = 1 << 17  # windows whose least names are looked for at a time
_LOW = np.uint64((1 << 24) - 1)
_MADE = ("n_bytes", "n_removed", "spans", "kept")
_SYMBOL = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def scan(text: np.ndarray, seed: int, length: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Names of all strings of ``seed`` bytes, from pairs at doubling offsets, and for each window the
    place of the least name in it, the leftmost of equal ones.

    Names are compared by their upper 40 bits, so that the place fits below them.
    """
    span = length - seed + 1
    names = np.zeros(max(0, len(text) - seed + 1), np.uint64)
    places = np.zeros(max(0, len(names) - span + 1), np.int64)
    for lo in range(0, len(names), _STRIDE):
        own = window_hash(_SYMBOL[lane][text[lo : lo + _STRIDE + length - 1]], seed, lane)
        names[lo : lo + _STRIDE] = own[:_STRIDE]
        if len(own) < span:
            continue
        key = own & ~_LOW | np.arange(len(own), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if step < span:
            key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
        key = key[: min(_STRIDE, len(places) - lo)]
        places[lo : lo + len(key)] = lo + (key & _LOW).astype(np.int64)
    return names, places


def doubled(names: np.ndarray, at: np.ndarray, width: int, length: int) -> np.ndarray:
    """Names of the strings of ``length`` bytes at some places: those of ``width`` bytes, in pairs."""
    if length <= width:
        return names[at]
    half = max(width, -(-length // 2))
    pair = doubled(names, at, width, half), doubled(names, at + (length - half), width, half)
    return mix(pair[0] * np.uint64(0x9FB21C651E98DF25) + pair[1])


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and the number of each text (null: 0)."""
    texts = pc.fill_null(one_array(column).cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


class _Chunk:
    """Windows of a chunk and the stretches that they form."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int, seed: int):
        self.text, self.sizes, self.length, self.width = text, sizes, length, seed
        self.ends = np.cumsum(sizes)
        self.short, at = scan(text, seed, length)
        # windows inside one text
        ok = np.repeat(self.ends, sizes)[: len(at)] - np.arange(len(at)) >= length
        turn = at[1:] != at[:-1]
        new, last = ok.copy(), ok.copy()
        new[1:] &= turn | ~ok[:-1]
        last[:-1] &= turn | ~ok[1:]
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(last)
        self.seed = self.short[at[self.first]]
        self.doc = ids[np.searchsorted(self.ends, self.first, side="right")]

    def stretches(self) -> np.ndarray:
        """The name of each stretch: of its first and last window and its length."""
        a, b = (doubled(self.short, at, self.width, self.length) for at in (self.first, self.last))
        size = (self.last - self.first).astype(np.uint64)
        return mix(a * np.uint64(0x9FB21C651E98DF25) + mix(b) + size)

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The name, the place and the document of every window of these stretches."""
        sizes = self.last[of] - self.first[of] + 1
        place = np.repeat(self.first[of] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return doubled(self.short, place, self.width, self.length), place, np.repeat(self.doc[of], sizes)

    def second(self, place: np.ndarray) -> np.ndarray:
        """Other names of these windows."""
        return doubled(scan(self.text, self.width, self.width, 1)[0], place, self.width, self.length)


def _least(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted by the first, with the smallest document of each."""
    order = np.lexsort((doc, *reversed(keys)))
    keys, doc = [k[order] for k in keys], doc[order]
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return (*(k[new] for k in keys), doc[new])


def _half(names: np.ndarray) -> np.ndarray:
    """The upper 32 bits."""
    return (names >> np.uint64(32)).astype(np.uint32)


def _several(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The keys that come with more than one value, sorted."""
    order = np.lexsort((values, keys))
    k, v = keys[order], values[order]
    return np.unique(k[1:][(k[1:] == k[:-1]) & (v[1:] != v[:-1])])


def _answer(blocks: list[list[np.ndarray]], *mark: np.ndarray) -> list[bytes | None]:
    """For blocks of (name, other name, smallest document): the names with a smaller one elsewhere, and it."""
    owner = np.repeat(np.arange(len(blocks)), [len(b[0]) for b in blocks])
    a, b, doc = (np.concatenate(x) for x in zip(*blocks))
    order = np.lexsort((doc, b, a))
    a, b, doc, owner = a[order], b[order], doc[order], owner[order]
    new = np.ones(len(doc), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = doc != least
    a, least, owner = a[later], least[later], owner[later]
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(blocks) + 1))
    out = []
    for i in range(len(blocks)):
        mine = order[cuts[i] : cuts[i + 1]]
        out.append(chunks.dumps(a[mine], least[mine], *mark) if len(mine) else None)
    return out


def _settled(payloads: list[bytes]) -> list[bytes | None]:
    """Replies to stretches (their name, that of their seed, document): names and smaller documents.

    Replies to seeds (name, that of their one stretch or 0 for several): those with several stretches.
    """
    blocks = [chunks.loads(p) for p in payloads]
    if len(blocks[0]) == 3:
        return _answer(blocks)
    seeds = np.concatenate([b[0] for b in blocks])
    inside = np.concatenate([b[1] for b in blocks])
    open_ones = np.union1d(_several(seeds, inside), seeds[inside == 0])
    kept = [seed[chunks.member(seed, open_ones)] for seed, _ in blocks]
    return [chunks.dumps(k) if len(k) else None for k in kept]


def _earliest(payloads: list[bytes]) -> list[bytes | None]:
    """Replies to windows (both names, document); a third, empty array tells them from others."""
    return _answer([chunks.loads(p) for p in payloads], np.zeros(0, np.int64))


def _smallest(names: np.ndarray, doc: np.ndarray, replies: list[list[np.ndarray]]) -> np.ndarray:
    """The smallest document of each name, of this chunk and of the replies."""
    one, least = _least(
        np.concatenate([doc, *(r[1] for r in replies)]), np.concatenate([names, *(r[0] for r in replies)])
    )
    return least[np.searchsorted(one, names)]


def _spans(removed: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs of each text: their number by text, starts and stops in the text."""
    ends = np.cumsum(sizes)
    full = sizes > 0
    edge = np.zeros(len(removed) + 1, bool)
    edge[(ends - sizes)[full]] = True
    before, after = np.zeros(len(removed), bool), np.zeros(len(removed), bool)
    before[1:], after[:-1] = removed[:-1], removed[1:]
    start = np.flatnonzero(removed & (edge[:-1] | ~before))
    edge[ends[full]] = True
    stop = np.flatnonzero(removed & (edge[1:] | ~after)) + 1
    owner = np.searchsorted(ends, start, side="right")
    offset = (ends - sizes)[owner]
    return np.bincount(owner, minlength=len(sizes)), start - offset, stop - offset


def remove_repeated_bytes(
    docs: DataFrame,
    length: int = 50,
    seed: int = 25,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """All columns of ``docs`` but the text, and ``n_bytes``, ``n_removed``, ``spans`` (maximal removed
    runs, start to stop) and ``kept`` (the remaining bytes). ``id_col`` holds integers."""
    if taken := set(_MADE) & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} are made here; rename them first")
    if not 1 <= seed <= length:
        raise ValueError("the seed must be from 1 to the length")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(chunks.n_parts(docs.sparkSession), -(-total // part_bytes))
    rest = [c for c in docs.columns if c != text_col]

    def make(table: pa.Table):
        text, sizes = _bytes_of(table[text_col])
        ids = pc.fill_null(one_array(table[id_col]).cast(pa.int64()), NULL_ID).to_numpy()
        rows = np.frombuffer(chunks.dump_table(table.select(rest)), np.uint8)
        yield chunks.BODY, chunks.dumps(rows, text, sizes, ids)

    def read(body: bytes) -> tuple[pa.Table, _Chunk]:
        rows, text, sizes, ids = chunks.loads(body)
        return chunks.load_table(rows.tobytes()), _Chunk(text, sizes, ids, length, seed)

    def sent(chunk: int, rows: list[tuple[int, bytes]]) -> pa.Table:
        kinds = {"chunk": pa.int64(), "part": pa.int32(), "payload": pa.binary()}
        columns = [[chunk] * len(rows), [p for p, _ in rows], [d for _, d in rows]]
        return pa.table({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), columns)})

    def seeds(batches):
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("payload")):
                rows = list(chunks.hash_blocks(np.unique(read(body.as_py())[1].seed), parts))
                yield from sent(chunk, rows).to_batches()

    def stretches(chunk: int, body: bytes, replies: list[bytes]) -> pa.Table:
        """The stretches whose seed another document has, and for each seed its one stretch."""
        _, c = read(body)
        several = np.union1d(_several(c.seed, c.doc), chunks.gathered(replies))
        of = np.flatnonzero(chunks.member(c.seed, several))
        names, seeds = c.stretches()[of], c.seed[of]
        name, its_seed, doc = _least(c.doc[of], names, seeds)
        rows = list(chunks.hash_blocks(name, parts, _half(its_seed), doc))
        one, first = np.unique(seeds, return_index=True)
        inside = names[first]
        inside[chunks.member(one, _several(seeds, names))] = 0
        more = chunks.hash_blocks(one, parts, inside)
        return sent(chunk, rows + [(parts + p, d) for p, d in more])

    def settle(c: _Chunk, replies: list[bytes]):
        """Per stretch the smallest document that has it; the stretches left; replies to windows."""
        got = [chunks.loads(r) for r in replies]
        best = _smallest(c.stretches(), c.doc, [g for g in got if len(g) == 2])
        open_ones = [g[0] for g in got if len(g) == 1]
        open_ones = np.sort(np.concatenate(open_ones)) if open_ones else np.zeros(0, np.uint64)
        left = np.flatnonzero((best == c.doc) & chunks.member(c.seed, open_ones))
        return best, left, [g for g in got if len(g) == 3]

    def windows(chunk: int, body: bytes, replies: list[bytes]) -> pa.Table:
        """The windows of stretches that are not settled, once for each stretch."""
        _, c = read(body)
        a, place, doc = c.windows(settle(c, replies)[1])
        a, b, doc = _least(doc, a, _half(c.second(place)))
        return sent(chunk, list(chunks.hash_blocks(a, parts, b, doc)))

    def finish(chunk: int, body: bytes, replies: list[bytes]) -> pa.Table:
        rows, c = read(body)
        best, left, answers = settle(c, replies)
        gone = best < c.doc
        a, place, doc = c.windows(left)
        later = _smallest(a, doc, answers) < doc
        steps = np.zeros(len(c.text) + 1, np.int32)
        np.add.at(steps, np.concatenate([c.first[gone], place[later]]), 1)
        np.add.at(steps, np.concatenate([c.last[gone], place[later]]) + length, -1)
        removed = np.cumsum(steps[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(removed)])
        n_removed = sums[c.ends] - sums[c.ends - c.sizes]
        n_spans, start, stop = _spans(removed, c.sizes)
        pairs = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], names=["start", "stop"])
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_spans)), pa.int32()), pairs)
        offsets = np.append(0, np.cumsum(c.sizes - n_removed)).astype(np.int32)
        kept = pa.BinaryArray.from_buffers(
            pa.binary(), len(c.sizes), [None, pa.py_buffer(offsets), pa.py_buffer(c.text[~removed])]
        )
        made = [pa.array(c.sizes), pa.array(n_removed, pa.int64()), spans, kept]
        return pa.table([*rows.columns, *made], names=[*rest, *_MADE])

    bodies, _ = chunks.build(docs, text_col, make, "suffix-chunks", chunk_bytes)
    shared = chunks.exchange(bodies.mapInArrow(seeds, chunks.ROWS), chunks.shared_hashes)
    named = chunks.meet(bodies, shared, stretches, chunks.ROWS)
    settled = materialize(chunks.exchange(named, _settled), "suffix-settled")  # read twice
    earlier = chunks.exchange(chunks.meet(bodies, settled, windows, chunks.ROWS), _earliest)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [f"`{c}` {kinds[c]}" for c in rest]
    made = "n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"
    return chunks.meet(bodies, settled.unionByName(earlier), finish, ", ".join([*columns, made]))
