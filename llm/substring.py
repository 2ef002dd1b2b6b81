"""Removal of repeated passages, found by difference-cover anchors.

A window is ``window`` consecutive words of one text. Only positions in a difference cover
modulo ``period`` are hashed, ``window - period + 1`` words each: for any two equal windows
some offset below the period puts both on the cover, so equal windows share an aligned
anchor. Anchors that occur twice are extended to the windows around them, which are hashed
whole; the earliest start of each is kept, and words under any later one go. Anchors and
windows send one entry per chunk of documents, so common passages are combined before the
shuffle, and no pairs of documents are made.

Order is by document id, then by position. Null texts have no words; rows with a null id come
last and count as one document, as do rows that share an id: the same start in them is one
start. Windows are compared by 128 bits of hash between chunks and 64 bits inside one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import chunks
from .words import hash_words, one_array, rank_words, split_words, window_hash

NULL_ID = np.iinfo(np.int64).max
DIVIDE = 2  # of the size of chunks, as a task holds about 13 bytes for each byte of text


def difference_cover(period: int) -> list[int]:
    """Residues whose differences give every residue: greedy, by the most new differences."""
    cover, found = [0], {0}
    while len(found) < period:
        def new(c):
            gained = {(c - x) % period for x in cover} | {(x - c) % period for x in cover}
            return len(gained - found)

        best = max(range(period), key=new)
        found |= {(best - x) % period for x in cover} | {(x - best) % period for x in cover}
        cover.append(best)
    return sorted(cover)


class _Words:
    """Hashed words of a chunk with the bounds of their texts."""

    def __init__(self, distinct, codes, counts, ids):
        self.distinct, self.codes, self.counts, self.ids = distinct, codes, counts, ids
        ends = np.cumsum(counts)
        self.ends = np.repeat(ends.astype(np.int32), counts)
        self.at = np.arange(len(codes), dtype=np.int32)
        self.pos = self.at - np.repeat((ends - counts).astype(np.int32), counts)

    def hashes(self, width: int, lane: int = 0) -> np.ndarray:
        """For each word the hash of the window that starts there; 0 where it doesn't fit."""
        out = np.zeros(len(self.codes), np.uint64)
        found = window_hash(hash_words(self.distinct, lane)[self.codes], width, lane)
        out[: len(found)] = found
        return out

    def fits(self, width: int) -> np.ndarray:
        return self.at + width <= self.ends

    def doc(self) -> np.ndarray:
        return np.repeat(self.ids, self.counts)


def _mark(n: int, starts: np.ndarray, before: int, behind: int) -> np.ndarray:
    """Places from ``before`` ahead of a start to ``behind`` after it, the last one left out."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.maximum(starts - before, 0), 1)
    np.add.at(steps, np.minimum(starts + behind, n), -1)
    return np.cumsum(steps[:n]) > 0


def _twice(values: np.ndarray) -> np.ndarray:
    """The values that occur more than once, sorted."""
    ordered = np.sort(values)
    return np.unique(ordered[1:][ordered[1:] == ordered[:-1]])


def remove_repeats(
    docs: DataFrame,
    window: int = 20,
    period: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs``, and ``n_words``, ``n_removed`` and ``kept`` (text).

    ``id_col`` holds integers. ``period`` defaults to two thirds of the window.
    """
    spark = docs.sparkSession
    taken = {"n_words", "n_removed", "kept"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here; rename them first")
    period = max(1, 2 * window // 3) if period is None else period
    if not 1 <= period <= window:
        raise ValueError("the period must be from 1 to the window's length")
    anchor = window - period + 1
    on_cover = np.zeros(period, bool)
    on_cover[difference_cover(period)] = True
    parts = chunks.n_parts(spark)
    rest = [c for c in docs.columns if c != text_col]

    def anchors_of(w: _Words) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero(on_cover[w.pos % period] & w.fits(anchor))
        return places, w.hashes(anchor)[places]

    def make(table: pa.Table):
        words, counts = split_words(table[text_col])
        distinct, codes = rank_words(words)
        ids = pc.fill_null(one_array(table[id_col]).cast(pa.int64()), NULL_ID).to_numpy()
        w = _Words(distinct, codes, counts, ids)
        rows = np.frombuffer(chunks.dump_table(table.select(rest)), np.uint8)
        listed = np.frombuffer(chunks.dump_words(distinct), np.uint8)
        yield chunks.BODY, chunks.dumps(rows, listed, codes, counts, ids)
        yield from chunks.hash_blocks(np.unique(anchors_of(w)[1]), parts)

    def read(body: bytes) -> tuple[pa.Table, _Words]:
        rows, listed, codes, counts, ids = chunks.loads(body)
        w = _Words(chunks.load_words(listed.tobytes()), codes, counts, ids)
        return chunks.load_table(rows.tobytes()), w

    def extend(chunk: int, body: bytes, replies: list[bytes]) -> pa.Table:
        """The windows around anchors that occur twice, with their first start in the chunk."""
        _, w = read(body)
        places, hashes = anchors_of(w)
        # anchors repeated in this chunk alone are left to the last step
        places = places[chunks.member(hashes, chunks.gathered(replies))]
        near = _mark(len(w.codes), places, period - 1, 1) & w.fits(window)
        at = np.flatnonzero(near)
        a, b = w.hashes(window)[at], w.hashes(window, 1)[at]
        doc, pos = w.doc()[at], w.pos[at]
        order = np.lexsort((pos, doc, b, a))
        a, b, doc, pos = a[order], b[order], doc[order], pos[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rows = list(chunks.hash_blocks(a[first], parts, b[first], doc[first], pos[first]))
        return pa.table(
            {
                "chunk": pa.array([chunk] * len(rows), pa.int64()),
                "part": pa.array([p for p, _ in rows], pa.int32()),
                "payload": pa.array([d for _, d in rows], pa.binary()),
            }
        )

    def later(payloads: list[bytes]) -> list[bytes | None]:
        """For each block, the windows that start earlier in another block."""
        blocks = [chunks.loads(p) for p in payloads]
        a, b, doc, pos = (np.concatenate(x) for x in zip(*blocks))
        owner = np.repeat(np.arange(len(blocks)), [len(x[0]) for x in blocks])
        order = np.lexsort((pos, doc, b, a))
        a, b, doc, pos, owner = a[order], b[order], doc[order], pos[order], owner[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        after = (doc != doc[lead]) | (pos != pos[lead])
        a, owner = a[after], owner[after]
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(blocks) + 1))
        found = [a[order[cuts[i] : cuts[i + 1]]] for i in range(len(blocks))]
        return [chunks.dumps(x) if len(x) else None for x in found]

    def finish(chunk: int, body: bytes, replies: list[bytes]) -> pa.Table:
        rows, w = read(body)
        places = np.flatnonzero(w.fits(window))
        hashes = w.hashes(window)[places]
        gone = chunks.member(hashes, chunks.gathered(replies))
        # repeats inside the chunk, past the first start
        mine = np.flatnonzero(chunks.member(hashes, _twice(hashes)) & ~gone)
        doc, pos, h = w.doc()[places[mine]], w.pos[places[mine]], hashes[mine]
        order = np.lexsort((pos, doc, h))
        mine, doc, pos, h = mine[order], doc[order], pos[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
        gone[mine[(doc != doc[lead]) | (pos != pos[lead])]] = True

        removed = _mark(len(w.codes), places[gone], 0, window)
        sums = np.concatenate([[0], np.cumsum(removed)])
        ends = np.cumsum(w.counts)
        n_removed = sums[ends] - sums[ends - w.counts]
        offsets = np.concatenate([[0], np.cumsum(w.counts - n_removed)]).astype(np.int32)
        words = w.distinct.take(pa.array(w.codes[~removed]))
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ")
        made = {"n_words": w.counts, "n_removed": n_removed, "kept": kept}
        return pa.table([*rows.columns, *(pa.array(v) for v in made.values())], names=[*rest, *made])

    bodies, blocks = chunks.build(docs, text_col, make, "substring-chunks", divide=DIVIDE)
    windows = chunks.meet(bodies, chunks.exchange(blocks, chunks.shared_hashes), extend, chunks.ROWS)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [f"`{c}` {kinds[c]}" for c in rest]
    schema = ", ".join([*columns, "n_words long, n_removed long, kept string"])
    return chunks.meet(bodies, chunks.exchange(windows, later), finish, schema)
