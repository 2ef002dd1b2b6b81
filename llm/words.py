"""Words of whole texts as Arrow and NumPy arrays, inside tasks.

A word is a run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ALL = 2**64 - 1
_KEYS = ("0123456789123456", "6543219876543210")


def one_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def split_words(texts) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text (null: 0)."""
    texts = pc.fill_null(one_array(texts).cast(pa.string()), "")
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    lists = pc.ascii_split_whitespace(texts)
    words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    keep = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = np.add.reduceat(keep.astype(np.int64), starts)
    if not keep.all():
        words = words.filter(pa.array(keep))
    return words, counts


def rank_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, the most frequent first, and each word's place among them."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), rank[codes]


def hash_words(words: pa.Array, lane: int = 0) -> np.ndarray:
    """64-bit hash of each word; the lanes are independent."""
    if not len(words):
        return np.zeros(0, np.uint64)
    values = words.to_numpy(zero_copy_only=False)
    return pd.util.hash_array(values, hash_key=_KEYS[lane], categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hash(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive entries, in log2(width) passes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, step, block = _BASE[lane], 1, hashes
    out, done, left = None, 0, width
    while left:
        if left & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * np.uint64(base) + part
            done += step
        left >>= 1
        if left:
            block = block[:-step] * np.uint64(base) + block[step:]
            base, step = base * base & _ALL, step * 2
    return mix(out)
