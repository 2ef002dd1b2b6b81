"""BPE encoding and decoding over a table of distinct words.

Whole texts are split at ASCII white space in Spark. Each distinct word of the corpus is
encoded once, in the part it is dealt to, and its ids go back to the chunks that hold it,
where they are joined to the texts by position. Decoding joins ids with the id-to-piece
table, which has one row per entry of the vocabulary and travels with the tasks.

The split is safe for tokenizers that drop white space and whose normaliser and splitter
never look across it, as ``word_bpe_49k.json``; others are refused.

Null and empty texts have no ids and decode to an empty text. Rows keep their id, null and
repeated ids included; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .words import hash_words, one_array, rank_words, split_words

ENCODE_SLICE = 5_000  # words that the library encodes in one call
JOINED = 64  # words that it may get as one text
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# words that this splitter makes one and two pieces of: letters that stay letters in lower case, and marks behind them
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PIECES = (f"{_LETTERS}$", _LETTERS + r"[!-&(-/:-@\[-`{-~]+$")
DECODE_ROWS = 512  # rows whose pieces are joined at once


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON, checked to drop white space and to decode by joining pieces."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = any(s["type"] == "Split" and s["behavior"] == "Removed" for s in steps)
    if not drops or spec.get("decoder") or any(s.get("add_prefix_space") for s in steps):
        raise ValueError("the tokenizer must drop white space and have no decoder")
    return text


def _library(text: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(text)
    library.no_truncation()
    library.no_padding()
    return library


def joins_words(text: str) -> bool:
    """Whether the splitter and normaliser are those for which ``_PIECES`` counts the pieces."""
    spec = json.loads(text)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    patterns = [s.get("pattern") for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
    return patterns == [{"Regex": SPLITTER}] and {s["type"] for s in steps} <= {"NFC", "Replace", "Lowercase"} and all(
        s["pattern"] == {"Regex": "\\s+"} for s in steps if s["type"] == "Replace"
    )


def _encode(library, texts: list[str]) -> list:
    return library.encode_batch_fast(texts, add_special_tokens=False)


def _flat(lists) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int32)


def _encode_joined(library, words: pa.Array, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode_words``, for words that are ``pieces`` pieces each: many as one text, cut behind their pieces.

    The last id of a piece has the suffix; where a piece lacks it, the words are encoded one by one.
    """
    vocabulary, suffix = library.get_vocab(), library.model.end_of_word_suffix
    last = np.zeros(1 + max(vocabulary.values(), default=0), bool)
    last[[i for word, i in vocabulary.items() if suffix and word.endswith(suffix)]] = True
    lengths, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), ENCODE_SLICE):
        part, n = words.slice(at, ENCODE_SLICE), pieces[at : at + ENCODE_SLICE]
        offsets = np.append(np.arange(0, len(part), JOINED), len(part)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([part])), " ")
        found = _flat(e.ids for e in _encode(library, texts.to_pylist()))
        ends = np.flatnonzero(last[found]) + 1
        if len(ends) == n.sum():
            sizes = np.diff(ends[np.cumsum(n) - 1], prepend=0)
        else:
            found, sizes = encode_words(library, part)
        ids.append(found)
        lengths.append(sizes.astype(np.int32))
    return np.concatenate(ids), np.concatenate(lengths)


def encode_words(library, words: pa.Array, joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of ids of each word.

    ``joined``: simple words go to the library many at a time, see ``joins_words``.
    """
    if joined and len(words):
        one, two = (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in _PIECES)
        simple = one | two
        order = np.argsort(~simple, kind="stable")
        n = int(simple.sum())
        moved = words.take(pa.array(order))
        parts = _encode_joined(library, moved.slice(0, n), (1 + two)[order[:n]]), encode_words(library, moved.slice(n))
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        lengths, starts = np.empty(len(words), np.int32), np.empty(len(words), np.int64)
        lengths[order], starts[order] = sizes, np.cumsum(sizes) - sizes
        return take_runs(ids, starts, lengths), lengths
    lengths, ids = np.zeros(len(words), np.int32), [np.zeros(0, np.int32)]
    for at in range(0, len(words), ENCODE_SLICE):
        found = [e.ids for e in _encode(library, words.slice(at, ENCODE_SLICE).to_pylist())]
        lengths[at : at + len(found)] = [len(x) for x in found]
        ids.append(_flat(found))
    return np.concatenate(ids), lengths


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[i]:starts[i] + lengths[i]]`` one after another."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    at = np.repeat(shift.astype(np.int32 if total < 2**31 else np.int64), lengths)
    at += np.arange(total, dtype=at.dtype)
    return values[at]


def encode_chunks(docs: DataFrame, path: str, finish, schema: str, id_col: str, text_col: str):
    """Encode ``docs`` by chunk; ``finish(chunk, ids, counts, tokens)`` makes the rows of a chunk.

    It gets the id column, the number of token ids of each row and the ids of all rows in
    the order of the rows of the chunk.
    """
    spark = docs.sparkSession
    parts = chunks.n_parts(spark)
    text = read_tokenizer(path)
    tokenizer, joined = spark.sparkContext.broadcast(text), joins_words(text)  # as large as the vocabulary

    def make(table: pa.Table):
        words, counts = split_words(table[text_col])
        distinct, codes = rank_words(words)
        part = (hash_words(distinct) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        ids = chunks.dump_table(table.select([id_col]))
        body = chunks.dumps(np.frombuffer(ids, np.uint8), counts, codes, place)
        yield chunks.BODY, body
        cuts = np.append(np.searchsorted(part[order], np.arange(parts)), len(order))
        for p in range(parts):
            if cuts[p + 1] > cuts[p]:
                mine = distinct.take(pa.array(order[cuts[p] : cuts[p + 1]]))
                yield p, chunks.dump_words(mine)

    loaded = []  # once per task

    def reply(payloads: list[bytes]) -> list[bytes]:
        if not loaded:
            loaded.append(_library(tokenizer.value))
        blocks = [chunks.load_words(p) for p in payloads]
        coded = pa.concat_arrays(blocks).dictionary_encode()
        ids, lengths = encode_words(loaded[0], coded.dictionary, joined)
        small = np.uint16 if len(ids) == 0 or ids.max() < 2**16 else np.int32
        ids, starts = ids.astype(small), np.cumsum(lengths) - lengths
        codes, at, out = coded.indices.to_numpy(), 0, []
        for block in blocks:
            mine = codes[at : at + len(block)]
            at += len(block)
            out.append(chunks.dumps(lengths[mine], take_runs(ids, starts[mine], lengths[mine])))
        return out

    def join(chunk: int, body: bytes, replies: list[bytes]) -> pa.Table:
        rows, counts, codes, place = chunks.loads(body)
        answers = [chunks.loads(r) for r in replies]
        none = [np.zeros(0, np.int32)]
        lengths = np.concatenate([a[0] for a in answers] or none)
        values = np.concatenate([a[1] for a in answers] or none)
        starts, at = np.cumsum(lengths) - lengths, place[codes]
        tokens = take_runs(values, starts[at], lengths[at]).astype(np.int32)
        sums = np.concatenate([[0], np.cumsum(lengths[at])])
        ends = np.cumsum(counts)
        per_row = sums[ends] - sums[ends - counts]
        ids = chunks.load_table(rows.tobytes()).column(0)
        return finish(chunk, ids, per_row, tokens)

    kept = docs.select(id_col, text_col)
    bodies, blocks = chunks.build(kept, text_col, make, "bpe-chunks")
    return chunks.meet(bodies, chunks.exchange(blocks, reply), join, schema)


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded_col: str | None = None,
) -> DataFrame:
    """One row per document: its id and ``ids``, the token ids of its whole text.

    ``decoded_col`` adds what ``decode`` would, in the same tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>"
    pieces = None
    if decoded_col:
        schema += f", `{decoded_col}` string"
        pieces = docs.sparkSession.sparkContext.broadcast(pieces_of(path))  # as long as the vocabulary

    def rows(chunk, ids, counts, tokens):
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))
        columns = {id_col: one_array(ids), "ids": lists}
        if pieces is not None:
            columns[decoded_col] = _joined(lists, pa.array(pieces.value, pa.string()))
        return pa.table(columns)

    return encode_chunks(docs, path, rows, schema, id_col, text_col)


def _joined(lists: pa.ListArray, pieces: pa.Array) -> pa.ChunkedArray:
    """The pieces of each list of ids, joined by spaces; a null list has none."""
    out = []
    for at in range(0, len(lists), DECODE_ROWS):
        part = lists.slice(at, DECODE_ROWS)
        starts = part.offsets.to_numpy()
        texts = pa.ListArray.from_arrays(pa.array(starts - starts[0]), pieces.take(part.flatten()))
        out.append(pc.binary_join(texts, " "))
    return pa.chunked_array(out, pa.string())


def pieces_of(path: str) -> list[str]:
    """The id-to-piece table of a vocabulary."""
    library = _library(read_tokenizer(path))
    size = library.get_vocab_size(with_added_tokens=True)
    return [library.id_to_token(i) or "" for i in range(size)]


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of each list of ids: its pieces, joined by spaces (null list: empty text)."""
    spark = encoded.sparkSession
    listed = spark.sparkContext.broadcast(pieces_of(path))  # as long as the vocabulary
    schema = encoded.select("*", F.lit("").alias(out_col)).schema

    def task(batches):
        pieces = pa.array(listed.value, pa.string())
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = _joined(batch.column(ids_col), pieces)
            yield from table.append_column(out_col, texts).to_batches()

    return encoded.mapInArrow(task, schema)
