"""What a task costs: words that a library gets at once, bytes that a chunk takes."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from llm import bpe, chunks, repair, substring
from llm.queries import tokenizer_path


class _Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, library):
        self.library, self.texts, self.model = library, 0, library.model
        self.get_vocab = library.get_vocab

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **how)


ODD = [
    "a", "É", "é", "́", "don't", "'s", "x's", "a b", " ", "İ", "ß", "ªº", "µ", "<|endoftext|>",
    "a<|endoftext|>", "abc<|", "</w>", "a</w>", "123", "a1", "a,b", ",a", "a,.!", "漢字", "\x1c", "a\x85", "×", "a÷",
    "é" * 3000 + "!!", "‍",
]


def test_simple_words_reach_the_library_many_at_a_time():
    text = bpe.read_tokenizer(tokenizer_path())
    assert bpe.joins_words(text)
    words = pa.array([*(a + b for a in ODD for b in ODD), *(f"word{'x' * (i % 40)}," for i in range(3000))])
    single, many = _Counting(bpe._library(text)), _Counting(bpe._library(text))
    one, joined = bpe.encode_words(single, words), bpe.encode_words(many, words, True)
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(one, joined))
    assert single.texts == len(words) and many.texts < len(words) - 2900


def test_words_are_encoded_alone_where_pieces_cannot_be_told():
    library = bpe._library(bpe.read_tokenizer(tokenizer_path()))
    words = pa.array(["one", "two"])
    ids, lengths = bpe.encode_words(library, words)
    # a wrong number of pieces does not meet the marked ends
    found = bpe._encode_joined(library, words, np.array([1, 2]))
    assert np.array_equal(found[0], ids) and np.array_equal(found[1], lengths)


def _plain_rounds(ids, n_symbols, least):
    """Pair grammar by dictionaries: the frequent pairs of a round, the more frequent of overlapping ones first."""
    seq, rules, top = ids.tolist(), [], n_symbols
    while True:
        count = {}
        for p in zip(seq, seq[1:]):
            count[p] = count.get(p, 0) + 1
        ranked = sorted((p for p in count if count[p] >= least), key=lambda p: (-count[p], p))
        rank = {p: i for i, p in enumerate(ranked)}
        if not rank:
            return rules, seq
        own = [rank.get(p, len(rank)) for p in zip(seq, seq[1:])]
        around = [len(rank), *own, len(rank)]
        chosen = [i for i, r in enumerate(own) if r < len(rank) and r < around[i] and r <= around[i + 2]]
        used = sorted({own[i] for i in chosen})
        name = {r: top + k for k, r in enumerate(used)}
        rules += [ranked[r] for r in used]
        top += len(used)
        for i in chosen:
            seq[i] = name[own[i]]
        gone = {i + 1 for i in chosen}
        seq = [s for i, s in enumerate(seq) if i not in gone]


@pytest.mark.parametrize("n, kinds, least", [(0, 1, 2), (1, 1, 2), (40, 1, 2), (500, 2, 2), (3000, 5, 3), (20000, 60, 16)])
def test_pair_grammar_equals_a_plain_one(n, kinds, least):
    ids = np.random.default_rng(n).integers(0, kinds, n).astype(np.int32)
    rules, symbols = repair.compress(ids, kinds, least=least)
    plain_rules, plain = _plain_rounds(ids, kinds, least)
    assert [tuple(r) for r in rules.tolist()] == plain_rules and symbols.tolist() == plain


def test_a_search_for_pairs_is_only_made_where_hashes_meet(monkeypatch):
    """Places of frequent pairs come from a table; only the few others are searched for."""
    ids = np.random.default_rng(0).integers(0, 40, 200_000).astype(np.int32)
    searched, plain = [], np.searchsorted

    def counted(a, v, *args, **how):
        searched.append(np.size(v))
        return plain(a, v, *args, **how)

    monkeypatch.setattr(repair.np, "searchsorted", counted)
    repair.compress(ids, 40, rounds=2)
    assert sum(searched) < 20_000


def test_a_chunk_of_the_substring_search_takes_little_memory(monkeypatch):
    """Two tasks of an executor hold a chunk each, besides the JVM."""
    held = {}

    def build(docs, text_col, make, name, chunk_bytes=chunks.CHUNK_BYTES, divide=1):
        held.update(make=make, bytes=chunk_bytes // divide)
        raise KeyError(name)

    class Session:
        class conf:
            get = staticmethod(lambda key: "51")

    class Docs:
        columns, sparkSession = ["doc_id", "text"], Session

    monkeypatch.setattr(chunks, "build", build)
    with pytest.raises(KeyError):
        substring.remove_repeats(Docs)
    rng = np.random.default_rng(0)
    words = np.array([f"w{i:05d}" for i in range(2000)])
    texts = [" ".join(words[rng.integers(0, 2000, 7000)]) for _ in range(held["bytes"] // 49_000)]
    table = pa.table({"doc_id": np.arange(len(texts)), "text": texts})
    tracemalloc.start()
    list(held["make"](table))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak
