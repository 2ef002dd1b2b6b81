"""Operators over chunks: BPE, Re-Pair shards, repeated passages, n-gram join."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from llm import bpe, ngram_join, repair, substring
from llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "don't  STOP now"),
    (6, "a<|endoftext|>b <|startoftext|>"), (7, "Été été İ 日本語 \U0001f600 12,345.6"), (7, "second row of one id"),
    (8, "long " * 5000), (None, "no id here"),
]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return path, Tokenizer.from_file(path)


def test_bpe_equals_the_library_on_whole_texts(spark):
    path, tok = library()
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    out = bpe.encode(docs, path, decoded_col="decoded").collect()
    want = []
    for i, text in ODD:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, tok.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_bpe_decode_join_and_empty_table(spark):
    path, tok = library()
    rows = spark.createDataFrame([(1, [320, 321]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, path).collect()}
    assert got == {1: tok.decode([320, 321], skip_special_tokens=False), 2: "", 3: ""}
    assert bpe.encode(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_repair_grammar_round_trip():
    rng = np.random.default_rng(1)
    for ids in (
        np.zeros(0, np.int64),
        np.array([5]),
        np.full(1001, 7),
        rng.integers(0, 4, 5000),
        np.tile(rng.integers(0, 1000, 37), 90),
    ):
        rules, symbols = repair.compress(ids, 1000, least=2)
        assert (repair.expand(symbols, rules, 1000) == ids).all()
        lengths = repair.expansion_lengths(rules, 1000)
        for r in range(len(rules)):
            assert len(repair.expand(np.array([1000 + r]), rules, 1000)) == lengths[r]
    assert len(symbols) < len(ids) / 5


def test_repair_shards(spark, tmp_path):
    path, tok = library()
    rows = [(i, t) for i, t in ODD if i is not None and i < 7] + [(20 + i, "again and again " * i) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    repair.write(docs, str(tmp_path / "out"), path, least=2)
    start = 0
    sums = {r["doc_id"]: r for r in repair.read_checksums(spark, str(tmp_path / "out")).collect()}
    ids = {r["doc_id"]: r for r in repair.read_ids(spark, str(tmp_path / "out")).collect()}
    for i, text in sorted(rows):
        want = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert ids[i]["ids"] == want and ids[i]["start"] == sums[i]["start"] == start
        assert sums[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    some = repair.read_documents(spark, str(tmp_path / "out"), [5, 33, 999]).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {i: ids[i]["ids"] for i in (5, 33)}
    repair.write(docs.limit(0), str(tmp_path / "none"), path)
    assert repair.read_ids(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("period", range(1, 24))
def test_difference_cover(period):
    cover = substring.difference_cover(period)
    assert {(a - b) % period for a, b in itertools.product(cover, cover)} == set(range(period))


def kept_by_force(rows, window):
    first, words = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = WORD.findall(text or "")
        words[i] = w
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone |= set(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def passages(seed, n=40):
    rng = random.Random(seed)
    shared = [" ".join(f"s{k}_{j}" for j in range(rng.randint(4, 30))) for k in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.6 else " ".join(str(rng.randint(0, 999)) for _ in range(rng.randint(1, 9))))
        rows.append((i * 3, "\n".join(parts)))
    return rows


@pytest.mark.parametrize("chunk_bytes", [1, 200, 1 << 24])
def test_repeats_equal_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(substring.chunks.build, "__defaults__", (chunk_bytes,))
    rows = passages(2) + [(500, None), (501, ""), (502, "x " * 60), (None, "x " * 30)]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], SCHEMA + ", chunk long").repartition(3)
    for window in (5, 20):
        got = substring.remove_repeats(docs, window=window).collect()
        want = kept_by_force(rows, window)
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == want
        assert all(r["chunk"] == r["doc_id"] for r in got)


def test_repeated_rows_of_an_id_are_one_document(spark):
    text = " ".join(map(str, range(25)))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], SCHEMA)
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 25)]
    assert substring.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(docs.withColumnRenamed("doc_id", "kept"), id_col="kept")


def sets_by_force(rows, n):
    out = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def near_copies(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = [str(rng.randint(0, 400)) for _ in range(rng.choice([2, 8, 30, 120, 300]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = str(rng.randint(0, 400))
            rows.append((i, " ".join(copy)))
            i += rng.randint(1, 3)
            base = copy if rng.random() < 0.3 else base
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_join_equals_brute_force(spark, n, percent, seed):
    rows = near_copies(seed) + [(9000, None), (9001, " "), (9002, "A b"), (9003, "a B")]
    sets = sets_by_force(rows, n)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    docs = spark.createDataFrame([*rows, (None, "A b")], SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(docs, n, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets} | {None: (1, None)}
    assert len({c for _, c in got.values()}) < len(got) - 10


def test_join_of_an_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (1, "a b c d")], SCHEMA)
    got = ngram_join.similarity_components(docs, 3, 90).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (3, 2, 1), (3, 2, 1)]
    assert ngram_join.similarity_components(docs.limit(0), 3, 90).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_every_similar_pair_shares_a_posted_block(percent):
    rng = np.random.default_rng(percent)
    for size in (5, 11, 40, 333, 2000):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        most = int((100 - percent) / (100 + percent) * 2 * size)
        for apart in {0, 1, most // 2, most}:
            b = np.concatenate([a[apart // 2 :], rng.integers(0, 2**63, apart - apart // 2, dtype=np.uint64)])
            both = size - apart // 2
            if 100 * both < percent * (size + len(b) - both) or not apart:
                continue
            keys = [set(ngram_join.posted_blocks(np.unique(x), percent).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_components_of_a_path_and_null_ends(spark):
    path = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3), (2, 1)]
    label = components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in label} == {i: 100 for i in range(100, 141)} | {1: 1, 2: 1}
