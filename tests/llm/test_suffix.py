"""Removal of repeated byte strings against all windows of all texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import suffix

SCHEMA = "doc_id long, text string"


def expected(rows, length):
    first = {}
    raw = [(suffix.NULL_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (shown, _), (i, b) in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((shown, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def found(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "spans", "kept").collect()
    return sorted(((r[0], r[1], r[2], tuple((s[0], s[1]) for s in r[3]), bytes(r[4])) for r in rows), key=str)


def corpus(seed, n=60, letters="ab "):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices(letters, k=k))
    passages = [word(rng.choice([8, 12, 13, 30, 70])) for _ in range(6)] + ["é日" * 9, "x" * 40]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else word(rng.randint(0, 25)) for _ in range(rng.randint(0, 8))]
        rows.append((i * 3 % 61, "".join(parts)))
    rows += [(200, None), (201, ""), (202, rows[5][1]), (None, rows[6][1]), (None, "own text of no id, " * 3), (7, rows[7][1] + "!")]
    near = rows[8][1] * 3
    return rows + [(300 + k, near[:k] + "#" + near[k + 1 :]) for k in range(0, min(40, len(near)), 7)]


@pytest.mark.parametrize("seed, length, short, chunk, letters", [
    (1, 12, 5, 1 << 20, "abcdefgh "), (2, 12, 6, 200, "ab "), (3, 13, 13, 150, "abcd"), (4, 9, 1, 300, "abcdefghijkl"),
])
def test_removal_equals_brute_force(spark, seed, length, short, chunk, letters):
    rows = corpus(seed, letters=letters)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = suffix.remove_repeated_bytes(docs, length, short, chunk_bytes=chunk, part_bytes=400)
    assert found(out) == expected(rows, length)


def test_seeds_are_the_leftmost_least(monkeypatch):
    monkeypatch.setattr(suffix, "_STRIDE", 7)
    text = np.frombuffer(bytes(random.Random(0).choices(b"abc", k=300)), np.uint8)
    for seed, length in ((1, 1), (2, 3), (5, 12), (8, 34), (25, 50), (299, 300)):
        names, places = suffix.scan(text, seed, length)
        raw = text.tobytes()
        by_name = {}
        for p, name in enumerate(names.tolist()):
            assert by_name.setdefault(name, raw[p : p + seed]) == raw[p : p + seed]
        span = length - seed + 1
        assert len(names) == len(raw) - seed + 1 and len(places) == len(raw) - length + 1
        assert places.tolist() == [p + int(np.argmin(names[p : p + span] >> np.uint64(24))) for p in range(len(places))]


def test_doubled_names_tell_strings_apart():
    text = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=900)), np.uint8)
    raw = text.tobytes()
    for seed, length in ((1, 9), (3, 7), (25, 50), (24, 50), (5, 5)):
        at = np.arange(len(raw) - length + 1)
        names = suffix.doubled(suffix.scan(text, seed, length)[0], at, seed, length)
        assert len(set(names.tolist())) == len({raw[p : p + length] for p in at})


def test_bytes_of_slices():
    texts = pa.array(["aé", None, "", "日x"]).slice(1)
    raw, sizes = suffix._bytes_of(texts)
    assert raw.tobytes() == "日x".encode() and sizes.tolist() == [0, 0, 4]


def test_empty_table_long_text_and_clashing_columns(spark):
    assert suffix.remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefghij \n", k=400_000))
    rows = [(1, text), (2, "short"), (3, text[1000:90_000] + "end"), (4, text)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.lit("mine")).withColumn("payload", F.lit(1))
    out = suffix.remove_repeated_bytes(docs, chunk_bytes=100_000)
    assert [r["chunk"] for r in out.select("chunk").distinct().collect()] == ["mine"]
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in out.collect()}
    assert got == {1: (0, text.encode()), 2: (0, b"short"), 3: (89_000, b"end"), 4: (400_000, b"")}
    with pytest.raises(ValueError, match="kept"):
        suffix.remove_repeated_bytes(docs.withColumn("kept", F.lit(0)))
