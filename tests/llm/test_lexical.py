"""Lexical search against scores computed document by document."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, k):
    texts = [(i, terms_of(t)) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n_docs, total = len(texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, t in texts:
            m = 100 - 90 + (90 * len(t) * n_docs) // total
            score = 0
            for x in wanted & set(t):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                score += w * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, doc, -s))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "日本", "İx"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 90]))) for _ in range(n)]
    docs = list(enumerate(texts)) + [(n, None), (n + 1, ""), (n + 2, " \t.,"), (None, "w1 w2 w3"), (3, texts[3]), (n + 3, texts[4])]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 12])))) for i in range(12)]
    return docs, items + [(90, None), (91, "absent"), (0, "W7 w8"), (None, "w5")]


def shown(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("reach, shard, pairs", [(512, 8 << 20, 10**6), (4, 900, 10**6), (7, 3000, 30)])
def test_search_equals_brute_force(spark, monkeypatch, reach, shard, pairs):
    monkeypatch.setattr(lexical, "RANGE", reach)
    monkeypatch.setattr(lexical, "QUERY_TERMS", pairs)
    plain = lexical.build_index
    monkeypatch.setattr(lexical, "build_index", lambda *a: plain(*a, shard_bytes=shard))
    docs, items = corpus(160, reach)
    found = lexical.search(
        spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k=4
    )
    assert shown(found) == sorted(expected(docs, items, 4), key=str)


def lists_of(docs, stats, shard_docs):
    lexical_lists = []
    import pyarrow as pa

    for at in range(0, len(docs), shard_docs):
        part = docs[at : at + shard_docs]
        columns = lexical._shard(0, pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part]), None)
        names = [c.split()[0] for c in lexical.INDEX.split(", ")]
        row = next(lexical._rows(pa.RecordBatch.from_arrays(columns, names=names)))
        lexical_lists.append(lexical._Lists(row, set(row["terms"]), *stats))
    return lexical_lists


def test_blocks_below_the_threshold_stay_packed(monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 16)
    rng = random.Random(5)
    docs = [(i, " ".join(["common"] * rng.randint(1, 3) + [f"x{rng.randint(0, 400)}"] * 2)) for i in range(1600)]
    docs[700] = (700, "rare rare rare common")
    docs[20] = (20, "rare common x1")
    total = sum(len(terms_of(t)) for _, t in docs)
    (lists,) = lists_of(docs, (1600, total), 1600)
    weights = lexical.term_weight(1600, [2, 1600])
    bounds = [int(lists.blocks(t)[1].max()) for t in ("rare", "common")]
    asked = [("rare", int(weights[0]), bounds[0]), ("common", int(weights[1]), bounds[1])]
    places, _ = lexical.top_of_shard(lists, asked, 2)
    assert set(places[:2]) == {700, 20}
    assert lists.n_unpacked <= 4 < lists.n_ranges  # both lists of two ranges of a hundred


def test_terms_and_blocks():
    texts = ["A-b'C", "", None, "xİY z", "日本9_é"]
    words, counts = lexical.split_terms(__import__("pyarrow").array(texts))
    assert words.to_pylist() == [x for t in texts for x in terms_of(t)]
    assert counts.tolist() == [len(terms_of(t)) for t in texts]
    rng = np.random.default_rng(0)
    for n, top in ((1, 2), (40, 900), (512, 70_000)):
        docs = np.sort(rng.choice(512, n, replace=False))
        tfs = rng.integers(1, top, n)
        got = lexical._unpack(memoryview(lexical._pack(docs, tfs)))
        assert (got[0] == docs).all() and (got[1] == tfs).all()


def test_empty_tables_long_text_and_extra_columns(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "long word")], ITEMS).withColumn("rank", F.lit(9)).withColumn("score", F.lit(9))
    assert lexical.search(none, items).count() == 0
    docs = [(1, "long " * 400_000), (2, "a long word")]
    table = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("x")).withColumn("shard", F.lit(0))
    assert lexical.search(table, items.filter("item_id is null")).count() == 0
    assert shown(lexical.search(table, items)) == sorted(expected(docs, [(1, "long word")], 10), key=str)
