import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.operators import vector_sums, vectors


@pytest.fixture()
def words(spark):
    return spark.createDataFrame([(0, "ab"), (1, "abc"), (2, "zz")], "word_id long, word string")


def test_lookup_drops_unknown(spark, words):
    vocab = spark.createDataFrame([("ab", 1), ("zz", 0)], "word string, idx long")
    weights = spark.createDataFrame([(0, [0.0, 2.0]), (1, [3.0, 4.0])], "idx long, features array<float>")
    got = {r["word"]: r["features"] for r in vectors.lookup_vectors(words, vocab, weights).collect()}
    assert got == {"ab": [3.0, 4.0], "zz": [0.0, 2.0]}


def test_whole_word(spark):
    lexicon = spark.createDataFrame([("ab", 5.0), ("q", 9.0), ("zz", 1.0)], "word string, frequency double")
    vocab = spark.createDataFrame([("ab", 1), ("zz", 0)], "word string, idx long")
    weights = spark.createDataFrame([(0, [0.0, 2.0]), (1, [3.0, 4.0])], "idx long, features array<float>")
    got = vectors.whole_word_embeddings(lexicon, vocab, weights, 1).collect()
    assert [(r["word_id"], r["word"], [round(x, 6) for x in r["features"]]) for r in got] == [(0, "ab", [0.6, 0.8])]


@pytest.mark.parametrize("limit", [0, 10**9])
def test_subword_sums_both_join_ways(spark, words, monkeypatch, limit):
    monkeypatch.setattr(vectors, "NGRAM_BROADCAST_BYTES", limit)
    table = spark.createDataFrame(
        [("<ab", [1.0, 0.0]), ("<ab>", [0.0, 1.0]), ("abc", [5.0, 5.0])], "ngram string, features array<float>"
    )
    got = {r["word"]: r["features"] for r in vectors.subword_vectors(words, table).collect()}
    assert got == {"ab": [1.0, 1.0], "abc": [6.0, 5.0], "zz": [0.0, 0.0]}
    unit = {r["word"]: r["features"] for r in vectors.subword_embeddings(words, table).collect()}
    assert unit["zz"] == [0.0, 0.0] and abs(np.linalg.norm(unit["abc"]) - 1) < 1e-6


def test_masked_mean_pool(spark):
    rows = [(0, 0, 1, [2.0, 0.0]), (0, 1, 1, [4.0, 2.0]), (0, 2, 0, [9.0, 9.0]),
            (0, 16, 1, [99.0, 99.0]), (1, 0, 0, [7.0, 7.0])]
    t = spark.createDataFrame(rows, "word_id long, pos int, mask int, hidden array<float>")
    got = {r["word_id"]: r["features"] for r in vectors.masked_mean_pool(t).collect()}
    assert got == {0: [3.0, 1.0], 1: [0.0, 0.0]}


def test_contextual_batches(spark, words):
    def factory():
        def encode(batch, max_length):
            batch = [w[:max_length] for w in batch]
            assert len(batch) <= 2
            n = max(len(w) for w in batch)
            mask = np.array([[i < len(w) for i in range(n)] for w in batch], float)
            hidden = np.stack([mask * 3, mask * 4], axis=2)
            return hidden, mask
        return encode

    got = vectors.contextual_embeddings(words, factory, batch_size=2).collect()
    assert len(got) == 3
    for r in got:
        assert np.allclose(r["features"], [0.6, 0.8])


@pytest.mark.parametrize("budget", [0, 10**9])
@pytest.mark.parametrize("partitions", [1, 16])
def test_sum_vectors_matches_numpy(spark, monkeypatch, budget, partitions):
    monkeypatch.setattr(vector_sums, "COMBINE_BYTES", budget)
    df = spark.range(2000).select(
        (F.col("id") % 7).alias("a"),
        F.when(F.col("id") % 3 == 0, None).otherwise("x").alias("b"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"),
    ).repartition(partitions)
    got = {(r["a"], r["b"]): r["v"] for r in vector_sums.sum_vectors(df, ["a", "b"], "v").collect()}
    expected = {}
    for i in range(2000):
        key = (i % 7, None if i % 3 == 0 else "x")
        s = expected.setdefault(key, [0.0, 0.0])
        s[0] += i
        s[1] += 1
    assert got == expected


def test_ragged_vectors_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "a int, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="same length"):
        vector_sums.sum_vectors(df, ["a"], "v").collect()


def test_repeated_ngrams_count_each_time(spark):
    words = spark.createDataFrame([(0, "banana"), (1, "ab")], "word_id long, word string")
    table = spark.createDataFrame([("ana", [1.0]), ("<ab>", [5.0])], "ngram string, features array<float>")
    once = {r["word"]: r["features"] for r in vectors.subword_vectors(words, table).collect()}
    each = {r["word"]: r["features"] for r in vectors.subword_vectors(words, table, distinct=False).collect()}
    assert once == {"banana": [1.0], "ab": [5.0]} and each == {"banana": [2.0], "ab": [5.0]}


def test_encoder_must_cut_its_tokens(spark, words):
    def factory():
        return lambda batch, max_length: (np.ones((len(batch), 3, 1)), np.ones((len(batch), 3)))

    with pytest.raises(Exception, match="encoder gave 3 tokens"):
        vectors.contextual_embeddings(words, factory, max_length=2).collect()


def test_ngrams_of_words_are_never_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "NGRAM_BROADCAST_BYTES", 0)
    spark.range(200).selectExpr("id word_id", "repeat(cast(id as string), 20) word").write.parquet(f"{tmp_path}/w")
    words = spark.read.parquet(f"{tmp_path}/w")
    grams = vectors.word_ngrams(words).select("ngram").distinct()
    grams.selectExpr("ngram", "array_repeat(1f, 64) features").write.parquet(f"{tmp_path}/g")
    table = spark.read.parquet(f"{tmp_path}/g")
    out = vectors.subword_vectors(words, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the only broadcast that may remain is that of the sums, for the join with the words
    assert "BuildLeft" not in plan and plan.count("SortMergeJoin [ngram") == 1
    assert out.count() == 200
