import pytest
from pyspark.sql import functions as F

from lexigrove.operators import ranking
from lexigrove.operators.lexicon import coverage_report, filter_by_vocab, select_words

LEXICON = [
    (" the", 9.0), ("the", 5.0), (None, 8.0), ("b", float("nan")), ("c", None), ("a", 5.0),
    ("d ", 5.0), (" ", 1.0),
]


@pytest.fixture()
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, frequency double").repartition(3)


def words(df):
    return [tuple(r) for r in df.orderBy("word_id").collect()]


def test_cut_before_cleaning_uses_up_places(lexicon):
    got = words(select_words(lexicon, 4, when="before"))
    # places: ' the' 9, null 8, 'a' 5, 'd ' 5
    assert got == [(0, "the", 9.0), (1, "a", 5.0), (2, "d", 5.0)]


def test_cut_after_cleaning(lexicon):
    assert [w for _, w, _ in words(select_words(lexicon, 4, when="after"))] == ["the", "a", "d", ""]


def test_no_limit_orders_missing_frequency_last(lexicon):
    got = words(select_words(lexicon))
    assert [w for _, w, _ in got] == ["the", "a", "d", "", "b", "c"]
    assert [i for i, _, _ in got] == list(range(6))
    assert got[4][2] is None and got[5][2] is None


def test_vocabulary_match_comes_before_the_cap(spark, lexicon):
    vocab = spark.createDataFrame([("d", 0), ("c", 1), ("zz", 2)], "word string, idx long")
    assert [w for _, w, _ in words(select_words(lexicon, 1, when="after", vocab=vocab))] == ["d"]
    assert [w for _, w, _ in words(select_words(lexicon, vocab=vocab))] == ["d", "c"]
    assert filter_by_vocab(lexicon, vocab).count() == 1  # 'c'; the padded 'd' differs


def test_coverage(spark):
    w = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    v = spark.createDataFrame([("b",), ("z",)], "word string")
    r = coverage_report(w, v).first()
    assert tuple(r)[:4] == (3, 2, 1, 2) and abs(r["coverage"] - 1 / 3) < 1e-12


@pytest.mark.parametrize("partitions", [1, 16])
def test_distributed_rank(spark, monkeypatch, partitions):
    monkeypatch.setattr(ranking, "SMALL_TABLE", 0)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(partitions)
    got = ranking.with_rank(df, [F.desc("v")], "r").collect()
    assert all(r["r"] == 999 - r["v"] for r in got) and len(got) == 1000


def test_large_top_takes_the_distributed_way(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_TABLE", 0)
    df = spark.range(50).select(F.col("id").alias("v"))
    got = ranking.top_ranked(df, [F.desc("v")], 5, "r", -F.col("v").cast("double")).orderBy("r").collect()
    assert [(r["v"], r["r"]) for r in got] == [(49, 0), (48, 1), (47, 2), (46, 3), (45, 4)]


def test_empty_lexicon(spark):
    empty = spark.createDataFrame([], "word string, frequency double")
    assert select_words(empty).count() == 0
    with pytest.raises(ValueError):
        select_words(empty, 5, when="sometimes")


def test_top_with_ties_at_the_cut(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_TABLE", 0)
    df = spark.range(600).select(F.col("id"), (F.col("id") % 3).cast("double").alias("low"))
    got = ranking.top_ranked(df, [F.col("low"), F.col("id")], 250, "r", F.col("low")).orderBy("r").collect()
    expected = sorted(((i % 3, i) for i in range(600)))[:250]
    assert [(r["low"], r["id"]) for r in got] == expected and [r["r"] for r in got] == list(range(250))
