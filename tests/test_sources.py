import pytest
from pyspark.sql import functions as F

from lexigrove import sources as src


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_lexicon_bom_padding_and_null_tokens(spark, tmp_path):
    path = tmp_path / "words.csv"
    path.write_text(
        '﻿ Word ,Frequency ,Length\nalpha,3,5\nNA,2,2\n"b, c",oops,4\n padded ,1.5,6\n,7,0\n',
        encoding="utf-8",
    )
    got = src.read_lexicon(spark, str(path))
    assert rows(got, "word", "frequency") == sorted(
        [("alpha", 3.0), (None, 2.0), ("b, c", None), (" padded ", 1.5), (None, 7.0)], key=str
    )
    kept = src.read_lexicon(spark, str(path), null_tokens=())
    assert ("NA", 2.0) in rows(kept, "word", "frequency")


def test_lexicon_without_frequency_or_word(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Word\nx\n")
    (tmp_path / "b.csv").write_text("Token\nx\n")
    assert rows(src.read_lexicon(spark, str(tmp_path / "a.csv")), "word", "frequency") == [
        ("x", None)
    ]
    with pytest.raises(ValueError, match="missing columns"):
        src.read_lexicon(spark, str(tmp_path / "b.csv"))


def test_first_match_order(spark, tmp_path):
    for name in ("one/deep/x34k.csv", "two/exact.csv", "two/y34k.csv"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("Word,Frequency\na,1\n")
    roots = [str(tmp_path / r) for r in ("absent", "two", "one")]
    assert src.find_first_match(spark, roots, ["exact.csv", "*34k*.csv"]).endswith("exact.csv")
    assert src.find_first_match(spark, roots[::2], ["exact.csv", "*34k*.csv"]).endswith("x34k.csv")
    assert src.read_first_match(spark, roots, ["*.csv"]).count() == 1
    with pytest.raises(FileNotFoundError):
        src.find_first_match(spark, roots, ["nothing"])
    parts = str(tmp_path / "one/deep/parts")
    words = spark.range(100).selectExpr("concat('w', id) AS Word", "id AS Frequency")
    words.repartition(4).write.option("header", True).csv(parts)
    whole = src.read_first_match(spark, roots, ["part-*.csv"], whole_folder=True)
    assert sorted(r["frequency"] for r in whole.collect()) == [float(i) for i in range(100)]


def test_vocab_line_numbers_over_many_splits(spark, tmp_path):
    words = [f"w{i}" for i in range(500)] + [" w3 ", "w7"]
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(words) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = dict(map(tuple, src.read_vocab(spark, str(path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = {w.strip(): i for i, w in enumerate(words)}
    assert got == expected


def test_embeddings_round_trip_and_missing(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", [1.0, 2.0])], "word_id long, word string, features array<double>")
    src.write_embeddings(df, str(tmp_path / "e"))
    got = src.read_embeddings(spark, [str(tmp_path / "absent"), str(tmp_path / "e")])
    assert got.schema["features"].dataType.simpleString() == "array<float>"
    assert rows(got, "word_id", "word", "features") == [(0, "a", [1.0, 2.0])]
    with pytest.raises(FileNotFoundError):
        src.read_embeddings(spark, str(tmp_path / "absent"))


def test_assignment_files(spark, tmp_path):
    (tmp_path / "KMeans_clusters.csv").write_text("Word,Cluster\na,0\nb,1\n")
    (tmp_path / "Spectral_clusters.csv").write_text("word,cluster\na,2\n")
    (tmp_path / "broken_clusters.csv").write_text("word\na\n")
    got = src.read_assignments(spark, str(tmp_path / "*_clusters.csv"))
    assert rows(got, "algorithm", "word", "cluster") == [
        ("KMeans", "a", 0), ("KMeans", "b", 1), ("Spectral", "a", 2)
    ]
    with pytest.raises(FileNotFoundError):
        src.read_assignments(spark, str(tmp_path / "broken_*.csv"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_assignments_is_partitioned(spark, tmp_path, fmt):
    df = spark.createDataFrame([("m", "x", "a", 1)], "model string, algorithm string, word string, cluster int")
    src.write_assignments(df, str(tmp_path / fmt), fmt)
    assert (tmp_path / fmt / "model=m" / "algorithm=x").is_dir()
    if fmt == "parquet":
        assert rows(src.read_assignments(spark, str(tmp_path / fmt)), "algorithm", "word", "cluster") == [("x", "a", 1)]


def test_metrics_by_name(spark, tmp_path):
    df = spark.createDataFrame(
        [(0.1, "x", 50, 1.0, 2.0, 3.0)],
        "Silhouette double, Algorithm string, k int, WCSS double, Davies_Bouldin double, Calinski_Harabasz double",
    )
    src.write_metrics(df, str(tmp_path / "m"))
    r = src.read_metrics(spark, [str(tmp_path / "no"), str(tmp_path / "m")]).first()
    assert (r["k"], r["Algorithm"], r["WCSS"], r["Silhouette"]) == (50, "x", 1.0, 0.1)
    with pytest.raises(FileNotFoundError):
        src.read_metrics(spark, str(tmp_path / "no"))


def test_coherence_nulls_survive(spark, tmp_path):
    df = spark.createDataFrame(
        [("x", None, None, 0, 200)],
        "Algorithm string, Mean_WordNet_Coherence double, Std_WordNet_Coherence double, Clusters_Evaluated int, Clusters_Skipped int",
    )
    src.write_coherence(df, str(tmp_path / "c"))
    assert tuple(src.read_coherence(spark, str(tmp_path / "c")).first()) == ("x", None, None, 0, 200)


def test_normalize_columns(spark):
    df = spark.range(1).select(F.col("id").alias(" Word "))
    assert src.normalize_columns(df).columns == ["Word"]
    assert src.normalize_columns(df, lower=True).columns == ["word"]
