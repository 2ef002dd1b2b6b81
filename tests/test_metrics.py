import numpy as np
import pytest
from helpers import (
    blobs, ch_value, db_value, labeling_df, points_df, silhouette_values, wcss_value,
)
from pyspark.sql import functions as F

from lexigrove.operators import metrics as met


@pytest.fixture(scope="module")
def data(spark):
    x, labels = blobs()
    other = np.arange(len(x)) % 7
    other[0] = 9  # a singleton
    both = labeling_df(spark, labels, "a").unionByName(labeling_df(spark, other, "b", 10))
    return x, labels, other, points_df(spark, x).persist(), both.persist()


def by_algorithm(df, col):
    return {r["algorithm"]: r[col] for r in df.collect()}


def test_wcss_and_ch(data):
    x, labels, other, e, a = data
    w, c = by_algorithm(met.wcss(a, e), "wcss"), by_algorithm(met.calinski_harabasz(a, e), "calinski_harabasz")
    for name, y in (("a", labels), ("b", other)):
        assert np.isclose(w[name], wcss_value(x, y)) and np.isclose(c[name], ch_value(x, y))


def test_total_sum_of_squares_is_the_same_for_every_labeling(data):
    x, _, _, e, a = data
    rows = met.evaluate(a, e).collect()
    tss = [
        r["wcss"] * (1 + r["calinski_harabasz"] * (r["n_clusters"] - 1) / (r["n_points"] - r["n_clusters"]))
        for r in rows
    ]
    assert np.allclose(tss, ((x - x.mean(0)) ** 2).sum())


@pytest.mark.parametrize("block_rows", [2, 1024])
def test_davies_bouldin_blocks(data, block_rows):
    x, labels, other, e, a = data
    got = by_algorithm(met.davies_bouldin(a, e, block_rows=block_rows), "davies_bouldin")
    assert np.isclose(got["a"], db_value(x, labels)) and np.isclose(got["b"], db_value(x, other))


@pytest.mark.parametrize("block_rows,max_columns", [(None, None), (7, 3), (1000, 1)])
def test_silhouette_blocks_and_column_slices(data, block_rows, max_columns):
    x, labels, other, e, a = data
    got = met.silhouette_samples(a, e, block_rows=block_rows, max_columns=max_columns).collect()
    for name, y in (("a", labels), ("b", other)):
        mine = {r["word_id"]: r["silhouette"] for r in got if r["algorithm"] == name}
        assert np.allclose([mine[i] for i in range(len(x))], silhouette_values(x, y))


def test_label_permutation_changes_nothing(spark, data):
    x, labels, _, e, _ = data
    a = labeling_df(spark, labels)
    b = a.withColumn("cluster", (F.col("cluster") * 5 + 3) % 4)
    names = ["wcss", "silhouette", "davies_bouldin", "calinski_harabasz"]
    one, two = (met.evaluate(t, e).first() for t in (a, b))
    assert np.allclose([one[n] for n in names], [two[n] for n in names])


def test_null_clusters_are_left_out(spark, data):
    x, labels, _, e, _ = data
    a = labeling_df(spark, labels).withColumn(
        "cluster", F.when(F.col("word_id") >= 10, F.col("cluster"))
    )
    r = met.evaluate(a, e).first()
    assert r["n_points"] == len(x) - 10
    assert np.isclose(r["silhouette"], silhouette_values(x[10:], labels[10:]).mean())


def test_sampling_only_where_asked(data):
    x, labels, _, e, a = data
    full = by_algorithm(met.silhouette(a, e), "silhouette")["a"]
    same = by_algorithm(met.silhouette(a, e, sample_size=len(x)), "silhouette")["a"]
    assert np.isclose(full, same)
    ids = [{r[0] for r in met.sample_points(e.repartition(p), 20).select("word_id").collect()} for p in (1, 16)]
    assert ids[0] == ids[1] and len(ids[0]) == 20
    part = sorted(ids[0])
    row = met.silhouette(a, e, sample_size=20)
    got = by_algorithm(row, "silhouette")["a"]
    assert row.first()["silhouette_points"] == 20
    assert np.isclose(got, silhouette_values(x[part], labels[part]).mean())


def test_hand_made_edges(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [-1.0, 0.0]])
    y = np.array([0, 0, 1, 1, 2])
    r = met.evaluate(labeling_df(spark, y), points_df(spark, x)).first()
    # no spread at all: W = 0, every ratio 0, singleton scores 0
    assert (r["wcss"], r["calinski_harabasz"], r["davies_bouldin"]) == (0.0, 1.0, 0.0)
    assert np.isclose(r["silhouette"], 4 / 5)
    # coincident centroids are skipped
    y = np.array([0, 1, 0, 1, 2])
    got = met.davies_bouldin(labeling_df(spark, y), points_df(spark, x)).first()["davies_bouldin"]
    assert np.isclose(got, db_value(x, y))


def test_one_cluster_is_an_error(spark, data):
    x, _, _, e, _ = data
    a = labeling_df(spark, np.zeros(len(x), int), k=1)
    with pytest.raises(ValueError, match="two clusters"):
        met.silhouette(a, e)
    for fn in (met.davies_bouldin, met.calinski_harabasz):
        with pytest.raises(Exception, match="two clusters"):
            fn(a, e).collect()


def test_count_check_and_inertia(spark, data):
    x, labels, _, e, _ = data
    a = labeling_df(spark, labels, k=6)
    r = met.cluster_count_check(a).first()
    assert (r["n_clusters"], r["shortfall"]) == (4, 2)
    centers = met.centroids(a, e).select("algorithm", "k", "cluster", F.col("centroid").alias("center"))
    assert np.isclose(met.inertia(a, e, centers).first()["inertia"], wcss_value(x, labels))


def test_one_hot_cluster(spark):
    """A third of the rows are one vector in one cluster."""
    x, _ = blobs(n=90, seed=5)
    x[:30] = x[0]
    y = np.where(np.arange(90) < 30, 0, 1 + np.arange(90) % 3)
    e, a = points_df(spark, x), labeling_df(spark, y)
    got = met.evaluate(a, e, block_rows=16).first()
    assert np.isclose(got["silhouette"], silhouette_values(x, y).mean())
    assert np.isclose(got["davies_bouldin"], db_value(x, y))
