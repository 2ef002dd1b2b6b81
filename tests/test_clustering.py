import numpy as np
import pytest
from helpers import (
    average_linkage, blobs, cut_labels, distances, labels_of, partition, points_df, wcss_value,
)
from pyspark.sql import functions as F

from lexigrove.operators import agglomerative as agg
from lexigrove.operators import gmm, kmeans, knn, minibatch, spectral
from lexigrove.plans import run_suite, sweep
from lexigrove.runtime import materialize


@pytest.fixture(scope="module")
def data(spark):
    x, labels = blobs(n=80)
    return x, labels, points_df(spark, x).persist()


@pytest.mark.parametrize("block_rows", [9, 1000])
def test_knn_is_exact(data, block_rows):
    x, _, e = data
    got = {(r["src"], r["rank"]): r["dst"] for r in knn.knn_graph(e, 5, block_rows=block_rows).collect()}
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert got == {(i, j + 1): order[i, j] for i in range(len(x)) for j in range(5)}


def test_knn_ties_and_copies(spark):
    line = np.array([[0.0, 1], [1, 1], [2, 1], [3, 1]])
    got = {(r["src"], r["rank"]): r["dst"] for r in knn.knn_graph(points_df(spark, line), 1).collect()}
    assert got == {(0, 1): 1, (1, 1): 0, (2, 1): 1, (3, 1): 2}
    x, _ = blobs(n=60)
    x[:20] = x[0]  # a third are copies
    rows = knn.knn_graph(points_df(spark, x), 3, block_rows=7).collect()
    for r in rows:
        if r["src"] < 20:
            others = [i for i in range(20) if i != r["src"]]
            assert r["dst"] == others[r["rank"] - 1] and r["distance"] == 0.0
    assert len(rows) == 180


def test_fewer_points_than_neighbours(spark):
    assert knn.knn_graph(points_df(spark, np.eye(3)), 10).count() == 6


def test_affinity_is_symmetric(data):
    x, _, e = data
    rows = knn.normalized_affinity(knn.knn_graph(e, 4)).collect()
    w = np.zeros((len(x), len(x)))
    for r in rows:
        w[r["src"], r["dst"]] = r["w"]
    assert np.array_equal(w, w.T)
    degree = w.sum(1)
    for r in rows:
        assert np.isclose(r["norm_w"], w[r["src"], r["dst"]] / np.sqrt(degree[r["src"]] * degree[r["dst"]]))


def test_lloyd_assigns_to_the_nearest_and_lowers_the_cost(data):
    x, _, e = data
    costs = [kmeans.lloyd(e, x[:4], max_iter=i, tol=0.0).cost for i in range(1, 6)]
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))
    for rounds in (2, 50):
        fit = kmeans.lloyd(e, x[:4], max_iter=rounds)
        y = labels_of(fit.labels, len(x))
        d2 = ((x[:, None] - fit.centers[None]) ** 2).sum(-1)
        assert np.array_equal(y, d2.argmin(1)) and np.isclose(fit.cost, d2.min(1).sum())
        assert fit.iterations <= rounds and (fit.converged or fit.iterations == rounds)


def test_centres_in_slices_give_the_same(data, monkeypatch):
    x, _, e = data
    whole = kmeans.lloyd(e, x[:6], max_iter=3)
    monkeypatch.setattr(kmeans, "BROADCAST_BYTES", 2 * 8 * x.shape[1])
    sliced = kmeans.lloyd(e, x[:6], max_iter=3)
    assert np.allclose(whole.centers, sliced.centers)
    assert np.array_equal(labels_of(whole.labels, len(x)), labels_of(sliced.labels, len(x)))


def test_kmeans_restarts(data):
    x, _, e = data
    one, many = kmeans.kmeans(e, 4, n_init=1), kmeans.kmeans(e, 4, n_init=4)
    assert many.cost <= one.cost + 1e-9
    assert np.isclose(many.cost, wcss_value(x, labels_of(many.labels, len(x))), rtol=1e-3)
    with pytest.raises(ValueError, match="between 1"):
        kmeans.kmeans(e, 81)


@pytest.mark.parametrize("partitions", [1, 16])
def test_minibatch_does_not_depend_on_partitions(data, partitions):
    x, labels, e = data
    fit = minibatch.minibatch_kmeans(
        e.repartition(partitions), 4, batch_size=20, steps=12, init_centers=x[:4]
    )
    same = minibatch.minibatch_kmeans(e, 4, batch_size=20, steps=12, init_centers=x[:4])
    assert np.allclose(fit.centers, same.centers)
    assert partition(labels_of(fit.labels, len(x))) == partition(labels_of(same.labels, len(x)))


def test_minibatch_seeds_itself(data):
    x, _, e = data
    y = labels_of(minibatch.minibatch_kmeans(e, 4, batch_size=40, steps=6).labels, len(x))
    assert len(set(y)) == 4 and wcss_value(x, y) < 0.8 * ((x - x.mean(0)) ** 2).sum()


def test_minibatch_always_has_k_centres(spark, data):
    assert len(minibatch.minibatch_kmeans(data[2], 70, batch_size=70, steps=1, seed=0, n_init=1).centers) == 70
    copies = points_df(spark, np.repeat(data[0][:3], 4, axis=0))
    assert len(minibatch.minibatch_kmeans(copies, 5, batch_size=5, steps=1, n_init=1).centers) == 5


def test_words_stay_with_their_labels(data):
    named = data[2].withColumn("word", F.concat(F.lit("w"), "word_id"))
    rows = sweep(named, [3], ["Voronoi_Partition"], n_init=1).collect()
    assert len(rows) == len(data[0]) and all(r["word"] == f"w{r['word_id']}" for r in rows)


def test_gmm_likelihood_never_falls(data):
    _, _, e = data
    init = kmeans.kmeans(e, 4, n_init=1).labels
    values = [gmm.gmm_diag(e, 4, max_iter=i, tol=-1.0, init_labels=init).cost for i in (1, 2, 4, 8)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_gmm_labels_are_the_most_likely(data):
    x, _, e = data
    y = labels_of(gmm.gmm_diag(e, 4).labels, len(x))
    assert set(y) <= set(range(4)) and len(y) == len(x)


@pytest.mark.parametrize("finish_at,block_rows", [(256, None), (6, 11), (1, None)])
def test_dendrogram_equals_naive_average_linkage(data, finish_at, block_rows):
    x = data[0][:40]
    got = agg.dendrogram(data[2].where("word_id < 40"), finish_at, block_rows).collect()
    expected = average_linkage(x)
    mine = sorted((r["left"], r["right"], round(r["height"], 8)) for r in got)
    assert mine == sorted((a, b, round(h, 8)) for a, b, h in expected)


def test_cuts_are_nested_and_match(data):
    x, _, e = data
    merges = average_linkage(x)
    got = agg.agglomerative(e, [1, 3, 10, 80], finish_at=40)
    parts = {}
    for k in (1, 3, 10, 80):
        y = labels_of(got.where(F.col("k") == k), len(x))
        assert sorted(set(y)) == list(range(k))
        parts[k] = partition(y)
        assert parts[k] == cut_labels(merges, len(x), k)
    for coarse, fine in ((1, 3), (3, 10), (10, 80)):
        assert all(any(f <= c for c in parts[coarse]) for f in parts[fine])


def test_agglomeration_of_copies_and_zero_vector(spark):
    x, _ = blobs(n=30)
    x[:10] = x[0]
    heights = [r["height"] for r in agg.dendrogram(points_df(spark, x), finish_at=16).collect()]
    assert len(heights) == 29 and sum(abs(h) < 1e-9 for h in heights) == 9
    x[3] = 0
    with pytest.raises(ValueError, match="zero vector"):
        agg.dendrogram(points_df(spark, x))


def test_spectral_eigenvalues(data):
    x, _, e = data
    affinity = knn.normalized_affinity(knn.knn_graph(e, 9))
    rows, values = spectral.spectral_embedding(affinity, 5, rounds=12, tol=1e-9)
    s = np.zeros((len(x), len(x)))
    for r in affinity.collect():
        s[r["src"], r["dst"]] = r["norm_w"]
    assert np.allclose(values, np.linalg.eigvalsh(np.eye(len(x)) - s)[:5], atol=1e-5)
    assert rows.count() == len(x)


def test_spectral_tells_whether_its_rounds_met_the_tolerance(data):
    e = data[2]
    assert spectral.spectral(e, 5, n_init=1, rounds=1).converged is False
    done = spectral.spectral(e, 5, n_init=1, rounds=30)
    assert done.converged and 2 < done.iterations


def test_power_iteration_labels_every_point_and_splits_two_groups(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 4)), rng.normal(size=(40, 4)) + 30])
    rows = spectral.power_iteration(points_df(spark, x), 2, max_iter=60).collect()
    label = {r["word_id"]: r["cluster"] for r in rows}
    assert len(rows) == 80 and set(label) == set(range(80))
    assert len({label[i] for i in range(40)}) == len({label[i] for i in range(40, 80)}) == 1
    assert label[0] != label[79]


def test_registered_suite_runs_all_algorithms_with_defaults(monkeypatch):
    from catalog import queries
    from lexigrove.plans import suite

    calls = []
    monkeypatch.setattr(queries.fx, "points", lambda *a: None)
    monkeypatch.setattr(queries.spc, "spectral", lambda points, k, **kw: calls.append(kw) or kmeans.Clustering(None))
    monkeypatch.setattr(suite, "sweep", lambda points, ks, *a, **kw: calls.append((a, kw)))
    monkeypatch.setattr(suite, "metric_table", lambda *a, **kw: None)
    for name in ("sweep", "run_suite", "spectral"):
        queries.QUERIES[name](None, "")
    assert calls == [((), {}), ((), {}), {"seed": 42}]


def test_suite_and_sweep(data):
    x, _, e = data
    got = run_suite(e, 4, n_init=2, options={"Spectral": {"rounds": 2}, "MiniBatchKMeans": {"steps": 3, "batch_size": 40}})
    counts = {r["algorithm"]: (r["n"], r["c"]) for r in got.groupBy("algorithm").agg(
        F.count("*").alias("n"), F.count_distinct("cluster").alias("c")).collect()}
    assert set(counts) == {"MiniBatchKMeans", "Agglomerative_Cosine", "Spectral", "Voronoi_Partition", "Gaussian_Mixture"}
    assert all(n == len(x) and 1 < c <= 4 for n, c in counts.values())
    ends = {r["algorithm"]: (r["iterations"], r["converged"]) for r in got.select("algorithm", "iterations", "converged").distinct().collect()}
    assert len(ends) == 5 and ends["MiniBatchKMeans"] == (3, False) and ends["Agglomerative_Cosine"] == (None, None)
    two = sweep(e, [2, 5], ["Agglomerative_Cosine"])
    assert two.groupBy("k").count().count() == 2
    with pytest.raises(ValueError, match="unknown"):
        sweep(e, [2], ["Nothing"])


def test_fits_of_a_sweep_run_side_by_side(data, monkeypatch):
    from threading import Barrier
    from lexigrove.plans import suite

    e = data[2]
    met = Barrier(4)

    def fake(points, k, *a, **kw):
        met.wait(timeout=20)  # broken unless both k of both algorithms are under way
        labels = points.select("word_id", F.lit(k).alias("cluster"))
        return kmeans.Clustering(labels, cost=float(k), iterations=k, converged=True)

    monkeypatch.setattr(suite, "kmeans", fake)
    monkeypatch.setattr(suite, "gmm_diag", fake)
    rows = sweep(e, [5, 2], ["Gaussian_Mixture", "Voronoi_Partition"]).collect()
    got = {(r["algorithm"], r["k"], r["cluster"], r["iterations"], r["inertia"]) for r in rows}
    assert got == {(a, k, k, k, c) for k in (2, 5) for a, c in (("Gaussian_Mixture", None), ("Voronoi_Partition", float(k)))}


def test_restarts_move_in_one_pass(spark, monkeypatch):
    """All restarts share the passes over the points, and end where each of them would alone."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "word_id long, features array<double>")
    alone = [kmeans.kmeans(e, 6, seed=42 + r, n_init=1) for r in range(5)]
    sc = spark.sparkContext
    jobs = []
    for steps in (1, 300):
        sc.setJobGroup(f"restarts-{steps}", "restarts")
        many = kmeans.kmeans(e, 6, seed=42, n_init=5, max_iter=steps)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"restarts-{steps}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    best = min(alone, key=lambda f: f.cost)
    assert many.cost == pytest.approx(best.cost) and many.iterations == best.iterations
    assert np.allclose(many.centers, best.centers)
    # a pass for each restart would be a job each
    passes = [f.iterations - 1 for f in alone]
    assert jobs[1] - jobs[0] <= max(passes) < sum(passes)
    # centres too large for one broadcast, and restarts that do not fit one pass, give the same
    monkeypatch.setattr(kmeans, "WAVE_BYTES", 2 * best.centers.nbytes)
    monkeypatch.setattr(kmeans, "PARTIAL_BYTES", 1)
    waves = kmeans.kmeans(e, 6, seed=42, n_init=5)
    monkeypatch.setattr(kmeans, "BROADCAST_BYTES", best.centers.nbytes - 1)
    slices = kmeans.kmeans(e, 6, seed=best_seed(alone), n_init=1, max_iter=2)
    assert waves.cost == pytest.approx(best.cost) and np.allclose(waves.centers, best.centers)
    monkeypatch.undo()
    again = kmeans.kmeans(e, 6, seed=best_seed(alone), n_init=1, max_iter=2)
    assert slices.cost == pytest.approx(again.cost) and np.allclose(slices.centers, again.centers)


def best_seed(fits):
    return 42 + min(range(len(fits)), key=lambda r: fits[r].cost)


def test_restarts_equal_those_of_the_jvm(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(5).normal(size=(300, 4))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "word_id long, features array<double>")
    rows = e.select(array_to_vector("features").alias("vec"))
    for steps in (1, 3, 100):
        model = KMeans(featuresCol="vec", k=5, seed=7, maxIter=steps, tol=1e-4).fit(rows)
        fit = kmeans.kmeans(e, 5, seed=7, n_init=1, max_iter=steps)
        assert fit.cost == pytest.approx(model.summary.trainingCost) and fit.iterations == model.summary.numIter
        assert np.allclose(fit.centers, model.clusterCenters())


def _same_tree(rows, expected):
    mine, expected = sorted((r["left"], r["right"], r["height"]) for r in rows), sorted(expected)
    return [m[:2] for m in mine] == [e[:2] for e in expected] and np.allclose([m[2] for m in mine], [e[2] for e in expected], atol=1e-9)


def test_dendrogram_in_phases_equals_naive_average_linkage(spark, monkeypatch):
    """Components that fit a task, parts of larger ones, and pairs of the largest merge in phases."""
    x, _ = blobs(n=90, d=6, k=5)
    near = np.random.default_rng(1).normal(size=(20, 6)) * 1e-3
    x = np.concatenate([x, x[:1] + near])  # a dense group
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = average_linkage(x)
    monkeypatch.setattr(agg, "HELD_PAIRS", 50)
    monkeypatch.setattr(agg, "CHUNK_PAIRS", 100)
    for task_clusters, bin_clusters, finish_at in ((2, 4, 85), (12, 16, 20)):
        monkeypatch.setattr(agg, "TASK_CLUSTERS", task_clusters)
        monkeypatch.setattr(agg, "BIN_CLUSTERS", bin_clusters)
        assert _same_tree(agg.dendrogram(points_df(spark, x), finish_at, block_rows=23).collect(), expected)


def test_chains_and_copies_take_no_phase_for_each_merge(spark, monkeypatch):
    """A round for each merge of a chain, or of a group of copies, was a job each."""
    written = []
    monkeypatch.setattr(agg, "materialize", lambda df, name, *a: written.append(name) or materialize(df, name, *a))
    angle = np.concatenate([np.cumsum(np.geomspace(1e-4, 0.05, 40)), np.full(40, 2.5), 2.5 + np.arange(1, 21) / 50])
    x = np.column_stack([np.cos(angle), np.sin(angle)])
    rows = agg.dendrogram(points_df(spark, x), finish_at=8, block_rows=40).collect()
    assert len(rows) == 99 and len(written) < 30
    assert sum(r["height"] == 0 and r["left"] == 40 for r in rows) == 39
    assert _same_tree(rows, average_linkage(x))


def test_spectral_graph_in_a_task_equals_the_joins(spark, data, monkeypatch):
    """Blocks of the graph are multiplied in a task; a graph that does not fit one is joined term by term."""
    affinity = knn.normalized_affinity(knn.knn_graph(data[2], 9)).persist()
    fits, written = {}, []
    monkeypatch.setattr(spectral, "GRAPH_ROWS", 17)
    monkeypatch.setattr(spectral, "materialize", lambda df, name, *a: written.append(name) or materialize(df, name, *a))
    for size in (spectral.EDGE_BYTES, 0):
        monkeypatch.setattr(spectral, "EDGE_BYTES", size)
        written.clear()
        fit = spectral.fit_embedding(affinity, 4, rounds=3)
        rows = {r["id"]: r["features"] for r in fit.rows.collect()}
        fits[size] = fit, np.abs([rows[i] for i in range(80)]), len(written)
    (packed, x, few), (joined, y, many) = fits.values()
    assert packed.rounds == joined.rounds and np.allclose(packed.values, joined.values, atol=1e-9)
    assert np.allclose(x, y, atol=1e-6)
    assert few < many  # a write for each polynomial, not for each of its terms


def test_rows_that_share_an_id_are_cut_once_each(spark):
    """Each pointer step multiplied them."""
    x, _ = blobs(n=30)
    e = points_df(spark, x)
    twice = e.unionByName(e.where("word_id < 4"))
    rows = agg.dendrogram(twice).collect()
    assert len(rows) == 33 and sum(r["left"] == r["right"] for r in rows) == 4
    got = agg.agglomerative(twice, [1, 3]).collect()
    alone = {(r["k"], r["word_id"]): r["cluster"] for r in agg.agglomerative(e, [1, 3]).collect()}
    assert len(got) == 2 * 34 and {(r["k"], r["word_id"]) for r in got} == set(alone)
