import pytest

from lexigrove import plans

ROWS = [
    ("x", 50, 10.0, 0.1, 2.0, 5.0), ("x", 100, 8.0, 0.2, 2.5, 4.0), ("x", 150, 6.0, 0.2, 1.0, 3.0),
    ("y", 50, 10.0, 0.3, 1.0, 6.0), ("y", 100, 9.0, 0.1, 3.0, 7.0), ("y", 150, 5.0, 0.4, 2.0, 1.0),
]


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame(
        ROWS, "Algorithm string, k int, WCSS double, Silhouette double, Davies_Bouldin double, Calinski_Harabasz double"
    )


def test_long_form_and_direction(metrics):
    rows = plans.metrics_long(metrics).collect()
    assert len(rows) == 24
    assert {r["metric"] for r in rows if r["higher_is_better"]} == {"Silhouette", "Calinski_Harabasz"}


def test_curves_average_repeated_points(metrics):
    both = metrics.unionByName(metrics.selectExpr("Algorithm", "k", "WCSS + 2 AS WCSS", "Silhouette", "Davies_Bouldin", "Calinski_Harabasz"))
    got = {(r["Algorithm"], r["k"]): r["value"] for r in plans.metric_curves(both).where("metric = 'WCSS'").collect()}
    assert got["x", 50] == 11.0 and len(got) == 6


def test_best_by_metric(metrics):
    got = {(r["metric"], r["k"], r["Algorithm"]): r["place"] for r in plans.best_by_metric(metrics).collect()}
    assert got["WCSS", 50, "x"] == got["WCSS", 50, "y"] == 1
    assert got["Silhouette", 50, "y"] == 1 and got["Davies_Bouldin", 100, "x"] == 1
    assert got["Calinski_Harabasz", 150, "y"] == 2


def test_deltas(metrics):
    got = {(r["metric"], r["Algorithm"], r["k"]): r for r in plans.metric_deltas(metrics).collect()}
    assert got["WCSS", "x", 50]["delta"] is None and got["WCSS", "x", 100]["delta"] == -2.0
    assert got["WCSS", "x", 50]["falls"] and not got["WCSS", "x", 50]["rises"]
    assert got["Silhouette", "x", 150]["rises"]
    assert not got["Davies_Bouldin", "x", 50]["falls"]


def test_compare_models(metrics):
    got = plans.compare_models({"m": metrics, "n": metrics}, {"m": 10, "n": 20})
    r = {x["model"]: x["wcss_per_point"] for x in got.where("k = 50 and Algorithm = 'x'").collect()}
    assert r == {"m": 1.0, "n": 0.5}
