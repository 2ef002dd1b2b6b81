from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, difference, rows_of

DATA = Path("/root/testdata/sf0.001")


def test_every_sql_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    # without SQL: random seeds, cells around sampled pivots, or rotations of equal eigenvalues
    assert set(entry_points.QUERIES) - set(entry_points.oracle_sql()) == {
        "kmeans_best_of_n", "knn_approximate", "run_suite", "spectral", "spectral_power_iteration",
        "subword_kmeans_metrics", "sweep",
    }


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", ["lexicon_top_before", "wcss", "knn_graph", "best_by_metric"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = entry_points.queries()[name](spark, str(DATA))
    cur = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert difference(got, rows_of(columns, cur.fetchall())) is None
