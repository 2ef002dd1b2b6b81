import numpy as np
import pytest
from helpers import distances, points_df

from lexigrove.operators import knn, pruned
from lexigrove.operators.distances import sq_distances


def clustered(n, groups=12, d=6, spread=0.02, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 3
    return centres[np.arange(n) % groups] + rng.normal(size=(n, d)) * spread


def plain(x, k):
    d = np.round(distances(x), 9)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(i, j + 1): int(order[i, j]) for i in range(len(x)) for j in range(min(k, len(x) - 1))}


def found(df):
    return {(r["src"], r["rank"]): r["dst"] for r in df.collect()}


@pytest.mark.parametrize("cells, block_rows, probe", [(1, 1000, 1), (7, 10, 1), (25, 6, 3), (200, 50, 2)])
def test_exact_for_any_cells(spark, cells, block_rows, probe):
    for x in (clustered(150), np.random.default_rng(1).normal(size=(120, 4)) * 50):
        out = pruned.cell_neighbours(points_df(spark, x), 5, cells=cells, block_rows=block_rows, probe=probe)
        assert found(out.rows) == plain(x, 5)


def test_clustered_points_skip_most_cells(spark):
    x = clustered(600, groups=20)
    out = pruned.cell_neighbours(points_df(spark, x), 5, cells=60, block_rows=50)
    assert found(out.rows) == plain(x, 5)
    assert out.distances < 0.35 * out.all_distances


def test_copies_cost_no_pairs(spark):
    x = clustered(90)
    x[::3] = x[0]
    out = pruned.cell_neighbours(points_df(spark, x), 4, cells=8, block_rows=9)
    assert found(out.rows) == plain(x, 4)
    assert out.all_distances == 61**2
    same = points_df(spark, np.ones((9, 2)))
    assert found(knn.knn_graph(same, 3)) == plain(np.ones((9, 2)), 3)


def test_approximate_and_its_recall(spark):
    x = clustered(900, groups=30, spread=0.3)
    points = points_df(spark, x)
    exact = pruned.cell_neighbours(points, 5, cells=40, block_rows=60)
    near = pruned.cell_neighbours(points, 5, exact=False, probe=6, cells=40, block_rows=60)
    assert near.distances < exact.all_distances / 3
    assert pruned.recall(exact.rows, points, 5, 0.3) == 1.0
    measured = pruned.recall(near.rows, points, 5, 1.0)
    want = plain(x, 5)
    hits = {(s, d) for (s, _), d in found(near.rows).items()} & {(s, d) for (s, _), d in want.items()}
    assert measured == pytest.approx(len(hits) / len(want)) and measured >= 0.9
    assert knn.knn_graph(points, 5, method="approximate").count() > 0
    with pytest.raises(ValueError, match="method"):
        knn.knn_graph(points, 5, method="other")


def test_few_and_no_points(spark):
    assert knn.knn_graph(points_df(spark, np.eye(1)), 3).count() == 0
    assert knn.knn_graph(points_df(spark, np.eye(3)).where("word_id < 0"), 3).count() == 0


def test_far_cells_share_blocks():
    n, cells = 614_400, 600
    slots, per_block, parts = pruned._blocks(np.full(cells, 1024), 1024, n, 64, 12)
    # rows sent: each point to every block at most, each member to every part; not to every cell
    assert -(-slots.sum() // per_block) <= 20 and parts <= 20
    assert per_block * 1024 * 64 * 8 <= pruned.FAR_BYTES


def test_unstructured_points_with_many_cells_to_a_block(spark):
    x = np.random.default_rng(5).normal(size=(400, 12))
    out = pruned.cell_neighbours(points_df(spark, x), 5, cells=60, block_rows=8)
    assert found(out.rows) == plain(x, 5)
    assert out.distances > 0.8 * out.all_distances


def test_screen_finds_the_pairs_within_the_limit_and_computes_no_others_in_doubles(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[100:110] = x[0] * (1 + 1e-9 * np.arange(10))[:, None]
    xs, y, limit = x[:150], x[100:], np.full(150, 9.0)
    limit[7] = np.inf
    dense = []
    monkeypatch.setattr(pruned, "sq_distances", lambda a, b: dense.append(len(a)) or sq_distances(a, b))
    screen = pruned._Screen(x)
    own = np.arange(5, 150)
    row, col, sq = screen.within(xs, own, y, screen.columns(y), limit)
    d2 = sq_distances(xs[own], y)
    expected = np.argwhere(d2 <= limit[own][:, None])
    assert np.array_equal(np.column_stack([row, col]), expected) and not dense
    assert np.allclose(sq, d2[row, col], atol=1e-12)
    row, _, _ = screen.within(xs, own, y, screen.columns(y), np.full(150, np.inf))
    assert len(row) == 145 * 200 and dense == [145]
