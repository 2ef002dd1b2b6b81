"""What one task holds on large blocks."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lexigrove.operators import agglomerative as agg, metrics as met
from lexigrove.operators.vector_sums import list_column, matrix


def block(first, n, d=8, clusters=4):
    ids = np.arange(first, first + n)
    x = np.random.default_rng(first).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cols = list_column((ids % clusters).reshape(-1, 1), pa.int64())
    return pa.table({"id": ids, "vec": list_column(x), "cols": cols}), x


def peak_mb(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_distance_sums_hold_no_whole_block_of_distances():
    (a, x), (b, y) = block(0, 5000), block(5000, 5000)  # 190 MiB of distances
    out, peak = peak_mb(lambda: met._distance_sums(0, 4)(a, b))
    assert peak < 150
    at = 4321
    d = np.sqrt(((x[at] - y) ** 2).sum(1))
    sums = dict(zip(out["id"].to_pylist(), matrix(out["s"])))
    assert np.allclose(sums[at], [d[c::4].sum() for c in range(4)])
    d = np.sqrt(((y[7] - x) ** 2).sum(1))
    assert np.allclose(sums[5007], [d[c::4].sum() for c in range(4)])


def test_lowest_heights_hold_no_whole_block_of_heights():
    (a, x), (b, y) = block(0, 5000), block(5000, 5000)
    out, peak = peak_mb(lambda: agg._lowest(a, b, True))
    assert peak < 150
    low = {i: (h, nn) for i, h, nn in zip(*(out[c].to_pylist() for c in ("id", "height", "nn")))}
    h = 1 - x @ y.T
    assert all(low[i][1] == 5000 + h[i].argmin() and np.isclose(low[i][0], h[i].min()) for i in (0, 17, 4999))
    assert all(low[5000 + j][1] == h[:, j].argmin() for j in (0, 17, 4999))
    own = agg._lowest(a, None, False)
    h = 1 - x @ x.T
    np.fill_diagonal(h, np.inf)
    assert own["nn"].to_pylist()[:50] == h[:50].argmin(1).tolist()
