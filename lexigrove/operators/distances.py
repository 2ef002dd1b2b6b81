"""Dense distance blocks for use inside tasks."""

from __future__ import annotations

import numpy as np


def sq_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances between the rows of two matrices.

    Values that are rounding noise next to the norms are set to zero, so equal
    vectors are at distance 0.
    """
    xx = np.einsum("ij,ij->i", x, x)
    yy = np.einsum("ij,ij->i", y, y)
    scale = xx[:, None] + yy[None, :]
    d2 = scale - 2.0 * (x @ y.T)
    d2[d2 <= 1e-14 * scale] = 0.0
    return d2


def nearest_columns(d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the ``k`` smallest finite entries, ties by column id."""
    by_id = np.argsort(ids, kind="stable")
    d2, ids = d2[:, by_id], ids[by_id]
    if d2.shape[1] > 4 * k:
        # keep everything up to the k-th value, so ties at the border stay in
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(d2 <= kth)
    else:
        row, col = np.nonzero(np.isfinite(d2))
    value = d2[row, col]
    order = np.lexsort((col, value, row))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (place < k) & np.isfinite(value)
    return row[keep], ids[col[keep]], value[keep]
