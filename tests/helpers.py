"""Small inputs and plain NumPy versions to compare with."""

import numpy as np
from pyspark.sql import functions as F


def blobs(n=60, d=5, k=4, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, d)) * 4
    labels = np.arange(n) % k
    x = centers[labels] + rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True), labels


def points_df(spark, x, partitions=3):
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "word_id long, features array<double>").repartition(
        partitions
    )


def labeling_df(spark, labels, name="a", k=None):
    k = int(max(labels) + 1 if k is None else k)
    rows = [(name, k, int(i), int(c)) for i, c in enumerate(labels)]
    return spark.createDataFrame(rows, "algorithm string, k int, word_id long, cluster int")


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def silhouette_values(x, labels):
    d, out = distances(x), []
    for i, own in enumerate(labels):
        mean = {c: d[i][labels == c].sum() / (labels == c).sum() for c in set(labels)}
        size = (labels == own).sum()
        if size == 1:
            out.append(0.0)
            continue
        a = d[i][labels == own].sum() / (size - 1)
        b = min(v for c, v in mean.items() if c != own)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


def wcss_value(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels))


def db_value(x, labels):
    ids = sorted(set(labels))
    c = np.array([x[labels == i].mean(0) for i in ids])
    s = np.array([np.linalg.norm(x[labels == i] - c[j], axis=1).mean() for j, i in enumerate(ids)])
    worst = []
    for i in range(len(ids)):
        gaps = [np.linalg.norm(c[i] - c[j]) for j in range(len(ids))]
        r = [(s[i] + s[j]) / gaps[j] for j in range(len(ids)) if j != i and gaps[j] > 0]
        worst.append(max(r, default=0.0))
    return float(np.mean(worst))


def ch_value(x, labels):
    ids, g = sorted(set(labels)), x.mean(0)
    between = sum((labels == i).sum() * ((x[labels == i].mean(0) - g) ** 2).sum() for i in ids)
    w = wcss_value(x, labels)
    return 1.0 if w == 0 else (between / (len(ids) - 1)) / (w / (len(x) - len(ids)))


def average_linkage(x):
    """Merges of naive average linkage on cosine distance: (left, right, height)."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    base = 1 - x @ x.T
    alive, out = {i: [i] for i in range(len(x))}, []
    while len(alive) > 1:
        ids = sorted(alive)
        h, a, b = min(
            (round(base[np.ix_(alive[a], alive[b])].mean(), 10), a, b)
            for n, a in enumerate(ids)
            for b in ids[n + 1 :]
        )
        out.append((a, b, h))
        alive[a] += alive.pop(b)
    return out


def cut_labels(merges, n, k):
    """Partition after the n - k lowest merges, as a frozenset of frozensets."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _ in sorted(merges, key=lambda m: (m[2], m[0], m[1]))[: n - k]:
        root[find(b)] = find(a)
    return partition([find(i) for i in range(n)])


def partition(labels):
    groups = {}
    for i, c in enumerate(labels):
        groups.setdefault(c, set()).add(i)
    return frozenset(frozenset(g) for g in groups.values())


def labels_of(df, n, id_col="word_id"):
    got = {r[id_col]: r["cluster"] for r in df.select(id_col, F.col("cluster")).collect()}
    return np.array([got[i] for i in range(n)])
