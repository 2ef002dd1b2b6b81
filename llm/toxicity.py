"""Toxicity scores from a factorisation machine over hashed terms.

A text is the set of its terms: words without punctuation at their ends, lower-cased and
hashed. The score is sigmoid(b + sum of weights + sum over pairs of the inner products of
their factors), so that a pair of terms can count more, or less, than both alone.

The machine is fitted by proximal AdaGrad on a bounded sample of labelled documents, taken by
a hash of their id: at most about ``max_per_label`` of each label. Terms in fewer than ``min_df``
sampled documents have no weight; the L1 penalty takes the weight from terms that say little,
the group penalty their factors. Scoring covers every document and its whole text.

Null and empty texts, and all texts when no label is known, get the score of no terms; an empty
table gives no rows. Repeated rows are scored each. A column named like the score is refused.
Several labels of one document count as toxic if one is. Null labels are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import _slices
from .words import hash_words, one_array, rank_words, split_words

BUCKETS = 1 << 18
FACTORS = 8
SLICE_BYTES = 4 * 1024 * 1024  # of text whose terms are held at a time; a longer text is held alone
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"


def term_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct terms of each text one after another, and their number."""
    words, counts = split_words(texts)
    distinct, codes = rank_words(words)
    terms = pc.utf8_trim(pc.utf8_lower(distinct), characters=EDGES)
    bucket = (hash_words(terms) % np.uint64(BUCKETS)).astype(np.int64)
    blank = pc.equal(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)
    bucket[blank] = BUCKETS
    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    pairs = np.unique(row * (BUCKETS + 1) + bucket[codes])
    row, bucket = np.divmod(pairs, BUCKETS + 1)
    real = bucket < BUCKETS
    return bucket[real], np.bincount(row[real], minlength=len(counts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def margins(terms, counts, bias, weights, factors) -> np.ndarray:
    """b + linear part + pair part of each text."""
    v = factors[terms]
    s = _sums(v, counts)
    pairs = 0.5 * ((s**2).sum(axis=1) - _sums((v**2).sum(axis=1), counts))
    return bias + _sums(weights[terms], counts) + pairs


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit(
    terms: np.ndarray,
    counts: np.ndarray,
    labels: np.ndarray,
    min_df: int = 5,
    clear_z: float = 5.0,
    steps: int = 400,
    batch: int = 256,
    rate: float = 0.15,
    l1: float = 5e-4,
    group: float = 2e-3,
    seed: int = 0,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of the machine."""
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return (3.0 if share > 0.5 else -3.0), weights, factors
    df = np.bincount(terms, minlength=BUCKETS)
    known = df >= min_df
    ends = np.cumsum(counts)
    starts = ends - counts
    kept = np.flatnonzero(known)
    factors[kept] = rng.normal(0.0, 0.02, (len(kept), FACTORS))
    # start from the log odds of terms whose share differs clearly between the labels
    row = np.repeat(np.arange(len(counts)), counts)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    d1 = np.bincount(terms, labels[row], BUCKETS)
    p, p1, p0 = df / len(labels), d1 / n1, (df - d1) / n0
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12))
    odds = np.log((d1 + 0.5) / (n1 + 1)) - np.log((df - d1 + 0.5) / (n0 + 1))
    clear = known & (np.abs(z) >= clear_z)
    weights[clear] = np.clip(odds[clear], -4.0, 4.0)
    share = float(labels.mean())
    bias, g_bias = float(np.log(share / (1 - share))), 1e-8
    g_w, g_v = np.full(BUCKETS, 1e-8), np.full(BUCKETS, 1e-8)
    for _ in range(-(-steps * batch // len(labels))):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            lens = counts[rows]
            t = np.concatenate([terms[starts[r] : ends[r]] for r in rows.tolist()])
            doc = np.repeat(np.arange(len(rows)), lens)
            real = known[t]
            t, doc = t[real], doc[real]
            n = np.bincount(doc, minlength=len(rows))
            v = factors[t]
            s = _sums(v, n)
            pairs = 0.5 * ((s**2).sum(axis=1) - _sums((v**2).sum(axis=1), n))
            error = sigmoid(bias + _sums(weights[t], n) + pairs) - labels[rows]
            error /= len(rows)
            g_bias += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(g_bias)
            if not len(t):
                continue
            used, where = np.unique(t, return_inverse=True)
            grad_w = np.bincount(where, error[doc])
            by_v = error[doc][:, None] * (s[doc] - v)
            grad_v = np.stack([np.bincount(where, by_v[:, f]) for f in range(FACTORS)], axis=1)
            g_w[used] += grad_w**2
            step = rate / np.sqrt(g_w[used])
            moved = weights[used] - step * grad_w
            weights[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0.0)
            g_v[used] += (grad_v**2).mean(axis=1)
            step = 0.1 * rate / np.sqrt(g_v[used])[:, None]
            moved = factors[used] - step * grad_v
            size = np.sqrt((moved**2).sum(axis=1, keepdims=True))
            factors[used] = moved * np.maximum(1.0 - step * group / np.maximum(size, 1e-12), 0.0)
    return bias, weights, factors


def train(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column | None = None,
    max_per_label: int = 6_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit on a sample of the labelled documents outside ``held_out`` (over ``id_col``).

    The sample is bounded: a label with more documents than ``max_per_label`` is thinned by
    a hash of the id to about that number. It is fitted in one task; what returns to the
    driver is the machine, ``BUCKETS`` x (``FACTORS`` + 1) numbers without its zeros.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, max_per_label / n))).otherwise(share)
    lot = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(lot < share).select(F.col(id_col).alias("label_id"), "label")
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("body"))
    chosen = texts.join(F.broadcast(sample), "label_id")  # about 2 * max_per_label rows

    def terms(batches):
        for table in _slices(batches, "body", SLICE_BYTES):
            found, counts = term_sets(table["body"])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))
            yield from table.select(["label_id", "label"]).append_column("terms", lists).to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    bagged = chosen.mapInArrow(terms, f"label_id {kind}, label int, terms array<long>")
    # rows that share an id count once
    bagged = bagged.groupBy("label_id").agg(F.max("label").alias("label"), F.max("terms").alias("terms"))

    def machine(table: pa.Table) -> pa.Table:
        table = table.sort_by("label_id")
        lists = one_array(table["terms"])
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        values = lists.flatten().to_numpy()
        bias, weights, factors = fit(values, counts, table["label"].to_numpy().astype(float))
        used = np.flatnonzero((weights != 0) | (factors != 0).any(axis=1))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(factors[used].ravel()), FACTORS)
        return pa.table(
            {
                "term": pa.array(np.append(used, -1)),
                "weight": pa.array(np.append(weights[used], bias)),
                "factors": pa.concat_arrays(
                    [vectors.cast(pa.list_(pa.float64())), pa.array([[]], pa.list_(pa.float64()))]
                ),
            }
        )

    fitted = bagged.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(
        machine, "term long, weight double, factors array<double>"
    )
    bias, weights, factors = -3.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32)
    for row in fitted.collect():
        if row["term"] < 0:
            bias = row["weight"]
        else:
            weights[row["term"]] = row["weight"]
            factors[row["term"]] = row["factors"]
    return bias, weights, factors


def score(docs: DataFrame, machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add the score of every whole text."""
    if out_col in docs.columns:
        raise ValueError(f"column {out_col} is made here; rename it or choose another name")
    model = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS x (FACTORS + 1) floats
    schema = docs.select("*", F.lit(0.0).alias(out_col)).schema

    def task(batches):
        bias, weights, factors = model.value
        active = (weights != 0) | factors.any(axis=1)
        for table in _slices(batches, text_col, SLICE_BYTES):
            terms, counts = term_sets(table[text_col])
            known = active[terms]
            row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[known]
            counts = np.bincount(row, minlength=len(counts))
            scores = sigmoid(margins(terms[known], counts, bias, weights, factors))
            yield from table.append_column(out_col, pa.array(scores)).to_batches()

    return docs.mapInArrow(task, schema)
