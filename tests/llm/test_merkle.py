"""Merkle manifest against a tree built row by row."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """All levels, and the siblings of each leaf."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    paths = []
    for i in range(len(hashes)):
        others = [(i >> k) ^ 1 for k in range(len(levels) - 1)]
        paths.append([levels[k][o] if o < len(levels[k]) else None for k, o in enumerate(others)])
    return levels[-1][0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = tree([built[g][0] for g in names])
    out = []
    for g, above in zip(names, tops):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), built[g][1]):
            out.append((x[3][0], g, x[2], built[g][0], root, tuple(path + above)))
    return out


def shown(df):
    return sorted(
        ((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], tuple(r["siblings"])) for r in df.collect()), key=str
    )


def rows_of(n, seed):
    rng = random.Random(seed)
    ids = rng.sample([*range(-400, 3000), 2**62, -(2**63), 2**63 - 1, 2**40 + 5], n)
    return [
        (i, rng.choice(["a", None]), rng.choice(["en", "de", "é", "", None]), rng.choice([None, 7]), rng.choice(["x", "ünï", "", None]))
        for i in ids
    ]


@pytest.mark.parametrize("bits, n", [(10, 1), (10, 5), (2, 90), (3, 700)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, bits, n):
    monkeypatch.setattr(merkle, "SLOT_BITS", bits)
    rows = rows_of(n, n)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert shown(got) == sorted(expected(rows), key=str)


def test_shared_and_null_ids_and_copies(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_COPIES", 3)
    rows = [(5, "a", "en", 1, "same")] * 8 + [(5, "a", "en", 1, f"t{i}") for i in range(9)]
    rows += [(None, None, None, None, None)] * 4 + [(None, "b", "en", 2, "x"), (6, None, "en", 2, ""), (-1, "s", "en", 0, "y")]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert shown(got) == sorted(expected(rows), key=str)


def test_fold_leads_to_the_root_and_tells_changes(spark):
    rows = rows_of(77, 3)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_leaf", F.lit("mine")).withColumn("_g", F.lit(1))
    out = merkle.manifest(docs, keep=["_leaf", "_g"])
    folded = merkle.fold(F.col("leaf"), F.col("siblings"), F.col("place"))
    wrong = merkle.fold(F.sha2(F.lit("x"), 256), F.col("siblings"), F.col("place"))
    found = out.select((folded == F.col("root")).alias("good"), (wrong == F.col("root")).alias("bad"), "_leaf").collect()
    assert len(found) == 77 and all(r["good"] and not r["bad"] and r["_leaf"] == "mine" for r in found)


def test_empty_table_and_clashing_names(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame(rows_of(3, 1), SCHEMA).withColumn("root", F.lit(1))
    assert merkle.manifest(docs).count() == 3
    with pytest.raises(ValueError, match="root"):
        merkle.manifest(docs, keep=["root"])


def test_long_text(spark):
    rows = [(1, "s", "en", 9, "long é " * 300_000), (2, "s", "en", 1, "b")]
    assert shown(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == sorted(expected(rows), key=str)
