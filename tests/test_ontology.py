import itertools

import numpy as np
import pytest

from lexigrove.operators import ontology as ont
from lexigrove.operators import word_pairs
from lexigrove.plans import coherence_chart_data

SYNSETS = [("a", "a1"), ("a", "a2"), ("b", "b1"), ("c", "c1"), ("d", "d1"), ("e", "e1"), ("f", "a1"), ("f", "a2")]
HYPERNYMS = [
    ("a1", "x"), ("a1", "y"), ("b1", "x"), ("b1", "z"), ("a2", "w"), ("c1", "z"),
    ("x", "root"), ("y", "root"), ("z", "top"), ("d1", "root"),
]


@pytest.fixture(scope="module")
def onto(spark):
    return (
        spark.createDataFrame(SYNSETS, "word string, synset_id string"),
        spark.createDataFrame(HYPERNYMS, "synset_id string, hypernym_id string"),
    )


def lineage(s):
    found, frontier, depth = {s: 0}, {s}, 0
    while frontier:
        depth += 1
        frontier = {h for c, h in HYPERNYMS if c in frontier} - set(found)
        found.update(dict.fromkeys(frontier, depth))
    return found


def sense_similarity(s, t, use_path):
    if use_path:
        a, b = lineage(s), lineage(t)
        lengths = [a[n] + b[n] for n in a.keys() & b.keys()]
        if lengths:
            return 1 / (1 + min(lengths))
    h, g = ({y for x, y in HYPERNYMS if x == n} for n in (s, t))
    return len(h & g) / len(h | g) if h and g else 0.0


def similarity(v, w, use_path):
    senses = [[s for x, s in SYNSETS if x == n] for n in (v, w)]
    best = max((sense_similarity(s, t, use_path) for s in senses[0] for t in senses[1]), default=0.0)
    return best if best > 0 else None


@pytest.mark.parametrize("use_path", [True, False])
def test_pairs_match_brute_force(spark, onto, use_path):
    words = list("abcdef") + ["none"]
    pairs = [(w, v) for v, w in itertools.combinations(words, 2)] + [("a", "b")]
    df = spark.createDataFrame(pairs, "w1 string, w2 string")
    got = {(r["w1"], r["w2"]): r["sim"] for r in ont.pair_similarity(df, *onto, use_path=use_path).collect()}
    assert len(got) == 21
    for v, w in itertools.combinations(words, 2):
        expected = similarity(v, w, use_path)
        assert got[v, w] == expected or np.isclose(got[v, w], expected)


def test_jaccard_one_third_and_empty(spark, onto):
    df = spark.createDataFrame([("a1", "b1"), ("a1", "e1")], "s1 string, s2 string")
    got = {(r["s1"], r["s2"]): r["jaccard"] for r in ont.hypernym_jaccard(df, onto[1]).collect()}
    assert np.isclose(got["a1", "b1"], 1 / 3) and got["a1", "e1"] == 0.0


def test_paths_over_cycles(spark):
    pairs = spark.createDataFrame([("p", "q")], "s1 string, s2 string")
    chain = spark.createDataFrame(
        [("p", "m"), ("m", "n"), ("n", "p"), ("n", "o"), ("q", "o")], "synset_id string, hypernym_id string"
    )
    assert np.isclose(ont.path_similarity(pairs, chain).first()["path_sim"], 1 / 5)


def test_paths_of_any_depth(spark):
    """Two chains that meet 26 edges up."""
    pairs = spark.createDataFrame([("p0", "q0"), ("p0", "x")], "s1 string, s2 string")
    edges = [(f"{c}{i}", f"{c}{i + 1}" if i < 25 else "top") for c in "pq" for i in range(26)]
    up = spark.createDataFrame(edges, "synset_id string, hypernym_id string")
    got = {r["s2"]: r["path_sim"] for r in ont.path_similarity(pairs, up).collect()}
    assert np.isclose(got["q0"], 1 / 53) and got["x"] is None


CLUSTERS = {0: ["a", "b", "c", "none"], 1: ["a", "f", "f"], 2: ["d"], 3: ["e", "none"], 4: [None], 5: list("abcdef")}


@pytest.mark.parametrize("block_rows", [1, 2, 1024])
@pytest.mark.parametrize("use_path", [True, False])
@pytest.mark.parametrize("count_zero", [True, False])
def test_cluster_means_match_brute_force(spark, onto, block_rows, use_path, count_zero):
    rows = [("x", c, w) for c, words in CLUSTERS.items() for w in words] + [("x", None, "a")]
    df = spark.createDataFrame(rows, "algorithm string, cluster int, word string")
    got = ont.cluster_coherence(
        df, *onto, use_path=use_path, count_zero=count_zero, block_rows=block_rows
    ).collect()
    assert {r["cluster"] for r in got} == set(CLUSTERS)
    known = {w for w, _ in SYNSETS}
    for r in got:
        words = [w for w in CLUSTERS[r["cluster"]] if w]
        sims = []
        for v, w in itertools.combinations(words, 2):
            s = similarity(v, w, use_path)
            if s is not None:
                sims.append(s)
            elif count_zero and {v, w} <= known:
                sims.append(0.0)
        assert r["n_words"] == len(words) and r["n_pairs"] == len(sims)
        assert r["coherence"] is None if not sims else np.isclose(r["coherence"], np.mean(sims))


def test_summary_keeps_algorithms_without_a_value(spark, onto):
    rows = [("x", c, w) for c, words in CLUSTERS.items() for w in words]
    rows += [("lonely", i, w) for i, w in enumerate("abc")]
    df = spark.createDataFrame(rows, "algorithm string, cluster int, word string")
    summary = ont.coherence_summary(df, *onto)
    got = {r["Algorithm"]: r for r in summary.collect()}
    assert tuple(got["lonely"])[1:5] == (None, None, 0, 3)
    values = []
    for words in CLUSTERS.values():
        sims = [similarity(v, w, True) for v, w in itertools.combinations([w for w in words if w], 2)]
        sims = [s for s in sims if s is not None]
        if sims:
            values.append(np.mean(sims))
    x = got["x"]
    assert x["Mean_WordNet_Coherence"] == round(float(np.mean(values)), 4)
    assert x["Std_WordNet_Coherence"] == round(float(np.std(values)), 4)
    assert (x["Clusters_Evaluated"], x["Clusters_Skipped"]) == (len(values), len(CLUSTERS) - len(values))
    assert [r["Algorithm"] for r in coherence_chart_data(summary).collect()] == ["x"]


def test_empty_ontology(spark, onto):
    df = spark.createDataFrame([("x", 0, "a"), ("x", 0, "b")], "algorithm string, cluster int, word string")
    empty = onto[0].limit(0)
    with pytest.raises(ValueError, match="no synsets"):
        ont.coherence_summary(df, empty, onto[1])
    r = ont.coherence_summary(df, empty, onto[1], allow_empty=True).first()
    assert (r["Mean_WordNet_Coherence"], r["Clusters_Skipped"], r["Words_With_Synsets"]) == (None, 1, 0)


def test_hot_cluster(spark):
    """One cluster holds most words, many of them with the same senses."""
    senses = [(f"w{i}", f"s{i % 5}") for i in range(60)]
    up = [(f"s{i}", f"h{i % 2}") for i in range(5)]
    df = spark.createDataFrame([("x", 0, w) for w, _ in senses], "algorithm string, cluster int, word string")
    got = ont.cluster_coherence(
        df,
        spark.createDataFrame(senses, "word string, synset_id string"),
        spark.createDataFrame(up, "synset_id string, hypernym_id string"),
        block_rows=2,
    ).first()
    sims = []
    for i, j in itertools.combinations(range(60), 2):
        a, b = i % 5, j % 5
        if a == b:
            sims.append(1.0)
        elif a % 2 == b % 2:
            sims.append(1 / 3)
    assert got["n_pairs"] == len(sims) and np.isclose(got["coherence"], np.mean(sims))


SHARED = [("a", "s1"), ("b", "s1"), ("b", "s2"), ("c", "s2"), ("c", "s3"), ("d", None), (None, "s3"), ("e", "s4")]
OVER = [("s1", "x"), ("s1", "x"), ("s2", "x"), ("s2", None), ("s3", "y"), ("x", "top"), ("y", "top"), ("top", "x"), (None, "y")]


@pytest.mark.parametrize("measure", ["hypernym_jaccard", "path_similarity"])
def test_unlisted_sense_pairs_equal_listed_ones(spark, measure, monkeypatch):
    """Synsets of several words, nulls, a cycle, repeated rows; with strips of a few pairs."""
    monkeypatch.setattr(word_pairs, "STRIP_PAIRS", 3)
    synsets = spark.createDataFrame(SHARED, "word string, synset_id string")
    hypernyms = spark.createDataFrame(OVER, "synset_id string, hypernym_id string")
    words = [*"abcdef", None]
    pairs = spark.createDataFrame([(v, w) for v in words for w in words] * 2, "w1 string, w2 string")
    score = getattr(ont, measure)
    listed = score(ont.synset_pairs(pairs.distinct(), synsets), hypernyms).collect()
    got = score(ont.synset_pairs(pairs, synsets, listed=False), hypernyms).collect()
    key = lambda r: tuple((x is None, x or "") for x in r[:2])
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, listed), key=key)
    assert len(got) > 10


def test_canonical_pairs_once_with_nulls(spark):
    rows = [("b", "a"), ("a", "b"), ("a", "a"), (None, "c"), (None, None), ("é", "z"), ("z", "é"), ("", "a")]
    df = spark.createDataFrame(rows * 3, "w1 string, w2 string").repartition(3)
    got = [tuple(r) for r in ont.canonical_pairs(df).collect()]
    assert len(got) == 6
    assert set(got) == {("a", "b"), ("a", "a"), ("c", "c"), (None, None), ("z", "é"), ("", "a")}


def test_sense_pairs_are_not_shuffled(spark):
    """A word with many senses: its pairs of senses would be 40,000 rows of the shuffle."""
    synsets = spark.createDataFrame([(w, f"{w}{i}") for w in "ab" for i in range(200)], "word string, synset_id string")
    hypernyms = spark.createDataFrame([(f"{w}{i}", f"h{i % 7}") for w in "ab" for i in range(200)], "synset_id string, hypernym_id string")
    words = spark.createDataFrame([("a", "b")], "w1 string, w2 string")
    got = ont.hypernym_jaccard(ont.synset_pairs(words, synsets, listed=False), hypernyms)
    plan = got._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in top and "Join" not in top
    assert got.count() == 40_000 and got.where("jaccard = 1").count() == sum((200 // 7 + (i < 200 % 7)) ** 2 for i in range(7))


def test_only_hypernyms_are_followed_up(spark, monkeypatch):
    """Coherence looks for what lies above 2 hypernyms, not above 30 synsets."""
    senses = [(f"w{i}", f"s{i}") for i in range(30)]
    edges = [(f"s{i}", f"h{i % 2}") for i in range(30)] + [("h0", "top"), ("h1", "top"), ("top", "h0")]
    asked = []
    found = ont.ancestors
    monkeypatch.setattr(ont, "ancestors", lambda s, h, **o: asked.append((s.count(), h.count())) or found(s, h, **o))
    df = spark.createDataFrame([("x", 0, w) for w, _ in senses], "algorithm string, cluster int, word string")
    got = ont.cluster_coherence(
        df,
        spark.createDataFrame(senses, "word string, synset_id string"),
        spark.createDataFrame(edges, "synset_id string, hypernym_id string"),
    ).first()
    # s - h - s, or s - h0 - top - h1 - s; over the cycle top is as near to h0 as h0 to top
    same, other = 2 * 15 * 14 / 2, 15 * 15
    assert asked == [(2, 3)]
    assert np.isclose(got["coherence"], (same / 3 + other / 5) / (same + other))


def test_best_sense_of_each_word():
    rng = np.random.default_rng(3)
    sim, starts = rng.random((12, 5)), np.array([0, 1, 5, 6, 8])
    assert (ont._best_sense(sim, starts) == np.maximum.reduceat(sim, starts, axis=0)).all()
