"""Language ID, toxicity, quality, mixing, chat, neighbours and the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import ann, chat, langid, mixing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_id_of_held_out_and_odd_texts(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "tz", "ung"], "cc": ["eau", "oi", "que"]}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(words), lang, "x"))
    rows += [(900, None, "aa", "x"), (901, "12 !!", "bb", "x"), (902, "", None, "x"), (903, "日本", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred_ string").repartition(3)
    model = langid.train(docs, F.col("doc_id") % 3 == 1)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:300] if i % 3 == 1)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["lang_pred"] in parts and all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_language_id_equals_scores_counted_by_hand(spark):
    """All words and n-grams of the sample count, also the rare ones; predictions equal a plain version."""
    rng = random.Random(11)
    parts = {"aa": ["ka", "lo", "mi", "sch"], "bb": ["sch", "tz", "ung", "mi"], "cc": ["eau", "oi", "que", "ka"]}
    rows = []
    for i in range(90):
        lang = rng.choice(sorted(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 12))]
        rows.append((i, " ".join(words) + rng.choice(["", " 7", " Zx-y", "\n"]), lang))
    rows += [(200, " ".join(["kasch", "xxq"] * 50_000), None), (200, "mi", None), (201, None, "bb")]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    learned = [(t, x) for i, t, x in rows if i % 3 != 1 and x and t is not None]
    counts = defaultdict(Counter)  # (kind, lang) -> entries

    def cleaned(text):
        return ["".join(c for c in w if c.isalpha()).lower() for w in WORD.findall(text or "")]

    def gram_list(word, n):
        text = word if n == 1 else f"<{word}>"
        return [text[i : i + n] for i in range(len(text) - n + 1)]

    for text, lang in learned:
        for word in filter(None, cleaned(text)):
            counts[0, lang][word] += 1
            for n in range(1, 5):
                counts[n, lang].update(gram_list(word, n))
    langs = sorted({x for _, x in learned})

    def log_rate(kind, entry, lang):
        entries = {e for x in langs for e in counts[kind, x]}
        if entry not in entries:
            return None
        return math.log((counts[kind, lang][entry] + 0.5) / (sum(counts[kind, lang].values()) + 0.5 * (len(entries) + 1)))

    known = {}

    def score(word, lang):
        if (word, lang) not in known:
            found = [log_rate(0, word, lang)]
            for n in range(4, 0, -1):
                if not any(x is not None for x in found):
                    found = [log_rate(n, g, lang) for g in gram_list(word, n)]
            found = [x for x in found if x is not None]
            known[word, lang] = sum(found) / len(found) if found else 0.0
        return known[word, lang]

    want = set()
    for i, text, _ in rows:
        words = Counter(filter(None, cleaned(text)))
        share = Counter(x for _, x in learned)
        sums = [math.log(share[x] / len(learned)) + sum(n * score(w, x) for w, n in words.items()) for x in langs]
        best = max(sums)
        posterior = 1 / sum(math.exp(s - best) for s in sums)
        want.add((i, langs[sums.index(best)], round(posterior, 3)) if words else (i, "und", 0.0))
    model = langid.train(docs, F.col("doc_id") % 3 == 1)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in got} == want
    assert langid.predict(docs.limit(0), model).count() == 0
    clash = docs.select("doc_id", "text", F.lit(3).alias("Score"), F.lit("q").alias("lang_pred"))
    assert set(langid.predict(clash, model).columns) == {"doc_id", "text", "Score_", "lang_pred_", "lang_pred", "score"}


def test_unseen_word_backs_off_to_the_longest_known_gram():
    table = [{"known": 0}, {"k": 0}, {"<k": 0}, {}, {"kno>": 0}]
    scores = [np.array([[1.0, 0.0]])] + [np.array([[10.0 * n, 0.0]]) for n in range(1, 5)]
    model = langid.Model(["x", "y"], np.zeros(2), table, scores, np.zeros(2))
    assert model.word_scores(["known", "akno", "kx", "zk", "zz", ""])[:, 0].tolist() == [1, 40, 20, 10, 0, 0]


def test_pairs_count_beyond_single_terms():
    """Neither term says anything alone; both together do."""
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        bags.append([1] * 0 + ([1] if a else [2]) + ([3] if b else [4]) + rng.integers(50, 90, 3).tolist())
        labels.append(float(a == b))
    counts = np.array([len(set(x)) for x in bags])
    terms = np.concatenate([sorted(set(x)) for x in bags])
    fitted = toxicity.fit(terms, counts, np.array(labels), steps=1500)
    score = toxicity.sigmoid(toxicity.margins(terms, counts, *fitted))
    assert ((score >= 0.5) == np.array(labels)).mean() > 0.9


def test_toxicity_of_held_out_and_odd_texts(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.randint(10, 60))
        bad = i % 6 == 0
        if bad:
            words[:3] = ["Idiot!", "scum,", "TRASH"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), 0.1))
        labels.append((i, int(bad)))
    rows += [(900, None, 0.1), (901, "", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label double").repartition(3)
    marks = spark.createDataFrame([*labels, (900, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    machine = toxicity.train(docs, marks, F.col("doc_id") % 5 == 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels if i % 5 == 0)
    assert got[900] == got[901] < 0.5
    none = toxicity.train(docs, marks.limit(0))
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(docs, none).collect())


def counts_by_force(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_votes(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["aaa", "bbbb", "cc", "dddd", "eee"], k=rng.randint(0, 40)))) for i in range(8)]
    rows += [(100 + i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(120))) for i in range(60)]
    rows += [(200 + i, " ".join("".join(rng.choices("abcdefgh", k=5)) + "%%%" for _ in range(120))) for i in range(10)]
    rows += [(300, None), (301, ""), (302, " \t\n\x0b "), (303, "a a a a a\n\na a a a a\n x|y <z> "), (304, "q " * 4000)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, text in rows:
        want = counts_by_force(text)
        assert tuple(got[i][c] for c in quality.COUNTS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
        if i // 100 == 1:
            assert got[i]["kept"]
    assert quality.judge(docs.limit(0)).count() == 0
    assert {r["em_iterations"] for r in got.values()} != {500} and all(r["em_moved"] <= 1e-9 for r in got.values())


def test_quality_of_a_very_long_text_and_clashing_columns(spark):
    """Distinct words give no repeats, however many; columns named like counts keep their values."""
    many = " ".join(map(str, range(3_000_000)))
    rows = [(1, many, 7, True, 0.5), (2, many[:4000] + " 1 2 3", 8, False, None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, Kept boolean, _h double")
    got = quality.judge(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in got) == [
        (1, 3_000_000, 0), (2, 0, 0), (2, len(many[:4000].split()) + 3, 6),
    ]
    kept = {(r["n_words_"], r["Kept_"], r["_h_"]) for r in got}
    assert kept == {(7, True, 0.5), (8, False, None), (None, None, None)}


def em_by_force(patterns, names):
    """Posterior of good for each vote pattern, with plain probabilities instead of log odds."""
    good, says = 0.9, {x: (math.exp(0.5), 1 / 9) for x in names}  # ratios of good to bad
    for _ in range(500):
        share, seen = [1.0, 1.0], {x: np.ones((2, 2)) for x in names}
        for cast, n in patterns:
            odds = good / (1 - good) * math.prod(says[x][v < 0] for x, v in zip(names, cast) if v)
            p = odds / (1 + odds)
            share = [share[0] + n * p, share[1] + n * (1 - p)]
            for x, v in zip(names, cast):
                if v:
                    seen[x][int(v < 0)] += n * p, n * (1 - p)
        good = share[0] / sum(share)
        rates = {x: t / t.sum(axis=0) for x, t in seen.items()}
        says = {x: (r[0, 0] / r[0, 1], r[1, 0] / r[1, 1]) for x, r in rates.items()}
    out = {}
    for cast, _ in patterns:
        odds = good / (1 - good) * math.prod(says[x][v < 0] for x, v in zip(names, cast) if v)
        out[cast] = odds / (1 + odds)
    return out


def test_quality_posterior_equals_expectation_maximisation_by_hand(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            words = [w.upper() + "!?%"[i % 3] for w in words]
        rows.append((i, " ".join(words)))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = [f"rule_{x}" for x in quality.rules()]
    want = em_by_force(sorted(Counter(tuple(r[x] for x in names) for r in got).items()), names)
    assert all(abs(r["posterior"] - want[tuple(r[x] for x in names)]) < 1e-6 for r in got)


def test_expectation_maximisation_finds_the_hidden_share():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    right = [0.9, 0.8, 0.75]
    casts = [np.where(rng.random(20_000) < r, np.where(good, 1, -1), np.where(good, -1, 1)) for r in right]
    seen = Counter(zip(*(c.tolist() for c in casts)))
    state = quality.estimate(list(seen.items()), ["a", "b", "c"])
    assert abs(1 / (1 + np.exp(-state["prior"])) - 0.7) < 0.03 and state["moved"] <= 1e-9


def test_knapsack_hits_the_budget():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.unique(rng.integers(2, 400, rng.integers(1, 60)))
        counts = rng.integers(1, 50, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 50))
        taken = mixing.fit_counts(lengths, counts, budget, table=int(rng.choice([500, 1 << 16])))
        assert (taken >= 0).all() and (taken <= counts).all()
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            if total <= 4000:
                reach = {r + n * k for r in reach for k in range(c + 1)}
        if total <= 4000:
            assert budget - int((lengths * taken).sum()) <= lengths.max()
        assert int((lengths * taken).sum()) <= max(0, budget)


def test_knapsack_finds_the_best_reachable_sum(monkeypatch):
    def best(lengths, counts, budget):
        reach = 1
        for n, c in zip(lengths.tolist(), counts.tolist()):
            for _ in range(c):
                reach |= reach << n
        return (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1

    long = np.array([70_000, 80_000, 90_000])
    assert mixing.fit_counts(long, np.ones(3, np.int64), 150_000).tolist() == [1, 1, 0]
    rng = np.random.default_rng(5)
    for halves in (1 << 21, 0):  # by all sums of two halves, then by the long table
        monkeypatch.setattr(mixing, "HALF_SUMS", halves)
        for top, n in [(400, 12), (9_000, 8), (100_000, 3), (100_000, 6), (300_000, 9)] * 4:
            lengths = np.unique(rng.integers(2, top, rng.integers(1, n + 1)))
            lengths *= int(rng.choice([1, 6]))
            counts = rng.integers(1, 5, len(lengths))
            budget = int(rng.integers(0, (lengths * counts).sum() + 50))
            taken = mixing.fit_counts(lengths, counts, budget, table=int(rng.choice([500, 1 << 16])))
            assert (taken >= 0).all() and (taken <= counts).all()
            assert (lengths * taken).sum() == best(lengths, counts, budget)
    monkeypatch.setattr(mixing, "TABLE_BITS", 1 << 26)  # neither fits: many long documents
    lengths = np.unique(rng.integers(50_000, 900_000, 300))
    taken = mixing.fit_counts(lengths, np.ones(len(lengths), np.int64), int(lengths.sum()) // 3)
    assert (lengths * taken).sum() == lengths.sum() // 3


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(1, 90), rng.choice(["a", "b", "é", "z", None]), 0) for i in range(400)]
    rows += [(1000, None, "a", 0), (1001, "", None, 0), (1002, "w " * 3, "tiny", 0), (1003, " ", "void", 0), (5, rows[5][1], rows[5][2], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    runs = [sorted(map(tuple, mixing.mix(docs.repartition(n)).select("doc_id", "size", "source_size", "target", "taken").collect())) for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    sizes, source = Counter(), {i: s for i, _, s, _ in rows}
    for i, text, s, _ in rows:
        sizes[s] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not above:
            break
        for s in above:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= above
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for i, size, source_size, aim, words in runs[0]:
        assert source_size == sizes[source[i]] and aim == pytest.approx(target[source[i]])
        assert words in {size * k for k in range(4)}
        taken[source[i]] += words
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    out = mixing.take(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect() if r["doc_id"] != 5) == Counter(
        {r[0]: r[4] // r[1] for r in runs[0] if r[1] and r[4] and r[0] != 5}
    )
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take(docs.limit(0)).count() == 0


def test_preference_pairs(spark):
    def turns(*pairs):
        return [{"turn": i, "role": r, "text": t} for i, (r, t) in enumerate(pairs)]

    a = turns(("user", "hi"), ("assistant", "éé"), ("user", None), ("assistant", "good"))
    b = turns(("user", "hi"), ("assistant", "éé"), ("user", None), ("assistant", "bad"), ("user", "x"))
    rows = [(1, a, b), (2, a, a), (3, a, []), (4, None, b), (5, turns((None, "x")), turns((None, "y")))]
    kind = "array<struct<turn:int,role:string,text:string>>"
    pairs = spark.createDataFrame(rows, f"prompt_id long, chosen {kind}, rejected {kind}")
    got = {r["prompt_id"]: r for r in chat.preference_pairs(pairs).collect()}

    def show(turns):
        return "".join(f"<|im_start|>{t['role'] or ''}\n{t['text'] or ''}<|im_end|>\n" for t in turns)

    for i, x, y in rows:
        x, y = x or [], y or []
        n = next((k for k in range(min(len(x), len(y))) if (x[k]["role"], x[k]["text"]) != (y[k]["role"], y[k]["text"])), min(len(x), len(y)))
        assert (got[i]["n_prompt"], got[i]["prompt"]) == (n, show(x[:n]))
        for side, full in (("chosen", x), ("rejected", y)):
            assert got[i][side] == show(full[n:])
            marked = [got[i][side][s["start"] : s["stop"]] for s in got[i][f"{side}_spans"]]
            assert marked == [f"{t['text'] or ''}<|im_end|>\n" for t in full[n:] if t["role"] == "assistant"]
    assert chat.preference_pairs(pairs.limit(0)).count() == 0
    table = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None)], "conv_id long, turn int, role string, text string")
    assert {r["conv_id"]: len(r["turns"]) for r in chat.conversations(table).collect()} == {1: 2, 2: 1}


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(20, 16))
    x = centers[rng.integers(0, 20, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    x[100:400] = x[7]  # equal vectors
    rows = [(i, [float(v) for v in np.float32(r)], 0.0) for i, r in enumerate(x)]
    rows += [(2000, None, 0.0), (2020, [0.0] * 16, 0.0), (2040, [float("nan")] * 16, 0.0), (2060, [None] + [1.0] * 15, 0.0), (2080, [1.0, 2.0], 0.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double").repartition(3)
    got = defaultdict(list)
    for r in ann.search(table, F.col("id") % 20 == 0, k=20).collect():
        got[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    x = np.float32(x).astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        score = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -score)).tolist() if i != q][:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert all(abs(score[i] - s) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(order))
    assert set(got) == set(range(0, 1500, 20)) and hits / (75 * 20) >= 0.9
    few = ann.search(table.filter("vec_id < 5 or vec_id > 1999"), F.col("id") % 20 == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3, 4]
    assert ann.search(table.filter("vec_id >= 2000 and vec_id < 2080"), F.col("id") % 20 == 0).count() == 0


def test_neighbours_where_files_and_footrule_prune(spark):
    """20,000 vectors without clusters, of which a query reranks less than a tenth."""
    assert ann.reranked(20_000, 20) < 2_000 and ann.reranked(150_000, 20) < 5_000
    x = np.random.default_rng(12).normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(table, F.col("id") % 200 == 0).collect():
        got[r["query_id"]].add(r["id"])
    hits = 0
    for q in range(0, 20_000, 200):
        score = x @ x[q]
        score[q] = -9
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits / (100 * 20) >= 0.9


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(9)
    share = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(120):
        text = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 80)))
        rows.append((i, share + " " + text if i in (3, 50) else text, "en", f"s{i % 3}", len(text), 1))
    rows += [(200 + i, rows[10][1], "en", "s0", 0, 1) for i in range(5)] + [(300, None, None, None, None, None), (None, "left alone", "en", None, 0, 1)]
    rows.append(rows[20])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int")
    first = corpus_pipeline.drop_near_copies(spark, docs, "")
    ids = Counter(r["doc_id"] for r in first.collect())
    assert set(ids) == {*range(120), 300, None} and max(ids.values()) == 1
    second = corpus_pipeline.drop_repeated_passages(spark, first, "")
    texts = {r["doc_id"]: r["text"] for r in second.collect()}
    assert texts[3] == rows[3][1] and texts[50] == rows[50][1][len(share) + 1 :] and texts[300] == ""
    assert second.columns == first.columns == docs.columns
    third = corpus_pipeline.mix_sources(spark, second, "")
    assert third.columns == docs.columns and third.count() > 60
    last = corpus_pipeline.encode(spark, third, "")
    assert last.count() == third.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "substring_dedup", "source_mixing", "bpe_codec",
    ]


def test_toxicity_of_odd_tables(spark):
    schema = "doc_id long, text string"
    machine = (0.5, np.zeros(toxicity.BUCKETS, np.float32), np.zeros((toxicity.BUCKETS, toxicity.FACTORS), np.float32))
    terms, _ = toxicity.term_sets(pa.array(["bad group other"]))
    bad, group, _ = (int(toxicity.term_sets(pa.array([w]))[0][0]) for w in ("bad", "group", "other"))
    machine[1][bad], machine[2][bad, 0], machine[2][group, 0] = 1.0, 2.0, 1.5
    assert len(terms) == 3
    assert toxicity.score(spark.createDataFrame([], schema), machine).count() == 0
    rows = [(1, None), (2, ""), (3, "bad"), (4, "group"), (5, "Bad, group!"), (5, "Bad, group!"), (6, "other " * 900_000 + "bad")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, schema), machine).collect()}
    want = {1: 0.5, 2: 0.5, 3: 1.5, 4: 0.5, 5: 4.5, 6: 1.5}  # 5: the pair gives 2.0 * 1.5
    assert got == {i: pytest.approx(1 / (1 + np.exp(-m))) for i, m in want.items()}
    with pytest.raises(ValueError, match="score"):
        toxicity.score(spark.createDataFrame(rows, schema).selectExpr("*", "1 AS score"), machine)
