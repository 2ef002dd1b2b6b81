"""The corpus pipeline from end to end."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """200 documents: toxic ones, near copies, a shared passage, empty and null texts."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    passage, base = text(60), text(120)
    rows, toxic = [], set()
    for i in range(200):
        t = text(rng.randint(30, 80))
        if i % 5 == 0:
            t, toxic = t + " vileword nastyword", toxic | {i}
        elif i % 20 == 1:
            t = base + f" end{i}"
        elif i % 20 == 2:
            t = text(30) + " " + passage + " " + text(10)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, toxic, passage


def test_decisions_take_effect_and_clean_documents_stay(spark, corpus):
    path, rows, toxic, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean = {r[0] for r in rows} - toxic
    assert set(kept[0]) == clean
    copies = {i for i in range(200) if i % 20 == 1}
    assert set(kept[1]) == clean - (copies - {1})
    assert set(kept[2]) == set(kept[1])
    holders = [i for i in sorted(kept[1]) if i % 20 == 2 and i < 200]
    assert passage in kept[2][holders[0]] and not any(passage in kept[2][i] for i in holders[1:])
    plain = [i for i in kept[1] if i % 20 not in (1, 2)]
    assert all(kept[2][i] == kept[0][i] for i in plain if kept[0][i])


def test_run(spark, corpus):
    path, rows, toxic, _ = corpus
    out = corpus_pipeline.run(spark, path).collect()
    found = {r["doc_id"] for r in out}
    assert not found & toxic and found <= {r[0] for r in rows}
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)


def test_clashing_columns_and_empty_table(spark, corpus):
    path = corpus[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("toxicity_score", F.lit(9.0))
    docs = docs.withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(3))
    assert "toxicity_score" in corpus_pipeline.drop_toxic(spark, docs.limit(20), path).columns
    out = corpus_pipeline.drop_repeated_passages(spark, docs, path)
    assert out.columns == docs.columns and {r["kept"] for r in out.select("kept").distinct().collect()} == {"mine"}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0


def test_answered_blocks_leave_the_disk(spark, tmp_path):
    """Of the chunk table of the n-gram join only the bodies stay, as later stages hold the disk too."""
    from pathlib import Path

    texts = [" ".join(f"w{(i * 7 + j) % 97}" for j in range(60)) for i in range(40)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("ngram-chunks-*"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    (made,) = set(folder.glob("ngram-chunks-*")) - before
    assert spark.read.parquet(str(made)).filter("is_body = 'false'").count() == 0
    assert spark.read.parquet(str(made)).filter("is_body = 'true'").count() > 0
    assert kept.groupBy("text").count().filter("count > 1").isEmpty() and kept.count() >= 1
