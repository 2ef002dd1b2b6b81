"""A training corpus from ``documents``: five stages, each on what the one before kept.

Toxic documents go, one document of each group of near copies stays, repeated passages go, sources
are mixed to their weights, and what is left is encoded. All stages but the last return the
columns of documents. Each is written as Parquet in the shared folder and read again.

Columns besides those of documents are kept by all stages but the last, whatever their names. Null
texts count as empty and stay. An empty table gives an empty one. Rows that share an id are single
documents to the stages that score, mix and encode; how the others see them is said in their modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.runtime import materialize
from llm import bpe, mixing, ngram_join, substring, toxicity
from llm.queries import remainder, tokenizer_path


def _free(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it while a column has it."""
    while name in columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; trained without the labels of held-out documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels, remainder("doc_id", 5) == 0)
    name = _free("toxicity_score", docs.columns)
    return toxicity.score(docs, machine, out_col=name).filter(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: five words, similarity 0.8 or more."""
    return ngram_join.keep_first(docs, n=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text becomes its kept words, joined by one space; texts left without a word go.

    Texts that had no word before stay as they are, null ones as empty texts.
    """
    inner = {c: _free(f"_{c}", docs.columns) if c in ("n_words", "n_removed", "kept") else c for c in docs.columns}
    found = substring.remove_repeats(docs.withColumnsRenamed(inner), window=20)
    found = found.filter("n_words = 0 or n_words > n_removed")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[new.get(c, F.col(n)).alias(c) for c, n in inner.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to."""
    return bpe.encode(docs, tokenizer_path(), decoded_col="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode),
]

# a fitted model and a vocabulary's merges are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
