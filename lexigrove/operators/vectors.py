"""Attach vectors to words: whole-word, subword and contextual."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import char_ngrams, l2_normalize
from .lexicon import select_words
from .vector_sums import list_column, sum_vectors

# An n-gram table up to this size is sent to every executor.
NGRAM_BROADCAST_BYTES = 32 * 1024 * 1024

Encoder = Callable[[Sequence[str], int], tuple[np.ndarray, np.ndarray]]


def lookup_vectors(words: DataFrame, vocab: DataFrame, weights: DataFrame) -> DataFrame:
    """word -> vocabulary index -> vector; words without an entry drop out."""
    return (
        words.join(vocab.select("word", "idx"), "word")
        .join(weights.select("idx", "features"), "idx")
        .select("word_id", "word", "idx", F.col("features").cast("array<float>").alias("features"))
    )


def whole_word_embeddings(
    lexicon: DataFrame, vocab: DataFrame, weights: DataFrame, top_n: int | None = None
) -> DataFrame:
    """Words of the lexicon that the vocabulary has, with unit-length vectors."""
    words = select_words(lexicon, top_n, when="after", vocab=vocab)
    return lookup_vectors(words, vocab, weights).select(
        "word_id", "word", l2_normalize("features").alias("features")
    )


def word_ngrams(
    words: DataFrame, n_min: int = 3, n_max: int = 6, distinct: bool = True
) -> DataFrame:
    """One row per word and distinct n-gram, or per occurrence with ``distinct=False``."""
    return words.select(
        "word_id", "word", F.explode(char_ngrams("word", n_min, n_max, distinct)).alias("ngram")
    )


def subword_vectors(
    words: DataFrame,
    ngram_table: DataFrame,
    n_min: int = 3,
    n_max: int = 6,
    distinct: bool = True,
) -> DataFrame:
    """Sum of n-gram vectors per word, ``array<double>``.

    A word without any known n-gram keeps a row with the zero vector. A repeated
    n-gram counts once, or each time with ``distinct=False``.
    """
    known = ngram_table.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    if not known["n"]:
        raise ValueError("the n-gram table is empty")
    grams = word_ngrams(words.select("word_id", "word"), n_min, n_max, distinct)
    table = ngram_table.select("ngram", "features")
    if known["n"] * known["d"] * 4 <= NGRAM_BROADCAST_BYTES:
        # the n-grams of a word stay together, so a task adds them up before the shuffle
        hits = grams.join(F.broadcast(table), "ngram")
    else:
        # named, as the size of exploded n-grams is estimated by that of the words
        hits = grams.join(table.hint("merge"), "ngram")
    sums = sum_vectors(hits.select("word_id", "features"), ["word_id"], "features")
    zeros = F.array_repeat(F.lit(0.0), known["d"])
    return (
        words.select("word_id", "word")
        .join(sums, "word_id", "left")
        .select("word_id", "word", F.coalesce("features", zeros).alias("features"))
    )


def subword_embeddings(
    words: DataFrame,
    ngram_table: DataFrame,
    n_min: int = 3,
    n_max: int = 6,
    distinct: bool = True,
) -> DataFrame:
    """Unit-length subword vectors; never drops a word."""
    return subword_vectors(words, ngram_table, n_min, n_max, distinct).select(
        "word_id", "word", l2_normalize("features").alias("features")
    )


def masked_mean_pool(token_states: DataFrame, max_length: int | None = 16) -> DataFrame:
    """``(word_id, features)``: mean of the hidden states whose mask is 1.

    Tokens from ``max_length`` on are cut off first. A word without a masked
    token gets the zero vector.
    """
    rows = token_states
    if max_length is not None:
        rows = rows.where(F.col("pos") < max_length)
    mask = F.col("mask").cast("double")
    weighted = F.concat(
        F.array(mask), F.transform("hidden", lambda h: h.cast("double") * mask)
    )
    sums = sum_vectors(rows.select("word_id", weighted.alias("s")), ["word_id"], "s")
    total = F.greatest(F.col("s")[0], F.lit(1e-9))
    return sums.select(
        "word_id",
        F.transform(F.slice("s", 2, F.size("s") - 1), lambda x: x / total).alias("features"),
    )


def contextual_embeddings(
    words: DataFrame,
    encoder_factory: Callable[[], Encoder],
    max_length: int = 16,
    batch_size: int = 64,
) -> DataFrame:
    """Pooled, unit-length vectors from an encoder that the caller supplies.

    ``encoder_factory`` runs once per task and returns a function that maps a
    list of words and ``max_length`` to hidden states ``(n, tokens, width)`` and
    a mask ``(n, tokens)``. It cuts the tokens at ``max_length`` before they
    enter its model; more tokens are an error. Words go to it in batches and are
    pooled in place, so the token states never reach a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                encode = encode or encoder_factory()
                hidden, mask = encode(part.column("word").to_pylist(), max_length)
                hidden, mask = np.asarray(hidden, np.float64), np.asarray(mask, np.float64)
                if hidden.shape[1] > max_length:
                    raise ValueError(f"the encoder gave {hidden.shape[1]} tokens, not {max_length}")
                pooled = (hidden * mask[:, :, None]).sum(1)
                pooled /= np.maximum(mask.sum(1), 1e-9)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [part.column("word_id"), part.column("word"), list_column(pooled)],
                    ["word_id", "word", "features"],
                )

    pooled = words.select("word_id", "word").mapInArrow(
        run, "word_id long, word string, features array<double>"
    )
    return pooled.select("word_id", "word", l2_normalize("features").alias("features"))

