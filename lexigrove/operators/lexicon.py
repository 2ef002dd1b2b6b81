"""Word selection: rank by frequency, clean, de-duplicate, cut, match a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import unicode_trim
from .ranking import top_ranked, with_rank


def _number(c: Column) -> Column:
    """NaN counts as missing; Spark would sort it above every number."""
    return F.when(F.isnan(c), None).otherwise(c)


def _low() -> Column:
    """Ascends from the most frequent word to those without a frequency."""
    return -F.coalesce("frequency", F.lit(float("-inf")))


def _clean(df: DataFrame) -> DataFrame:
    """Drop null words, cast to string and trim; blank words become ''."""
    raw = F.col("word").cast("string")
    return df.where(raw.isNotNull()).select(
        unicode_trim(raw).alias("word"), raw.alias("raw"), F.col("frequency")
    )


def filter_by_vocab(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep the words that the vocabulary has."""
    return words.join(vocab.select("word"), "word", "left_semi")


def select_words(
    lexicon: DataFrame,
    top_n: int | None = None,
    when: str = "before",
    vocab: DataFrame | None = None,
) -> DataFrame:
    """``(word_id, word, frequency)``, most frequent first; ties go by the raw word.

    ``when='before'`` cuts to ``top_n`` rows first and cleans afterwards, so null
    and duplicate rows use up places. ``when='after'`` cleans, removes
    duplicates, matches the vocabulary and cuts last. ``top_n=None`` keeps all.
    Of duplicate words the first in rank order stays.
    """
    if when not in ("before", "after"):
        raise ValueError("when must be 'before' or 'after'")
    rows = lexicon.select("word", _number(F.col("frequency").cast("double")).alias("frequency"))
    if top_n is not None and when == "before":
        order = [F.desc_nulls_last("frequency"), F.asc_nulls_last("word")]
        if top_n <= 0:
            raise ValueError("top_n must be positive")
        rows = top_ranked(rows, order, top_n, "place", _low()).select("word", "frequency")

    # the first occurrence of a word: highest frequency (null lowest), then smallest raw form
    place = F.struct(_low().alias("low"), "raw")
    words = (
        _clean(rows)
        .groupBy("word")
        .agg(F.max("frequency").alias("frequency"), F.min(place).alias("place"))
    )
    if vocab is not None:
        words = filter_by_vocab(words, vocab)
    order = [F.col("place.low").asc(), F.col("place.raw").asc()]
    if top_n is not None:
        ranked = top_ranked(words, order, top_n, "word_id", F.col("place.low"))
    else:
        ranked = with_rank(words, order, "word_id")
    return ranked.select("word_id", "word", "frequency")


def coverage_report(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: unique words, vocabulary size, matched words, unmatched words, share matched."""
    flagged = words.select("word").distinct().withColumn("in_words", F.lit(1)).join(
        vocab.select("word").distinct().withColumn("in_vocab", F.lit(1)), "word", "full"
    )
    both = F.col("in_words").isNotNull() & F.col("in_vocab").isNotNull()
    return flagged.agg(
        F.count("in_words").alias("unique_words"),
        F.count("in_vocab").alias("vocab_size"),
        F.count_if(both).alias("matched_words"),
    ).select(
        "*",
        (F.col("unique_words") - F.col("matched_words")).alias("unmatched_words"),
        F.try_divide("matched_words", "unique_words").alias("coverage"),
    )
