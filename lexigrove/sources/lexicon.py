"""Word lists and vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import unicode_trim
from .columns import normalize_columns, require_columns

# The markers a pandas CSV reader takes for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def decode_nulls(c: Column, null_tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(c.isin(*null_tokens), None).otherwise(c) if null_tokens else c


def read_lexicon(
    spark: SparkSession,
    path: str,
    word_col: str = "Word",
    freq_col: str = "Frequency",
    null_tokens: Sequence[str] = NULL_TOKENS,
    multiline: bool = False,
) -> DataFrame:
    """``(word, frequency)`` from a CSV with a header, which may carry a byte-order mark.

    Other columns are pruned in the scan. A file without a frequency column
    gives null frequencies. ``multiline`` allows line breaks inside quotes, at
    the price of one task per file.
    """
    raw = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )
    df = require_columns(normalize_columns(raw), [word_col], path)
    word = decode_nulls(F.col(f"`{word_col}`"), null_tokens).alias("word")
    if freq_col in df.columns:
        freq = decode_nulls(F.trim(F.col(f"`{freq_col}`")), null_tokens).try_cast("double")
    else:
        freq = F.lit(None).cast("double")
    return df.select(word, freq.alias("frequency"))


def find_first_match(spark: SparkSession, roots: Sequence[str], patterns: Sequence[str]) -> str:
    """Path of the first file that matches: roots in order, then patterns in order."""
    for root in roots:
        for pattern in patterns:
            try:
                hit = (
                    spark.read.format("binaryFile")
                    .option("recursiveFileLookup", True)
                    .option("pathGlobFilter", pattern)
                    .load(root)
                    .agg(F.min("path").alias("path"))
                    .first()
                )
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e.getCondition()):
                    raise
                break  # no such root
            if hit and hit["path"]:
                return hit["path"]
    raise FileNotFoundError(f"none of {list(patterns)} under {list(roots)}")


def read_first_match(
    spark: SparkSession,
    roots: Sequence[str],
    patterns: Sequence[str],
    whole_folder: bool = False,
    **options,
) -> DataFrame:
    """The lexicon in the first file that matches.

    ``whole_folder`` reads the folder that holds it: a lexicon written in several parts.
    """
    path = find_first_match(spark, roots, patterns)
    return read_lexicon(spark, path.rpartition("/")[0] if whole_folder else path, **options)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``(word, idx)``: trimmed line and 0-based line number; the last duplicate wins.

    Lines are numbered inside each file split and shifted by the number of lines
    in the splits before it, so no task sees more than one split.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
    )
    # one row per file split
    splits = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("mid").alias("first_mid")
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "block", "first_mid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return (
        lines.join(offsets, ["file", "block"])
        .select(
            unicode_trim("value").alias("word"),
            (F.col("offset") + F.col("mid") - F.col("first_mid")).alias("idx"),
        )
        .groupBy("word")
        .agg(F.max("idx").alias("idx"))
    )
