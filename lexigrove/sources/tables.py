"""Embedding, assignment, metric and coherence tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import normalize_columns, require_columns

METRICS_SCHEMA = (
    "k INT, Algorithm STRING, WCSS DOUBLE, Silhouette DOUBLE, "
    "Davies_Bouldin DOUBLE, Calinski_Harabasz DOUBLE"
)
COHERENCE_SCHEMA = (
    "Algorithm STRING, Mean_WordNet_Coherence DOUBLE, Std_WordNet_Coherence DOUBLE, "
    "Clusters_Evaluated INT, Clusters_Skipped INT"
)


def _read_first(spark: SparkSession, paths: str | list[str], read) -> DataFrame:
    """First path that exists; later ones are fallback names."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        try:
            return read(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
    raise FileNotFoundError(f"could not find any of {paths}")


def read_embeddings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(word_id, word, features)`` with ``features`` as ``array<float>``."""
    df = _read_first(spark, path, spark.read.parquet)
    require_columns(df, ["word_id", "word", "features"], str(path))
    return df.select("word_id", "word", F.col("features").cast("array<float>").alias("features"))


def write_embeddings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    require_columns(df, ["word_id", "word", "features"], "embeddings")
    df.select(
        F.col("word_id").cast("long"), "word", F.col("features").cast("array<float>")
    ).write.mode(mode).parquet(path)


def write_assignments(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """One folder per model and algorithm, so readers prune to what they need."""
    keys = [c for c in ("model", "algorithm") if c in df.columns]
    writer = df.write.mode(mode).partitionBy(*keys)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def read_assignments(
    spark: SparkSession, path: str, suffix: str = "_clusters", skip_corrupt: bool = True
) -> DataFrame:
    """``(algorithm, word, cluster)`` from a partitioned table or from CSV files.

    ``path`` is a folder written by :func:`write_assignments`, or a glob of
    ``<algorithm><suffix>.csv`` files. Headers are compared in lower case, and
    files that lack ``word`` or ``cluster`` are skipped, as are unreadable ones
    unless ``skip_corrupt`` is false.
    """
    reader = spark.read.option("ignoreCorruptFiles", skip_corrupt)
    if not path.endswith(".csv"):
        return normalize_columns(reader.parquet(path), lower=True)
    # a file, or a folder of part files, named <algorithm><suffix>.csv
    root = F.regexp_extract("path", r"^(.*?/[^/]+\.csv)(/[^/]*)?$", 1)
    files = spark.read.format("binaryFile").load(path).select(root.alias("root")).distinct()
    tables = []
    # one short header read per algorithm
    for row in files.orderBy("root").collect():
        name = row["root"].rsplit("/", 1)[-1].removesuffix(".csv").replace(suffix, "")
        df = normalize_columns(reader.option("header", True).csv(row["root"]), lower=True)
        if {"word", "cluster"} <= set(df.columns):
            cluster = F.col("cluster").try_cast("double").cast("int").alias("cluster")
            tables.append(df.select(F.lit(name).alias("algorithm"), "word", cluster))
    if not tables:
        raise FileNotFoundError(f"no usable assignment files at {path}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _csv_by_name(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV columns picked by header name, whatever their order, and cast to ``ddl``."""
    fields = [f.rsplit(" ", 1) for f in ddl.split(", ")]
    df = normalize_columns(spark.read.option("header", True).csv(path))
    require_columns(df, [name for name, _ in fields], path)
    keys = ["model"] if "model" in df.columns else []
    return df.select(*keys, *[F.col(name).try_cast(kind).alias(name) for name, kind in fields])


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Metric table; a list of paths means fallback names."""
    return _read_first(spark, path, lambda p: _csv_by_name(spark, p, METRICS_SCHEMA))


def write_coherence(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_coherence(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _read_first(spark, path, lambda p: _csv_by_name(spark, p, COHERENCE_SCHEMA))
