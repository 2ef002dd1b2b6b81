"""Curves and rankings over metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Metric columns and whether a higher value is better.
METRIC_DIRECTIONS = {
    "WCSS": False,
    "Silhouette": True,
    "Davies_Bouldin": False,
    "Calinski_Harabasz": True,
}


def _model_keys(df: DataFrame) -> list[str]:
    return ["model"] if "model" in df.columns else []


def metrics_long(metrics: DataFrame) -> DataFrame:
    """``[model,] k, Algorithm, metric, value, higher_is_better``, one row per value."""
    ids = [*_model_keys(metrics), "k", "Algorithm"]
    rows = metrics.unpivot(ids, list(METRIC_DIRECTIONS), "metric", "value")
    higher = [m for m, up in METRIC_DIRECTIONS.items() if up]
    return rows.withColumn("higher_is_better", F.col("metric").isin(*higher))


def metric_curves(metrics: DataFrame) -> DataFrame:
    """``[model,] metric, Algorithm, k, value``; rows of one point are averaged."""
    keys = [*_model_keys(metrics), "metric", "Algorithm", "k", "higher_is_better"]
    return metrics_long(metrics).groupBy(*keys).agg(F.avg("value").alias("value"))


def best_by_metric(metrics: DataFrame) -> DataFrame:
    """Algorithms by ``place`` per metric and k; equal values share a place."""
    signed = F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value"))
    keys = [*_model_keys(metrics), "metric", "k"]
    # a window holds one row per algorithm
    order = Window.partitionBy(*keys).orderBy(signed.asc_nulls_last())
    return metric_curves(metrics).withColumn("place", F.rank().over(order))


def metric_deltas(metrics: DataFrame) -> DataFrame:
    """Change from the previous k, and whether the whole curve only rises or only falls."""
    keys = [*_model_keys(metrics), "metric", "Algorithm"]
    curve = Window.partitionBy(*keys)  # one row per k
    delta = F.col("value") - F.lag("value").over(curve.orderBy("k"))
    return (
        metric_curves(metrics)
        .withColumn("delta", delta)
        .withColumn("rises", F.coalesce(F.bool_and(F.col("delta") >= 0).over(curve), F.lit(True)))
        .withColumn("falls", F.coalesce(F.bool_and(F.col("delta") <= 0).over(curve), F.lit(True)))
    )


def compare_models(tables: dict[str, DataFrame], n_points: dict[str, int]) -> DataFrame:
    """Metric tables of several models under one another, with WCSS per point."""
    parts = [
        df.select(
            F.lit(model).alias("model"), "k", "Algorithm", *METRIC_DIRECTIONS,
            (F.col("WCSS") / n_points[model]).alias("wcss_per_point"),
        )
        for model, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def coherence_chart_data(summary: DataFrame) -> DataFrame:
    """Coherence rows that have a value."""
    return summary.dropna(subset=["Mean_WordNet_Coherence"])
