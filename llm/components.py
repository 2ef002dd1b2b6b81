"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.runtime import materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every linked node; the component is its smallest node.

    Labels go along links and then to the label of the label, so the rounds grow with the
    logarithm of a component's diameter. Each round's table is written to shared storage.
    Links with a null end are ignored. The sum of the labels falls in every round but the last.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter(
        "node is not null and other is not null and node != other"
    )
    both = materialize(
        ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(),
        "component-links",
    )
    label = materialize(
        both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")),
        "component-labels",
    )
    while True:
        near = both.join(
            label.select(F.col("node").alias("other"), F.col("component").alias("near")), "other"
        )
        best = near.groupBy("node").agg(F.min("near").alias("near"))
        moved = label.join(best, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        above = label.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved = moved.join(above, "component", "left").select(
            "node", "before", F.least("component", F.coalesce("above", "component")).alias("component")
        )
        moved = materialize(moved, "component-labels")
        label = moved.select("node", "component")
        if moved.filter("component != before").isEmpty():
            return label
