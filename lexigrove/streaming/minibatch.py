"""Mini-batch k-means as a Structured Streaming step.

Each micro-batch moves the centres once, as a batch of ``minibatch_kmeans`` does. Centres and the
points that they have seen are k rows in a folder per batch id under ``state``. A batch starts from
the latest state of smaller ids and overwrites its own, so a batch that is replayed after a failure
gives the same centres and counts nothing twice, and a stopped stream goes on where it was.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmeans import as_points, center_sums
from ..operators.minibatch import update_centers

_STATE = "cluster int, center array<double>, seen double, n_points long, cost double"
_START = -1  # the batch id of the centres that the stream starts from


def _write(spark: SparkSession, state: str, batch: int, centers: np.ndarray, seen: np.ndarray, n: int, cost: float) -> None:
    rows = [(i, c.tolist(), float(s), n, cost) for i, (c, s) in enumerate(zip(centers, seen))]
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{state}/batch={batch}")


def load_centers(spark: SparkSession, state: str, before: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Centres, the points each has seen and the batch id: the latest, or the latest below ``before``."""
    stored = spark.read.schema(f"{_STATE}, batch long").parquet(state)
    if before is not None:
        stored = stored.where(F.col("batch") < before)
    latest = stored.agg(F.max("batch")).first()[0]
    rows = stored.where(F.col("batch") == latest).orderBy("cluster").collect()
    return np.array([r["center"] for r in rows]), np.array([r["seen"] for r in rows]), latest


def step(batch: DataFrame, batch_id: int, state: str, id_col: str = "word_id", vec_col: str = "features") -> None:
    """Move the centres by one micro-batch; null vectors are left out, an empty batch keeps the centres."""
    spark = batch.sparkSession
    centers, seen, _ = load_centers(spark, state, before=batch_id)
    sums = center_sums(as_points(batch, id_col, vec_col).where("vec is not null"), centers)
    centers, seen = update_centers(centers, seen, sums)
    _write(spark, state, batch_id, centers, seen, int(sums[:, 0].sum()), float(sums[:, 1].sum()))


def stream_minibatch(
    stream: DataFrame,
    init_centers: np.ndarray,
    state: str,
    id_col: str = "word_id",
    vec_col: str = "features",
    **trigger,
) -> StreamingQuery:
    """Start the stream; ``trigger`` is what ``DataStreamWriter.trigger`` takes, by default all there is now.

    ``state`` is a folder that all executors share. If it holds centres, ``init_centers`` are not used.
    The source bounds a micro-batch (``maxFilesPerTrigger`` for files).
    """
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={_START}/_SUCCESS")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        centers = np.array(init_centers, np.float64)
        _write(spark, state, _START, centers, np.zeros(len(centers)), 0, 0.0)
    writer = stream.writeStream.foreachBatch(lambda batch, i: step(batch, i, state, id_col, vec_col))
    writer = writer.option("checkpointLocation", f"{state}-progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
