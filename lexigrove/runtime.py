"""Shared-storage and size-check helpers used by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameters sent to every task (centres, mixture parameters, small lookup tables)
# must stay under this many bytes; beyond it the operators switch plan or refuse.
BROADCAST_BYTES = 256 * 1024 * 1024


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder.

    Only a local-mode session without the setting falls back to a temporary
    folder; a cluster session must name a folder that all executors share.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="lexigrove-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in shared storage and read it back.

    Cuts the lineage of iterative jobs and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def check_broadcast_size(n_bytes: int, what: str) -> None:
    if n_bytes > BROADCAST_BYTES:
        raise ValueError(
            f"{what} needs {n_bytes} bytes in every task, above the limit of {BROADCAST_BYTES}"
        )


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def uniform_hash(col: Column, salt: Column | int | str) -> Column:
    """Uniform non-negative 60-bit integer from a key and a salt.

    Depends on the values only, so samples and batches are the same for every
    partitioning and can be recomputed by any engine that has MD5.
    """
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    digest = F.md5(F.concat_ws(":", salt.cast("string"), col.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


HASH_RANGE = 16**15
