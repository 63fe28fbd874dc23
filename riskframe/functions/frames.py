"""Frame-level helpers: written intermediates and right-sized inputs."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name one that driver and executors share (HDFS, S3,
    ABFS...); without it this raises. Only in local mode, as in tests, a
    folder under the local temp dir is made and registered for the session.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(
                f"spark.checkpoint.dir is not set and the master is {sc.master}: "
                "name a folder that all executors share"
            )
        root = tempfile.mkdtemp(prefix="riskframe-ckpt-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint root for written tables. It
    is deleted when the driver's JVM ends."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/riskframe/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)  # only what is there can be marked
    system.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the checkpoint root and read back:
    computed once, cached nowhere, and a lost executor only re-reads files."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def right_sized(
    df: DataFrame, rows_per_partition: int = 500_000, min_partitions: int = 2
) -> DataFrame:
    """The frame in ``ceil(rows / rows_per_partition)`` partitions (at least
    ``min_partitions``), checkpointed into the shared folder.

    Iterative learners make passes over their input that cost a task per
    partition: a small training set should not come in hundreds. Rows are
    dealt and sorted by a hash of the whole row, so the layout is a function
    of the data and the parameters alone, whatever the cluster and the
    partitions before; learners that draw per partition then fit the same
    model everywhere. The checkpoint cuts the lineage: fits start from a scan
    of the written rows. Nothing stays cached.
    """
    checkpoint_root(df.sparkSession)
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = max(min_partitions, math.ceil(src.count() / max(1, rows_per_partition)))
        h = F.xxhash64(*[F.col(f"`{c}`") for c in src.columns])
        return src.repartition(parts, h).sortWithinPartitions(h).checkpoint(eager=True)
    finally:
        src.unpersist()
