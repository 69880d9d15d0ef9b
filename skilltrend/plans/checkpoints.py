"""Cutting lineage and sizing broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_CONF = "spark.sql.autoBroadcastJoinThreshold"
MEASURED_BROADCAST_CONF = "spark.sql.adaptive.autoBroadcastJoinThreshold"
BROADCAST_ROW_LIMIT = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a temporary folder: on a cluster a
    folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        # "local-cluster" has several executors and so counts as a cluster.
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="skilltrend-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path inside the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has few enough rows.

    A larger ``df`` comes back as it is; the join then shuffles, and adaptive
    execution still splits its skewed partitions.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Jobs inside broadcast a side of a join only by its measured size.

    Before a run the planner knows the bytes of files alone. Coded columns take
    many times as much in memory, and rows made by ``explode`` are not counted
    at all, so it would gather in the driver what cannot fit there. Adaptive
    execution sees what a shuffle really wrote and goes by the same limit.
    """
    conf = spark.conf
    limit, measured = conf.get(BROADCAST_CONF), conf.get(MEASURED_BROADCAST_CONF, None)
    if measured is None:
        conf.set(MEASURED_BROADCAST_CONF, limit)
    conf.set(BROADCAST_CONF, "-1")
    try:
        yield
    finally:
        conf.set(BROADCAST_CONF, limit)
        if measured is None:
            conf.unset(MEASURED_BROADCAST_CONF)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder now and read it back.

    As a checkpoint would, this cuts the lineage and survives lost executors. A
    columnar file also lets later steps read only the columns they need and
    gives the planner real sizes.
    """
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``staged``, with the folder, so that it can be discarded later.

    What the write shuffled goes with it: a later step reads the folder, and
    otherwise shuffle files stay until the driver happens to collect garbage.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, "false")
    conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP_CONF, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``staged_at`` wrote and nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` over all shuffle partitions.

    For steps that make many rows of each row: adaptive execution sizes
    partitions by what goes in, and would leave a small table in one task.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
