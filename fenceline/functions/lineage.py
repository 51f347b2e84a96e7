"""Lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F

# Rows (not bytes) a side may have to be broadcast; such sides are a few narrow
# columns wide, so this stays within tens of megabytes.
BROADCAST_ROWS = 200_000


def shared_folder(spark) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it."""
    _checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def _checkpoint_dir(spark) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = context.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="fenceline-checkpoint-")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the reliable checkpoint folder and restart its plan there."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder as Parquet and read from there, for loops that join a round's result with itself.

    A checkpoint keeps the estimated size of the plan it replaces. Joins multiply
    estimates, so their digits double or triple with every round, and after a dozen
    rounds planning takes longer than the work. A file has its own size.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give iterative work at least one partition per core.

    A few small files read as a partition or two; large inputs pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when df has been counted to be within the limit.

    Beyond it the plain DataFrame is returned and the join shuffles, with AQE
    splitting skewed partitions.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
