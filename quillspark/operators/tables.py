"""Tables that an operator uses again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df from the checkpoint folder that the cluster names; a session of one process has a folder of its own instead."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("/tmp/checkpoints")
    return df.checkpoint()


#: So many rows (of a key or a hit each) may go to every task, so that the table they are joined with stays where it lies.
FEW = 1 << 16


def few(df: DataFrame) -> DataFrame:
    """df, written once, with the mark to go to every task if it has few rows; else a join is left to move both sides."""
    df = cut(df)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


#: Bytes of a file that a scan makes one task of (spark.sql.files.maxPartitionBytes by default; a row group at least).
SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files are too few or too small for a task each; a table of more than a split for each core stays as it lies.

    What is moved is below one split a core, at any size of cluster. It pays where a row costs far more to work on than to move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT else df
