"""Where intermediate results go: the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Setting that removes an action's shuffle files when it ends, and the mark of a checkpoint.
CLEANUP, CHECKPOINT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "_corroborate_checkpoint"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Actions on DataFrames made in here leave no shuffle files when they end."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    A local session without the setting takes a folder under its warehouse; on a cluster, where
    that might be a folder of one machine, the setting must be there.
    Shuffle files of the step go when it ends, as nothing reads them again. A checkpoint is not written again.
    """
    if getattr(df, CHECKPOINT, False):
        return df
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    with cleaned(spark):
        kept = df.select("*").checkpoint()
    setattr(kept, CHECKPOINT, True)
    return kept
