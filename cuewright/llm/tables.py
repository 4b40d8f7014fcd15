"""Table access shared by the corpus operators: inputs, the shared folder, checked broadcasts."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, new_folder, shared_dir  # noqa: F401
from . import words

#: A side is broadcast only after it was counted and found to hold at most this many (narrow) rows.
BROADCAST_ROWS = 1_000_000
#: Bounds on what goes to a Python worker at once: batches are copied several times, outside of the heap, by each task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffles and checkpoints that nothing refers to any more; else they wait for the driver to collect its garbage by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Checkpoint a narrow table, and hint a broadcast only if its counted rows stay within the bound."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= rows else df


def in_batches(df: DataFrame, work: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """mapInArrow() for df.transform(), in batches within BATCH (which the session keeps), after which a worker keeps nothing: workers serve many
    tasks, one after another."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            words.release()

    return df.mapInArrow(run, schema)
