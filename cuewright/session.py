"""Spark settings that the library counts on, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # GBK is not among the charsets that decode() takes by default.
    "spark.sql.legacy.javaCharsets": "true",
    # decode() then replaces what it cannot read, which decode_text() takes as a sign of another charset.
    "spark.sql.legacy.codingErrorAction": "true",
    # Folders are listed by so many tasks; by default each folder has a task of its own, up to 10,000.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "128",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's own checkpoint folder. Where neither is set, local mode gets a new one; on a
    cluster that is an error, as executors would not see it."""
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cuewright-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, partitions and their order kept; Spark removes the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
