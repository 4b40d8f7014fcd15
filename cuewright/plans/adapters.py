"""Domain tables from the driver's tables, in integer arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly, some tasks to a core: a file of one row group is otherwise read and worked on by one task, whatever its size."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a media and a turn a cue; long cues reach into the next."""
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")
    start = F.col("turn") * 4000 + size % 900
    stop = start + 500 + (size * 37) % 4200
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("media_id"), (F.col("turn") + 1).cast("int").alias("cue_no"), (start * 1000).alias("start_us"), (stop * 1000).alias("end_us"),
        F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("style"), F.lit("").alias("actor"),
    )


def cues_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a media and its lines are cues: the large table for timings."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("cue_no", F.row_number().over(w))
    start = (F.col("cue_no") - 1) * 4000 + F.col("l_partkey") % 900
    stop = start + 500 + (F.col("l_suppkey") * 37 + F.col("l_partkey") * 83) % 4200
    return rows.select(F.col("l_orderkey").alias("media_id"), "cue_no", (start * 1000).alias("start_us"), (stop * 1000).alias("end_us"), F.lit("").alias("text"), F.col("l_returnflag").alias("style"), F.lit("").alias("actor"))


def clips(cue_table: DataFrame) -> DataFrame:
    """The synthesised clip of most cues: media_id, index, clip_us, is_empty."""
    m, n = F.col("media_id"), F.col("cue_no")
    percent = F.when(m % 3 == 0, 85 + (n * 13 + m * 7) % 30).when(m % 3 == 1, 140 + (n * 13 + m * 7) % 20).otherwise(20 + (n * 67 + m * 7) % 200)
    length = F.expr("(end_us - start_us) div 1000 * percent div 100 * 1000")
    return cue_table.filter((m * 7 + n) % 11 != 0).withColumn("percent", percent).select("media_id", n.alias("index"), length.alias("clip_us"), ((m + n) % 17 == 0).alias("is_empty"))


def media(cue_table: DataFrame) -> DataFrame:
    """Each media's length; some end with their last cue."""
    return cue_table.groupBy("media_id").agg(F.max("end_us").alias("last")).select("media_id", (F.col("last") + F.col("media_id") % 3 * 1_000_000).alias("duration_us"))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a status log of twenty tasks with eight steps."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for x in ("signup", "started", "view", "progress", "click", "progress", "purchase", "completed", "error", "failed")])
    rows = table(spark, sf_dir, "events").withColumns({"k": k, "kind": F.element_at(kind, F.col("event_type"))})
    step = F.col("k") % 10 != 9
    return rows.select(
        F.col("event_id").alias("sequence"), F.col("ts").alias("event_time"), (F.col("user_id") % 20).alias("task_id"), F.when(step, F.col("k") % 8).alias("step_id"), "k", "kind",
        F.concat(F.when(step, "step_").otherwise("task_"), F.col("kind")).alias("event_type"), F.least(F.floor("value"), F.lit(100)).cast("int").alias("current_item"),
        F.lit(100).alias("total_items"), F.when(F.col("kind") == "failed", F.concat(F.lit("error "), F.col("k").cast("string"))).alias("error_message"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    return rows.select((F.col("user_id") % 20).alias("task_id"), F.get_json_object("props", "$.k").cast("int").alias("segment"), F.col("event_id").alias("attempt"), (F.col("event_type") == "purchase").alias("success"))


def resource_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("resource_type"), F.col("user_id").alias("holder"), F.unix_micros(F.col("ts").cast("timestamp")).alias("acquired_us"), F.round(F.col("value") * 1_000_000).cast("bigint").alias("hold_us"), F.col("event_id").alias("no"))


# One error text for each class of failure.
MESSAGES = [
    "CUDA out of memory", "no CUDA capable device", "unsupported format", "Invalid argument", "decoder not found", "Permission denied", "device busy", "hwaccel failed", "pixel format wrong",
    "cannot initialize", "nvenc trouble", "driver too old", "timeout reached", "connection refused", "resource temporarily unavailable", "impossible to convert between", "function not implemented", "ffmpeg error 1", "something else", "",
]


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(m) for m in MESSAGES])
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.element_at(texts, (F.col("event_id") % 20 + 1).cast("int")).alias("message"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a listing of media and subtitle files."""
    g, r = F.expr("page_id div 4"), F.col("page_id") % 4
    ext = F.when(r == 0, ".mp4").when(r == 1, ".srt").when((r == 2) & (g % 3 == 0), ".ass").when(r == 2, ".log").when(g % 5 == 0, ".mkv").otherwise(".vtt")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("/m/"), (g % 7).cast("string"), F.lit("/clip"), g.cast("string"), ext).alias("path"))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as short clips of samples; every fifth is nearly silent."""
    quiet = F.when(F.col("vec_id") % 5 == 0, F.lit(0.001)).otherwise(F.lit(1.0))
    samples = F.transform(F.col("embedding"), lambda x: x.cast("double") * quiet)
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("media_id"), (F.col("vec_id") + 1).alias("index"), samples.alias("samples"), F.lit(32).alias("sample_rate"))


#: Length of a chunk of chunks().
CHUNK_US = 2_000_000


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips of audio() of one label as the chunks of one track, two seconds each."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("media_id").orderBy("index")) - 1
    return audio(spark, sf_dir).select("media_id", number.cast("bigint").alias("chunk_no"), "sample_rate", "samples")
