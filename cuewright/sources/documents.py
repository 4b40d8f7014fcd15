"""Result, status and task documents, and log lines, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecode import format_time
from ..model import ALIGNMENT_DOCUMENT, REFERENCE_DOCUMENT, STEP_STATUS, STEPS, SYNTHESIS_DOCUMENT, TASK_STATE


def _segments(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """A row for each segment of the successful documents below a path."""
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    rows = docs.filter("success").select(F.col("_metadata.file_path").alias("document"), F.explode(field).alias("s"))
    return rows.select("document", "s.*").filter("index is not null")


def read_reference_results(spark: SparkSession, path: str) -> DataFrame:
    return _segments(spark, path, REFERENCE_DOCUMENT, "reference_audio_segments")


def read_synth_results(spark: SparkSession, path: str) -> DataFrame:
    """Segments with is_empty as is_silence; those without an index or a length are passed over."""
    return _segments(spark, path, SYNTHESIS_DOCUMENT, "tts_audio_segments").filter("duration is not null").withColumnRenamed("is_empty", "is_silence")


def read_aligned_results(spark: SparkSession, path: str) -> DataFrame:
    """Segments that are not silent."""
    return _segments(spark, path, ALIGNMENT_DOCUMENT, "aligned_audio_segments").filter(~F.coalesce("is_silence", F.lit(False)))


def read_step_status(spark: SparkSession, path: str) -> DataFrame:
    """A row for each step of the step-status documents (a map by step number) below a path."""
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    steps = F.from_json("value", f"map<string,{STEP_STATUS}>")
    return docs.select(F.col("_metadata.file_path").alias("document"), F.explode(steps).alias("no", "s")).select("document", "s.*")


def read_task_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK_STATE).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """document, field, value: a row for each field of the metadata documents below a path; what is nested is JSON."""
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return docs.select(F.col("_metadata.file_path").alias("document"), F.explode(F.from_json("value", "map<string,string>")).alias("field", "value"))


_STEP_RESULTS = "map<string,struct<success:boolean,message:string,error:string,processing_time:double,is_partial:boolean>>"
_V2 = (
    "metadata struct<version:string,updated_at:string>, task struct<task_id:string,video_path:string,subtitle_path:string,paths:map<string,string>,"
    "current_step:int,status:string,progress:double,step_results:map<string,struct<success:boolean,message:string,error:string,processing_time:double,is_partial:boolean>>>"
)
_V1 = "completed_steps map<string,struct<completed:boolean,completed_at:string>>, file_paths map<string,string>, created_at string, updated_at string"


def convert_legacy_tasks(docs: DataFrame) -> DataFrame:
    """First-version documents (document, completed_steps, file_paths, updated_at) as task rows: the step behind the last completed one, and
    completed steps of eight as progress."""
    spark = docs.sparkSession
    steps = F.broadcast(spark.createDataFrame(STEPS, "step_id int, step_name string"))
    done = docs.select("document", F.explode("completed_steps").alias("step_name", "s")).filter("s.completed").join(steps, "step_name")
    folded = done.groupBy("document").agg((F.max("step_id") + 1).alias("current_step"), F.count("*").alias("n"), F.array_sort(F.collect_list("step_id")).alias("steps"))
    rows = docs.select("document", "file_paths", "updated_at").join(folded, "document", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == len(STEPS), "completed").when(n > 0, "processing").otherwise("pending")
    return rows.select("document", F.col("file_paths").alias("paths"), F.coalesce("current_step", F.lit(0)).alias("current_step"), status.alias("status"), (n * 100.0 / len(STEPS)).alias("progress"), F.coalesce("steps", F.array().cast("array<int>")).alias("completed_steps"))


def read_task_docs(spark: SparkSession, path: str) -> DataFrame:
    """Task documents of both versions below a path, in the columns of convert_legacy_tasks()."""
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("document"), "value")
    new = docs.withColumn("v2", F.from_json("value", _V2))
    current = new.filter("v2.metadata.version = '2.0'")
    steps = F.map_keys(F.map_filter(F.coalesce("v2.task.step_results", F.create_map().cast("map<string,struct<success:boolean,message:string,error:string,processing_time:double,is_partial:boolean>>")), lambda _, r: r["success"]))
    kept = current.select("document", F.col("v2.task.paths").alias("paths"), "v2.task.current_step", "v2.task.status", "v2.task.progress", F.array_sort(F.transform(steps, lambda k: k.cast("int"))).alias("completed_steps"))
    old = new.filter("coalesce(v2.metadata.version, '') <> '2.0'").select("document", F.from_json("value", _V1).alias("v1")).select("document", "v1.*")
    return kept.unionByName(convert_legacy_tasks(old))


def read_task_dicts(spark: SparkSession, path: str) -> DataFrame:
    """document, task_id, status, current_step, progress, step_results of the task documents that task_documents() makes, below a path."""
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    task = F.from_json("value", f"task_id string, status string, current_step int, progress double, step_results {_STEP_RESULTS}")
    return docs.select(F.col("_metadata.file_path").alias("document"), task.alias("t")).select("document", "t.*")


def task_steps(tasks: DataFrame) -> DataFrame:
    """Task rows (task_id, step_results map) as one row for each step."""
    return tasks.select("task_id", F.explode("step_results").alias("step", "r")).select("task_id", F.col("step").cast("int").alias("step_id"), "r.*")


def task_documents(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    """task_id and the JSON of a task with its step rows as a map by step number."""
    fields = [c for c in steps.columns if c not in ("task_id", "step_id")]
    own = F.array_sort(F.collect_list(F.struct(F.col("step_id").cast("string").alias("key"), F.struct(*fields).alias("value"))))
    folded = steps.groupBy("task_id").agg(F.map_from_entries(own).alias("step_results"))
    rows = tasks.join(folded, "task_id", "left")
    return rows.select("task_id", F.to_json(F.struct(*[c for c in rows.columns])).alias("document"))


def cache_inventory(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    """Per document: completed steps, result files, and whether anything in it can be used again."""
    files = steps.groupBy("document").agg(F.count_if(F.col("status") == "completed").alias("steps_done"), F.sum(F.coalesce(F.size("result_files"), F.lit(0))).alias("files"))
    rows = tasks.join(files, "document", "left").fillna(0, ["steps_done", "files"])
    return rows.withColumn("is_valid", F.col("steps_done") > 0)


def cue_documents(cues: DataFrame) -> DataFrame:
    """media_id, cue_no and the JSON record of each cue; times as a clock's, with six places where they have a fraction."""
    record = F.struct(format_time(F.col("start_us"), "iso").alias("start_time"), format_time(F.col("end_us"), "iso").alias("end_time"), "text", "style", "actor")
    return cues.select("media_id", "cue_no", F.to_json(record).alias("document"))


def _clock(text: Column) -> Column:
    """Microseconds of HH:MM:SS with a fraction or without."""
    parts = F.split(text, ":")
    return (parts[0].cast("bigint") * 3600 + parts[1].cast("bigint") * 60) * 1_000_000 + (parts[2].cast("decimal(8,6)") * 1_000_000).cast("bigint")


def parse_cue_documents(documents: DataFrame) -> DataFrame:
    """Cues from their JSON records; a record without a style is of style Default, without an actor of none."""
    r = F.from_json("document", "start_time string, end_time string, text string, style string, actor string")
    rows = documents.withColumn("r", r)
    return rows.select("media_id", "cue_no", _clock(F.col("r.start_time")).alias("start_us"), _clock(F.col("r.end_time")).alias("end_us"), F.col("r.text").alias("text"), F.coalesce("r.style", F.lit("Default")).alias("style"), F.coalesce("r.actor", F.lit("")).alias("actor"))


_DOCUMENTS = {"reference": (REFERENCE_DOCUMENT, "reference_audio_segments"), "synthesis": (SYNTHESIS_DOCUMENT, "tts_audio_segments"), "alignment": (ALIGNMENT_DOCUMENT, "aligned_audio_segments")}


def parse_result_documents(documents: DataFrame, kind: str) -> DataFrame:
    """media_id and the segments of successful result documents (media_id, document) of a kind: reference, synthesis or alignment."""
    schema, field = _DOCUMENTS[kind]
    rows = documents.select("media_id", F.from_json("document", schema).alias("d")).filter("d.success")
    return rows.select("media_id", F.explode(f"d.{field}").alias("s")).select("media_id", "s.*").filter("index is not null")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """time, level, message of log lines, and the task that a line of success names."""
    line = r"^(.*?) - (\w+) - (.*)$"
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    message = F.regexp_extract("value", line, 3)
    rows = rows.select(F.regexp_extract("value", line, 1).alias("time"), F.regexp_extract("value", line, 2).alias("level"), message.alias("message"))
    task = F.nullif(F.regexp_extract("message", r"(?i)task[ :]+(\S+)", 1), F.lit(""))
    return rows.withColumn("task", F.when(F.lower("message").contains("success"), task))
