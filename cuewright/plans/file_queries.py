"""Registered queries of readers and sinks, which write to a new shared folder and read it again, of streams over such a folder, and of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import progress as S
from ..operators import timeline as L
from ..session import configure, new_folder
from ..sources import documents as O
from ..sources import sinks as W
from ..sources import subtitles as Q
from ..streaming import events as E
from . import adapters as D
from . import stages as G
from .queries import _files, _steps, query
from .record_queries import _legacy, _states


def _by_document(rows: DataFrame, column: str = "document") -> DataFrame:
    """Rows of files written by `key=…`, with that key as a number."""
    return rows.withColumn("key", F.regexp_extract(column, r"(?:key|media_id)=(-?\d+)", 1).cast("bigint")).drop(column)


def _written(rows: DataFrame, name: str) -> str:
    """A text file for each row (key, value), below a new folder."""
    folder = new_folder(rows.sparkSession, name)
    rows.select("key", "value").write.partitionBy("key").text(folder)
    return folder


# Subtitle files.


@query
def decode_text(spark, sf_dir):
    """Documents as bytes of UTF-8, of UTF-8 behind a mark, and of GBK, with Han in front; and of ISO-8859-1."""
    configure(spark)
    plain = F.concat(F.lit("中文字幕 "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f]", ""))
    kind = F.col("doc_id") % 4
    latin = F.concat(F.lit("Ã¿é "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f]", ""))
    content = F.when(kind == 0, F.encode(plain, "UTF-8")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(plain, "UTF-8"))).when(kind == 2, F.encode(plain, "GBK")).otherwise(F.encode(latin, "ISO-8859-1"))
    return D.table(spark, sf_dir, "documents").select("doc_id", F.md5(Q.decode_text(content).cast("binary")).alias("digest"))


def _media_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("media_id", F.substring_index("path", ".", 1).cast("bigint"))


@query
def srt_allow_empty(spark, sf_dir):
    """SRT files in which every fourth cue has no text, which this mode keeps; texts without tags and special characters."""
    cues = D.cues(spark, sf_dir).withColumn("text", F.when(F.col("cue_no") % 4 == 0, "").otherwise(F.lit("a line")))
    files = W.render_srt(cues).select(F.concat(F.col("media_id").cast("string"), F.lit(".srt")).alias("path"), "content")
    return _media_of(Q.read_srt(files, "allow_empty")).select("media_id", "cue_no", "start_us", "end_us", "text")


@query
def srt_regex(spark, sf_dir):
    """SRT files read with texts cleaned for speech: those of one character and of brackets alone are empty."""
    n = F.col("cue_no") % 4
    cues = D.cues(spark, sf_dir).withColumn("text", F.when(n == 0, "x").when(n == 1, "[music]").when(n == 2, F.concat(F.lit("(low) go to 5 & "), F.col("cue_no").cast("string"))).otherwise(F.lit("two  words")))
    files = W.render_srt(cues).select(F.concat(F.col("media_id").cast("string"), F.lit(".srt")).alias("path"), "content")
    return _media_of(Q.read_srt(files, "regex")).select("media_id", "cue_no", "start_us", "end_us", "text")


@query
def write_subtitles(spark, sf_dir):
    """Cues written as SRT files, one a media, and read from these."""
    configure(spark)
    folder = new_folder(spark, "srt")
    W.write_subtitles(D.cues(spark, sf_dir).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))), folder, "srt")
    rows = _by_document(Q.read_srt(Q.read_files(spark, folder)).withColumnRenamed("path", "document")).withColumnRenamed("key", "media_id")
    return rows.select("media_id", "cue_no", "start_us", "end_us", "text", "style")


# Result, status and task documents, and logs.


@query
def reference_results(spark, sf_dir):
    """Measured clips as reference documents, written and read."""
    rows = D.audio(spark, sf_dir).select("media_id", F.col("index").cast("int").alias("index"), F.lit(2.0).alias("duration"), "sample_rate", F.size("samples").cast("long").alias("audio_length"), (F.col("index") % 3 == 0).alias("is_silence"))
    folder = new_folder(spark, "reference")
    W.write_results_json(rows, folder, "reference_audio_segments", "index", "t")
    return _by_document(O.read_reference_results(spark, folder)).select(F.col("key").alias("media_id"), "index", "duration", "sample_rate", "audio_length", "is_silence")


@query
def synth_results(spark, sf_dir):
    """Clips as synthesis documents, some without a length, which the reader passes over."""
    clips = D.clips(D.cues(spark, sf_dir))
    length = F.when(F.col("index") % 5 != 0, F.col("clip_us") / 1e6)
    folder = new_folder(spark, "synthesis")
    W.write_results_json(clips.select("media_id", "index", length.alias("duration"), "is_empty"), folder, "tts_audio_segments", "index", "t")
    return _by_document(O.read_synth_results(spark, folder)).select(F.col("key").alias("media_id"), "index", F.round("duration", 6).alias("duration"), "is_silence")


@query
def aligned_results(spark, sf_dir):
    """The played timeline as alignment documents, of which the reader takes what is not silent."""
    played = L.playout_timeline(D.cues(spark, sf_dir), D.clips(D.cues(spark, sf_dir)))
    rows = played.select("media_id", F.col("seg_no").alias("index"), (F.col("start_us") / 1e6).alias("start_time"), (F.col("end_us") / 1e6).alias("end_time"), "is_silence")
    folder = new_folder(spark, "alignment")
    W.write_results_json(rows, folder, "aligned_audio_segments", "index", "t")
    return _by_document(O.read_aligned_results(spark, folder)).select(F.col("key").alias("media_id"), "index", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@query
def status_docs(spark, sf_dir):
    """Steps, state and metadata of each task as the three documents of a cache, written and read: kind, task, field, value."""
    steps, states = _steps(spark, sf_dir), _states(spark, sf_dir)
    step = F.struct("step_id", "status", F.col("progress").alias("progress_percent"), "current_item", "total_items", "error_message")
    of_steps = steps.groupBy(F.col("task_id").alias("key")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("step_id").cast("string").alias("k"), step.alias("v"))))).alias("value"))
    of_states = states.select(F.col("task_id").alias("key"), F.to_json(F.struct(F.col("task_id").cast("string").alias("task_id"), "status", "progress", "error_message")).alias("value"))
    of_metadata = states.select(F.col("task_id").alias("key"), F.to_json(F.struct(F.lit("1.0").alias("version"), F.col("status").alias("last"), F.struct("steps_done").alias("counts"))).alias("value"))
    read = {
        "step": _by_document(O.read_step_status(spark, _written(of_steps, "steps"))).select("key", F.col("step_id").cast("string").alias("field"), F.concat_ws("|", "status", F.col("current_item").cast("string"), "error_message").alias("value")),
        "state": _by_document(O.read_task_states(spark, _written(of_states, "states")).withColumn("document", F.col("_metadata.file_path"))).select("key", F.lit("status").alias("field"), F.concat_ws("|", "task_id", "status", "error_message").alias("value")),
        "metadata": _by_document(O.read_metadata(spark, _written(of_metadata, "metadata"))).select("key", "field", "value"),
    }
    step_rows, state_rows, metadata_rows = (rows.select(F.lit(kind).alias("kind"), F.col("key").alias("task_id"), "field", "value") for kind, rows in read.items())
    return step_rows.unionByName(state_rows).unionByName(metadata_rows)


@query
def task_docs(spark, sf_dir):
    """Legacy documents, and states as documents of the second version, written to one folder and read."""
    names = F.create_map(*[F.lit(x) for pair in O.STEPS for x in pair])
    old = _legacy(spark, sf_dir).select((F.col("task_id") + 1000).alias("key"), "completed_steps")
    done = F.map_from_entries(F.transform("completed_steps", lambda s: F.struct(F.element_at(names, s).alias("k"), F.struct(F.lit(True).alias("completed")).alias("v"))))
    first = old.select("key", F.to_json(F.struct(done.alias("completed_steps"), F.create_map(F.lit("video"), F.lit("v.mp4")).alias("file_paths"))).alias("value"))
    good = _steps(spark, sf_dir).filter("status = 'completed'").groupBy(F.col("task_id").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("step_id").cast("string"), F.struct(F.lit(True).alias("success"))))).alias("results"))
    states = _states(spark, sf_dir).select(F.col("task_id").alias("key"), "status", "progress").join(good, "key", "left")
    task = F.struct(F.col("key").cast("string").alias("task_id"), F.lit(3).alias("current_step"), "status", "progress", F.col("results").alias("step_results"))
    second = states.select("key", F.to_json(F.struct(F.struct(F.lit("2.0").alias("version")).alias("metadata"), task.alias("task"))).alias("value"))
    rows = _by_document(O.read_task_docs(spark, _written(first.unionByName(second), "tasks")))
    return rows.select(F.col("key").alias("task_id"), "current_step", "status", "progress", F.array_join("completed_steps", ",").alias("steps"))


@query
def task_dicts(spark, sf_dir):
    """Tasks with their steps as one document each, written and read as step rows."""
    steps = _steps(spark, sf_dir).select("task_id", "step_id", (F.col("status") == "completed").alias("success"), F.col("status").alias("message"), F.col("error_message").alias("error"), F.col("current_item").cast("double").alias("processing_time"), (F.col("status") == "processing").alias("is_partial"))
    docs = O.task_documents(_states(spark, sf_dir).select("task_id", "status"), steps)
    tasks = O.read_task_dicts(spark, _written(docs.select(F.col("task_id").alias("key"), F.col("document").alias("value")), "dicts"))
    return O.task_steps(tasks).select(F.col("task_id").cast("bigint").alias("task_id"), "step_id", "success", "message", "error", "processing_time", "is_partial")


@query
def log_lines(spark, sf_dir):
    """Events as lines of a log with other lines between them."""
    level = F.when(F.col("kind") == "failed", "ERROR").otherwise("INFO")
    message = F.when(F.col("kind") == "completed", F.concat(F.lit("Task t"), F.col("task_id").cast("string"), F.lit(" success"))).otherwise(F.concat(F.lit("task: t"), F.col("task_id").cast("string"), F.lit(" - "), F.col("kind")))
    lines = D.status_events(spark, sf_dir).select(F.when(F.col("sequence") % 9 == 0, F.lit("no line of the log")).otherwise(F.concat(F.col("sequence").cast("string"), F.lit(" - "), level, F.lit(" - "), message)).alias("value"))
    folder = new_folder(spark, "log")
    lines.write.text(folder)
    return O.read_log_lines(spark, folder).select(F.col("time").cast("bigint").alias("sequence"), "level", "message", "task")


# Texts.


@query
def space_protected(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.space_protected(F.col("text")).cast("binary")).alias("digest"))


@query
def text_pipeline(spark, sf_dir):
    """A user's function that gives a piece for each sentence that ends with a question or exclamation mark, and fails for texts without any letter e."""

    def shouts(text: str):
        if "e" not in text:
            raise ValueError("no e")
        return [p for p in text.replace("!", "!\0").replace("?", "?\0").split("\0")[:-1]]

    rows = G.text_pipeline(D.table(spark, sf_dir, "documents").select("doc_id", "text"), shouts)
    return rows.select("doc_id", "piece_no", F.char_length("piece").alias("length"), "error")


# Streams and stages.


def _log(spark, sf_dir):
    """The log in three files, as a stream of them."""
    events = D.status_events(spark, sf_dir)
    folder = new_folder(spark, "events")
    events.repartition(3, "sequence").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def sync_snapshots(spark, sf_dir):
    """Step states that two streaming queries over the log keep in one table."""
    stream = _log(spark, sf_dir)
    time = stream.schema["event_time"].dataType.simpleString()
    table = E.step_table(spark, new_folder(spark, "steps"), 8, time)
    running = E.sync_snapshots(stream, table, new_folder(spark, "progress"))
    try:
        E.flush_events(*running)
    finally:
        for each in running:
            each.stop()
    return table.read().drop("sequence")


@query
def on_event(spark, sf_dir):
    """What a callback for failures of steps has written, beside one that fails."""
    folder = new_folder(spark, "failures")

    def fails(batch, number):
        raise ValueError("told of")

    running = E.on_event(_log(spark, sf_dir), "step_failed", [fails, lambda batch, number: batch.select("sequence", "task_id", "error_message").write.parquet(f"{folder}/{number}")], new_folder(spark, "progress"))
    try:
        E.flush_events(running)
    finally:
        running.stop()
    return spark.read.schema("sequence long, task_id long, error_message string").parquet(f"{folder}/*")


@query
def stages(spark, sf_dir):
    """All stages over the cues, and what the last one plans."""
    cues = D.cues(spark, sf_dir)
    references = D.clips(cues).select("media_id", "index", F.lit("r").alias("file_path"))
    return G.run_stages({"cues": cues, "clips": D.clips(cues), "media": D.media(cues), "references": references})["mux"]
