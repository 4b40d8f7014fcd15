"""Registered queries of work lists, records, lookups and smaller functions; queries.py has the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import text as T
from ..functions import timecode as C
from ..operators import pairing as P
from ..operators import progress as S
from ..operators import retime as R
from ..operators import timeline as L
from ..sources import documents as O
from ..session import new_folder
from ..sources import sinks as W
from ..sources import subtitles as Q
from ..sources.keyed import KeyedTable
from . import adapters as D
from .queries import _files, _steps, query

# Times.


@query
def cue_times(spark, sf_dir):
    """time_to_seconds, seconds_to_time, seconds_to_srt, cue_duration, valid_cue, same_time_group of each cue."""
    seconds = C.to_seconds(F.col("start_us"))
    return D.cues(spark, sf_dir).select(
        "media_id", "cue_no", F.round(seconds, 6).alias("seconds"), C.from_seconds(seconds - 7.5).alias("wrapped_us"), C.seconds_to_srt(seconds).alias("written"),
        C.duration(F.col("start_us"), F.col("end_us")).alias("duration_us"), C.valid_cue().alias("is_valid"), C.same_time_group(F.col("start_us"), F.col("end_us")).alias("is_short"),
    )


@query
def scale_time(spark, sf_dir):
    return C.scale_time(D.cues(spark, sf_dir), 1.5).select("media_id", "cue_no", "start_us", "end_us")


@query
def sort_cues(spark, sf_dir):
    """Cues by their length in place of their start, so that the order is another and has ties."""
    cues = D.cues(spark, sf_dir).withColumn("start_us", F.expr("(end_us - start_us) div 1000000"))
    return L.sort_cues(cues).select("media_id", "cue_no", "place")


@query
def sort_segments(spark, sf_dir):
    played = L.playout_timeline(D.cues(spark, sf_dir), D.clips(D.cues(spark, sf_dir)))
    return L.sort_segments(played.drop("seg_no")).select("media_id", "seg_no", "start_us", "is_silence")


# Files.


@query
def srt_timestamps(spark, sf_dir):
    return Q.read_srt_timestamps(_files(spark, sf_dir, "srt")).select(F.substring_index("path", ".", 1).cast("bigint").alias("media_id"), "cue_no", "start_us", "end_us")


@query
def extract_style_to_srt(spark, sf_dir):
    files = W.extract_style_to_srt(_files(spark, sf_dir, "ass"), "user")
    return files.select(F.substring_index("path", ".", 1).cast("bigint").alias("media_id"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query
def cue_json(spark, sf_dir):
    """Cues as JSON records and back."""
    cues = D.cues(spark, sf_dir)
    back = O.parse_cue_documents(O.cue_documents(cues))
    return back.select("media_id", "cue_no", "start_us", "end_us", F.md5(F.col("text").cast("binary")).alias("text_md5"), "style", "actor")


@query
def result_json(spark, sf_dir):
    """Clips as result documents, one a media, and their segments read from those."""
    rows = D.clips(D.cues(spark, sf_dir)).select("media_id", "index", (F.col("clip_us") / 1e6).alias("duration"), "is_empty")
    done = W.result_documents(rows, "tts_audio_segments", "index", "2026-01-01T00:00:00")
    return O.parse_result_documents(done, "synthesis").select("media_id", "index", F.round("duration", 6).alias("duration"), "is_empty")


# Texts.


@query
def bracket_texts(spark, sf_dir):
    """is_pure_bracket and clean_ass_text of cues, a part of which are set in brackets or marks."""
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("["), "text", F.lit("]"))).when(F.col("turn") % 4 == 1, F.concat(F.lit(r"{\i1}a\Nb "), "text")).otherwise(F.col("text"))
    rows = D.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce(text, F.lit("")))
    return rows.select("conv_id", "turn", T.is_pure_bracket(F.col("text")).alias("is_pure"), F.md5(T.clean_ass_text(F.col("text")).cast("binary")).alias("digest"))


# Work lists.


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.scan_media(D.listing(spark, sf_dir))


@query
def make_task_ids(spark, sf_dir):
    return P.make_task_ids(_media(spark, sf_dir)).select("path", "task_id")


@query
def plan_paths(spark, sf_dir):
    paths = P.plan_paths(_media(spark, sf_dir), "/out/")
    return paths.select("path", F.size("paths").alias("files"), F.col("paths")["processed_subtitle"].alias("subtitle"), F.col("paths")["final_video"].alias("final_video"))


@query
def match_task_names(spark, sf_dir):
    """The tasks of media files by name, asked for by the same names, some with marks between their characters."""
    tasks = P.make_task_ids(_media(spark, sf_dir)).select("task_id", "stem")
    number = F.regexp_extract("stem", "[0-9]+", 0).cast("int")
    names = tasks.select(F.when(number % 3 == 0, F.replace("stem", F.lit("clip"), F.lit("clip-"))).when(number % 3 == 1, F.concat("stem", F.lit("x"))).otherwise(F.col("stem")).alias("name"))
    return P.match_task_names(tasks, names.distinct())


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.retry_outcome(D.attempts(spark, sf_dir))


@query
def remaining_failures(spark, sf_dir):
    """Attempts that failed, without the segments that a later attempt recovered."""
    tries = D.attempts(spark, sf_dir)
    failed = tries.filter("not success").select("task_id", "segment").distinct()
    return P.remaining_failures(failed, _outcomes(spark, sf_dir).filter("success"))


@query
def retry_selection(spark, sf_dir):
    """Clips of the segments that failed in all attempts, tasks as media."""
    failed = _outcomes(spark, sf_dir).filter("not success").select(F.col("task_id").alias("media_id"), (F.col("segment") % 7 + 1).alias("index"))
    return P.retry_selection(D.clips(D.cues(spark, sf_dir)), failed).select("media_id", "index", "clip_us")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_task_state(D.status_events(spark, sf_dir))


@query
def clear_tasks(spark, sf_dir):
    states = _states(spark, sf_dir)
    return P.clear_tasks(states, states.filter("status = 'failed'")).select("task_id", "status")


@query
def batch_result_lookup(spark, sf_dir):
    """Tasks 0 to 24 as asked for, of which the log has twenty."""
    pairs = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("task_id"))
    return P.batch_result_lookup(pairs, _states(spark, sf_dir)).select("task_id", "status", "success")


@query
def validate_synth_files(spark, sf_dir):
    """Clips whose file is missing: those of a listing that has every third one."""
    name = F.concat(F.lit("/c/"), F.col("media_id").cast("string"), F.lit("_"), F.col("index").cast("string"))
    clips = D.clips(D.cues(spark, sf_dir)).withColumn("file_path", name)
    files = clips.filter((F.col("media_id") + F.col("index")) % 3 == 0).select(F.col("file_path").alias("path"))
    return P.validate_synth_files(clips, files).select("media_id", "index", "file_path")


@query
def union_task_states(spark, sf_dir):
    states = S.task_tracking(_states(spark, sf_dir)).drop("bucket")
    # Each task is active too, so that the later bucket has to win.
    done = [states.filter(F.col("status") == s) for s in ("completed", "failed")]
    return P.union_task_states(states, *done).select("task_id", "status", "bucket")


# Status.


@query
def task_tracking(spark, sf_dir):
    return S.task_tracking(_states(spark, sf_dir)).select("task_id", "status", "bucket")


@query
def task_progress(spark, sf_dir):
    return _steps(spark, sf_dir).select("task_id", "step_id", F.round(S.task_progress(F.col("step_id"), F.col("progress")), 6).alias("percent"))


@query
def task_summary(spark, sf_dir):
    return S.task_summary(_states(spark, sf_dir)).select("task_id", "status", "progress", "processing_seconds", "error_message", "bucket")


@query
def status_lookup(spark, sf_dir):
    """The status of one task, of one of its steps, of all its steps, and of all tasks that have completed that step."""
    return S.status_lookup(_states(spark, sf_dir), _steps(spark, sf_dir), 3, 2)


@query
def step_item_progress(spark, sf_dir):
    """A conversation's turns as items of a step: done, left and failed by their number."""
    item = F.col("turn")
    kinds = [("completed_items", item % 3 != 2), ("pending_items", (item % 3 == 2) & (item % 2 == 0)), ("failed_items", (item % 3 == 2) & (item % 2 == 1))]
    rows = D.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.collect_list(F.when(good, item)).alias(name) for name, good in kinds])
    return S.step_items(rows).select("conv_id", "is_completed", "is_partial", F.round("percent", 6).alias("percent"))


@query
def group_batch_updates(spark, sf_dir):
    rows = S.group_batch_updates(D.status_events(spark, sf_dir))
    return rows.select("task_id", F.size("updates").alias("n"), F.md5(F.array_join(F.transform("updates", lambda u: u["sequence"].cast("string")), ",").cast("binary")).alias("digest"))


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third task, and five that the log has not, as first-version documents that have completed as many steps as their number tells."""
    tasks = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("task_id")).filter("task_id % 3 = 0 or task_id >= 20")
    return tasks.withColumn("completed_steps", F.filter(F.sequence(F.lit(0), F.lit(7)), lambda s: s < F.col("task_id") % 8))


@query
def load_cached_status(spark, sf_dir):
    steps = _steps(spark, sf_dir).filter("task_id % 2 = 1")
    return S.load_cached_status(steps, _legacy(spark, sf_dir)).select("task_id", F.array_join("steps", ",").alias("steps"), "percent")


@query
def convert_legacy_tasks(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in O.STEPS for x in pair])
    done = F.struct(F.lit(True).alias("completed"), F.lit("2026-01-01").alias("completed_at"))
    steps = F.map_from_entries(F.transform("completed_steps", lambda s: F.struct(F.element_at(names, s).alias("key"), done.alias("value"))))
    docs = _legacy(spark, sf_dir).select(F.col("task_id").cast("string").alias("document"), steps.alias("completed_steps"), F.create_map(F.lit("video"), F.lit("v.mp4")).alias("file_paths"), F.lit("t").alias("updated_at"))
    return O.convert_legacy_tasks(docs).select("document", "current_step", "status", "progress", F.array_join("completed_steps", ",").alias("steps"))


@query
def cache_inventory(spark, sf_dir):
    tasks = _states(spark, sf_dir).select(F.col("task_id").alias("document"))
    steps = _steps(spark, sf_dir).select(F.col("task_id").alias("document"), "status", F.sequence(F.lit(1), F.col("step_id") + 1).alias("result_files"))
    return O.cache_inventory(tasks, steps)


@query
def step_status_upsert(spark, sf_dir):
    """The steps after the first half of the log, updated by those of the second."""
    events = D.status_events(spark, sf_dir)
    half = F.col("sequence") % 2 == 0
    columns = ["task_id", "step_id", "status", "error_message", "started_at"]
    old = S.fold_step_state(events.filter(half)).select(*columns)
    new = S.fold_step_state(events.filter(~half)).select("task_id", "step_id", "status", "error_message", F.col("updated_at").alias("event_time"))
    return W.upsert_step_status(old, new)


@query
def step_status_table(spark, sf_dir):
    """The same two halves as updates of a stored table, which keeps the first from being applied again."""
    events = D.status_events(spark, sf_dir)
    half = F.col("sequence") % 2 == 0
    time = events.schema["event_time"].dataType.simpleString()
    table = KeyedTable(spark, new_folder(spark, "steps"), f"task_id long, step_id int, status string, error_message string, started_at {time}", ["task_id", "step_id"], 8)
    old = S.fold_step_state(events.filter(half), True).select("task_id", "step_id", "status", "error_message", "started_at", "sequence")
    new = S.fold_step_state(events.filter(~half), True).select("task_id", "step_id", "status", "error_message", F.col("updated_at").alias("event_time"), "sequence")
    table.apply(old, 0, lambda stored, rows: rows.drop("sequence"))
    for _ in range(2):
        W.write_step_status(table, new, 1)
    return table.read()


@query
def status_absence(spark, sf_dir):
    """Tasks without an event for more than eight hours."""
    return S.absences(D.status_events(spark, sf_dir), ["task_id"], 8 * 3600)


@query
def merge_three_styles(spark, sf_dir):
    """Every media as a track of three styles, in runs."""
    rows = D.cues(spark, sf_dir)
    kind = (F.col("cue_no") * 7 + F.col("media_id")) % 11
    style = F.when(kind < 4, "top").when(kind < 8, "bottom").otherwise("middle")
    return R.merge_repeated_style(rows.withColumns({"style": style, "text": F.concat(F.lit("t"), "cue_no")})).select("media_id", "cue_no", "style", "end_us", "text")


@query
def pair_tracks(spark, sf_dir):
    """Each cue with the nearest within two seconds of the track that its clips make."""
    cues = D.cues(spark, sf_dir)
    other = R.retime(cues, D.clips(cues), "cumulative").select("media_id", "cue_no", F.col("new_start_us").alias("start_us"))
    return R.pair_tracks(cues, other)


@query
def merge_metadata(spark, sf_dir):
    """Two maps of a nation's fields, which share a key."""
    entry = lambda k, c: F.create_map(F.lit(k), F.col(c).cast("string"))
    rows = D.table(spark, sf_dir, "nation")
    old = F.map_concat(entry("name", "n_name"), entry("region", "n_regionkey"))
    new = F.when(F.col("n_nationkey") % 2 == 0, entry("name", "n_nationkey"))
    merged = S.merge_metadata(old, new)
    return rows.select("n_nationkey", F.element_at(merged, "name").alias("name"), F.element_at(merged, "region").alias("region"), F.size(merged).alias("keys"))


# Timelines and clips.


@query
def speed_analysis(spark, sf_dir):
    """From the cues and their re-timed track to the plan, in one call."""
    cues = D.cues(spark, sf_dir)
    moved = R.retime(cues, D.clips(cues), "cumulative")
    new = moved.select("media_id", "cue_no", F.col("new_start_us").alias("start_us"), F.col("new_end_us").alias("end_us"), "text")
    plan = L.speed_analysis(cues, new, D.media(cues), D.media(new))
    return plan.select("media_id", "seg_no", "kind", "target_start_us", "target_end_us", F.round("speed_ratio", 6).alias("speed_ratio"))


@query
def synth_requests(spark, sf_dir):
    cues = D.cues(spark, sf_dir).withColumn("text", F.when(F.col("cue_no") % 5 == 0, F.lit("  ")).otherwise(F.col("text")))
    refs = D.clips(cues).select("media_id", "index", F.concat(F.lit("ref_"), F.col("index").cast("string")).alias("file_path"))
    return L.synth_requests(cues, refs).select("media_id", "cue_no", "is_empty", "silence_us", "reference_file")


@query
def silence_samples(spark, sf_dir):
    cues = D.cues(spark, sf_dir)
    return cues.select("media_id", "cue_no", A.silence_samples(C.to_seconds(F.col("end_us") - F.col("start_us")) - 1.5, F.lit(16_000)).alias("samples"))


@query
def audio_file_info(spark, sf_dir):
    clips = D.audio(spark, sf_dir).select("index", F.concat(F.lit("f"), F.col("index").cast("string")).alias("file_path"))
    infos = D.audio(spark, sf_dir).filter("index % 4 <> 0").select(F.concat(F.lit("f"), F.col("index").cast("string")).alias("file_path"), "sample_rate", F.size("samples").alias("audio_length"), (F.col("index") * 10).alias("file_size"))
    return A.audio_file_info(clips, infos).select("index", "sample_rate", "audio_length", "file_size")


@query
def normalize_volume(spark, sf_dir):
    rows = D.audio(spark, sf_dir).withColumn("out", A.normalize_volume(F.col("samples"), centred=False))
    return rows.select("index", F.round(A.rms(F.col("out")), 6).alias("rms"), F.round(F.array_max("out"), 6).alias("peak"))


@query
def normalize_volume_centred(spark, sf_dir):
    """Frames of 32 samples, 8 apart, so that each clip has several."""
    rows = D.audio(spark, sf_dir).withColumn("out", A.normalize_volume(F.col("samples"), frame=32, hop=8))
    return rows.select("index", F.size(A.frame_levels(F.col("samples"), 32, 8)).alias("n_frames"), F.round(A.rms(F.col("out")), 6).alias("rms"), F.round(F.array_max("out"), 6).alias("peak"))


def _reference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two seconds of samples of each vector, by label, as the audio of a media; and cues of a second or so in it."""
    chunks = D.chunks(spark, sf_dir)
    cues = D.cues(spark, sf_dir).filter("media_id < 50").withColumn("start_us", F.expr("start_us div 4"))
    return chunks, cues.withColumn("end_us", F.col("start_us") + F.expr("(cue_no * 37 % 11) * 250000"))


@query
def cut_by_cue(spark, sf_dir):
    chunks, cues = _reference(spark, sf_dir)
    return A.cut_by_cue(chunks, cues, D.CHUNK_US).select("media_id", "cue_no", F.size("samples").alias("n"), F.round(A.rms(F.col("samples")), 6).alias("rms"))


@query
def reference_segments(spark, sf_dir):
    chunks, cues = _reference(spark, sf_dir)
    rows = A.reference_segments(chunks, cues, D.CHUNK_US, centred=False)
    return rows.select("media_id", "index", "duration", "is_silence", "replaced_with", "audio_length", F.round("quality_score", 6).alias("quality_score"), F.round(A.rms(F.col("samples")), 5).alias("rms"))


@query
def reference_summary(spark, sf_dir):
    chunks, cues = _reference(spark, sf_dir)
    return A.reference_summary(cues, A.reference_segments(chunks, cues, D.CHUNK_US, centred=False))
