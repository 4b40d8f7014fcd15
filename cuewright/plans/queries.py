"""The registered queries: each operator over the driver's tables by way of the adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import text as T
from ..functions import timecode as C
from ..operators import pairing as P
from ..operators import progress as S
from ..operators import retime as R
from ..operators import timeline as L
from ..sources import sinks as W
from ..sources import subtitles as Q
from . import adapters as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _cues_and_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cues = D.cues(spark, sf_dir)
    return cues, D.clips(cues)


# Cues and re-timing.


@query
def cue_gaps(spark, sf_dir):
    return R.cue_gaps(D.cues(spark, sf_dir)).select("media_id", "cue_no", "gap_us")


@query
def cue_summary(spark, sf_dir):
    return D.cues(spark, sf_dir).groupBy("media_id").agg(F.count("*").alias("cues"), F.max("end_us").alias("last_end_us"))


@query
def time_formats(spark, sf_dir):
    times = {f: C.format_time(F.col("start_us"), f) for f in ("srt", "ass", "vtt", "lrc", "sbv")}
    return D.cues(spark, sf_dir).select("media_id", "cue_no", *[t.alias(f) for f, t in times.items()])


@query
def shifted_cues(spark, sf_dir):
    rows = C.drop_invalid_times(C.shift_time(D.cues(spark, sf_dir), -2_500_000), audio=True)
    return rows.select("media_id", "cue_no", "start_us", "end_us")


def _retime(strategy: str) -> Query:
    def run(spark, sf_dir):
        return R.retime(*_cues_and_clips(spark, sf_dir), strategy).select("media_id", "cue_no", "strategy", "new_start_us", "new_end_us")

    return run


for _name in ("proportional", "cumulative", "gap_preserving", "adaptive"):
    QUERIES[f"retime_{_name}"] = _retime(_name)


@query
def choose_retiming(spark, sf_dir):
    rows = R.choose_retiming(R.attach_durations(*_cues_and_clips(spark, sf_dir)))
    return rows.select("media_id", F.round("avg_ratio", 6).alias("avg_ratio"), F.round("var_ratio", 6).alias("var_ratio"), "strategy")


@query
def duration_change_stats(spark, sf_dir):
    rows = R.duration_change_stats(*_cues_and_clips(spark, sf_dir))
    return rows.select("media_id", "cues", "old_total_us", "new_total_us", "found", "missing", *[F.round(c, 6).alias(c) for c in ("avg_ratio", "min_ratio", "max_ratio", "change_percent")])


@query
def sync_track_times(spark, sf_dir):
    cues, clips = _cues_and_clips(spark, sf_dir)
    corrected = R.retime(cues, clips, "cumulative").select("media_id", "cue_no", F.col("new_start_us").alias("start_us"), F.col("new_end_us").alias("end_us"))
    return R.sync_track_times(cues, corrected, "user").select("media_id", "cue_no", "start_us", "end_us")


@query
def merge_repeated_style(spark, sf_dir):
    """Every media as a track of two styles, in runs of up to four."""
    rows = D.cues(spark, sf_dir)
    style = F.when((F.col("cue_no") * 7 + F.col("media_id")) % 5 < 3, "top").otherwise("bottom")
    return R.merge_repeated_style(rows.withColumns({"style": style, "text": F.concat(F.lit("t"), "cue_no")})).select("media_id", "cue_no", "style", "end_us", "text")


# Timelines.


@query
def playout_timeline(spark, sf_dir):
    return L.playout_timeline(*_cues_and_clips(spark, sf_dir)).select("media_id", "seg_no", "start_us", "end_us", "is_silence", "kind")


@query
def playout_starts(spark, sf_dir):
    return L.playout_starts(*_cues_and_clips(spark, sf_dir))


@query
def timeline_summary(spark, sf_dir):
    return L.timeline_summary(L.playout_timeline(*_cues_and_clips(spark, sf_dir)))


@query
def align_by_position(spark, sf_dir):
    cues, clips = _cues_and_clips(spark, sf_dir)
    return L.align_texts(L.playout_timeline(cues, clips), cues)


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments of the original track and of the re-timed one."""
    cues, clips = _cues_and_clips(spark, sf_dir)
    new = R.retime(cues, clips, "cumulative").select("media_id", "cue_no", F.col("new_start_us").alias("start_us"), F.col("new_end_us").alias("end_us"))
    return L.fill_gaps(cues, D.media(cues)), L.fill_gaps(new, D.media(new))


@query
def fill_gaps(spark, sf_dir):
    return _tracks(spark, sf_dir)[0]


@query
def merge_segments(spark, sf_dir):
    return L.merge_segments(*_tracks(spark, sf_dir))


@query
def coalesce_short(spark, sf_dir):
    return L.coalesce_short(L.merge_segments(*_tracks(spark, sf_dir)))


@query
def speed_plan(spark, sf_dir):
    rows = L.speed_plan(L.coalesce_short(L.merge_segments(*_tracks(spark, sf_dir))))
    return rows.select("media_id", "seg_no", "kind", "target_start_us", "target_end_us", F.round("speed_ratio", 6).alias("speed_ratio"))


@query
def speed_commands(spark, sf_dir):
    rows = L.speed_commands(L.speed_plan(L.coalesce_short(L.merge_segments(*_tracks(spark, sf_dir)))))
    return rows.select("media_id", "seg_no", F.round("applied", 5).alias("applied"), F.round("pts", 4).alias("pts"))


@query
def concat_quality(spark, sf_dir):
    cues, clips = _cues_and_clips(spark, sf_dir)
    plan = L.speed_plan(L.coalesce_short(L.merge_segments(*_tracks(spark, sf_dir))))
    actual = L.timeline_summary(L.playout_timeline(cues, clips)).select("media_id", F.col("duration_us").alias("actual_us"))
    return L.concat_quality(plan, actual).select("media_id", "planned_us", "actual_us", "off_us", "alert", "sped_up", F.round("accuracy", 5).alias("accuracy"))


@query
def mux_plan(spark, sf_dir):
    cues, clips = _cues_and_clips(spark, sf_dir)
    return L.mux_plan(D.media(cues), L.timeline_summary(L.playout_timeline(cues, clips)))


@query
def mix_plan(spark, sf_dir):
    return L.mix_plan(L.playout_timeline(*_cues_and_clips(spark, sf_dir)), 16_000)


# Formats: what is written is read again.


def _files(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """The cues with texts of one line, rendered: a file for each media."""
    cues = D.cues(spark, sf_dir).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return W.RENDERERS[fmt](cues).select(F.concat(F.col("media_id").cast("string"), F.lit(f".{fmt}")).alias("path"), "content")


def _read(fmt: str, reader) -> Query:
    def run(spark, sf_dir):
        rows = reader(_files(spark, sf_dir, fmt))
        return rows.select(F.substring_index("path", ".", 1).cast("bigint").alias("media_id"), "cue_no", "start_us", "end_us", "text", "style")

    return run


for _fmt in ("srt", "vtt", "sbv", "lrc", "txt", "ass"):
    QUERIES[f"{_fmt}_roundtrip"] = _read(_fmt, Q.READERS[f".{_fmt}"])
QUERIES["srt_lines"] = _read("srt", lambda files: Q.read_srt(files, "line"))


@query
def ass_styles(spark, sf_dir):
    return Q.list_ass_styles(_files(spark, sf_dir, "ass")).select(F.substring_index("path", ".", 1).cast("bigint").alias("media_id"), F.array_join("styles", ",").alias("styles"))


@query
def convert_format(spark, sf_dir):
    """SRT to SBV to VTT."""
    once = W.convert_format(_files(spark, sf_dir, "srt"), "sbv").withColumn("path", F.regexp_replace("path", "srt$", "sbv"))
    twice = W.convert_format(once, "vtt")
    return twice.select(F.substring_index("path", ".", 1).cast("bigint").alias("media_id"), F.md5(F.col("content").cast("binary")).alias("digest"))


# Text.


def _text(name: str, **columns: Callable[[Column], Column]) -> None:
    def run(spark, sf_dir):
        text = F.col("text")
        return D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[f(text).alias(c) for c, f in columns.items()])

    QUERIES[name] = run


def _digest(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: F.md5(fn(text).cast("binary"))


_text("detect_language", language=T.detect_language)
_text("strip_brackets", digest=_digest(lambda t: T.strip_brackets(F.regexp_replace(t, r"\s+", " "))))
_text("fix_numbers", digest=_digest(T.fix_numbers))
_text("spell_symbols", digest=_digest(T.spell_symbols))
_text("replace_terms", digest=_digest(T.replace_terms))
_text("space_capitals", digest=_digest(T.space_capitals))
_text("basic_clean", digest=_digest(T.basic_clean))
_text("percent_to_words", digest=_digest(T.percent_to_words))
_text("dash_to_words", digest=_digest(T.dash_to_words))
_text("map_punctuation", digest=_digest(T.map_punctuation))
_text("expand_contractions", digest=_digest(T.expand_contractions))
_text("split_sentences", pieces=lambda t: F.size(T.split_sentences(t)), longest=lambda t: F.coalesce(F.array_max(F.transform(T.split_sentences(t), F.char_length)), F.lit(0)))
_text("split_punctuation", pieces=lambda t: F.size(T.split_punctuation(t)))
_text("validate_text", is_valid=lambda t: T.validate_text(t)["is_valid"], error_message=lambda t: T.validate_text(t)["error_message"])


@query
def split_length(spark, sf_dir):
    rows = D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.split_length(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("pieces"), F.md5(F.array_join("p", "|").cast("binary")).alias("digest"))


@query
def process_text(spark, sf_dir):
    done = D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.process_text(F.col("text"), longest=300).alias("r"))
    return done.select("doc_id", "r.language", "r.is_valid", "r.error_message", F.size("r.segments").alias("pieces"), F.md5(F.col("r.cleaned").cast("binary")).alias("digest"))


@query
def text_stats(spark, sf_dir):
    done = D.spread(D.table(spark, sf_dir, "documents").select("text")).select(T.process_text(F.col("text"), longest=300).alias("r"))
    good = F.count_if("r.is_valid")
    return done.agg(F.count("*").alias("processed"), (F.count("*") - good).alias("errors"), F.when(F.count("*") > 0, good / F.count("*")).otherwise(0.0).alias("success_rate"))


@query
def preprocess_cues(spark, sf_dir):
    """Cues that are cleaned for speech, with the first piece of each."""
    cues = D.spread(C.drop_invalid_times(D.cues(spark, sf_dir)).select("media_id", "cue_no", "text"))
    rows = cues.withColumn("r", T.process_text(F.col("text"), "sentence", 300))
    return rows.select("media_id", "cue_no", F.md5(F.coalesce(F.get("r.segments", F.lit(0)), F.lit("")).cast("binary")).alias("digest"), F.col("r.is_valid").alias("is_valid"))


@query
def strip_html(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(T.strip_html(F.col("html")), r"\s+", " ")).cast("binary")).alias("digest"))


@query
def sanitize_name(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", T.sanitize_name(F.col("url")).alias("name"))


# Files.


@query
def scan_media(spark, sf_dir):
    return Q.scan_media(D.listing(spark, sf_dir))


@query
def supported_formats(spark, sf_dir):
    return Q.filter_supported_format(D.listing(spark, sf_dir))


@query
def pair_media_subtitles(spark, sf_dir):
    return P.pair_media_subtitles(D.listing(spark, sf_dir))


@query
def unmatched_media(spark, sf_dir):
    return P.unmatched_media(D.listing(spark, sf_dir))


@query
def match_prefix(spark, sf_dir):
    return P.match_subtitle_prefix(D.listing(spark, sf_dir))


# Clips of audio.


@query
def audio_measures(spark, sf_dir):
    s = F.col("samples")
    rows = D.audio(spark, sf_dir).withColumn("trimmed", A.trim_silence(s))
    return rows.select("index", F.size("trimmed").alias("trimmed"), F.round(A.rms(s), 6).alias("rms"), F.round(A.silence_ratio(s), 6).alias("silence_ratio"), A.is_silence(s).alias("is_silence"), F.round(A.quality_score(s, F.col("sample_rate")), 6).alias("quality_score"))


@query
def best_segment(spark, sf_dir):
    return A.best_segment(A.measured(D.audio(spark, sf_dir))).select("media_id", "index", F.round("quality_score", 6).alias("quality_score"))


@query
def replace_silent(spark, sf_dir):
    rows = A.replace_silent(A.measured(D.audio(spark, sf_dir)))
    return rows.select("media_id", "index", "is_silence", "replaced_with", F.round("quality_score", 6).alias("quality_score"), "audio_length")


@query
def classify_failures(spark, sf_dir):
    rows = D.failures(spark, sf_dir).select(T.classify_failure(F.col("message")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("failures"))


# The status log.


@query
def route_events(spark, sf_dir):
    return S.route_events(D.status_events(spark, sf_dir)).groupBy("queue", "event_type").agg(F.count("*").alias("events"))


@query
def critical_events(spark, sf_dir):
    return S.critical_events(D.status_events(spark, sf_dir)).select("sequence", "task_id", "event_type")


@query
def dedup_events(spark, sf_dir):
    """Windows of one and four days, as the events are minutes apart."""
    day = 86_400_000
    return S.dedup_events(D.status_events(spark, sf_dir), day, 4 * day).select("sequence", "task_id", "event_type", "step_id")


@query
def throttle_progress(spark, sf_dir):
    return S.throttle_progress(D.status_events(spark, sf_dir), 2 * 86_400_000).select("sequence", "task_id", "step_id")


@query
def fold_step_state(spark, sf_dir):
    return S.fold_step_state(D.status_events(spark, sf_dir))


@query
def fold_task_state(spark, sf_dir):
    return S.fold_task_state(D.status_events(spark, sf_dir))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_step_state(D.status_events(spark, sf_dir))


@query
def status_lattice(spark, sf_dir):
    return S.status_lattice(D.status_events(spark, sf_dir), by_priority=True)


@query
def step_status_summary(spark, sf_dir):
    return S.step_status_summary(_steps(spark, sf_dir))


@query
def completed_steps(spark, sf_dir):
    return S.completed_steps(_steps(spark, sf_dir)).select("task_id", F.array_join("steps", ",").alias("steps"))


@query
def resume_point(spark, sf_dir):
    return S.resume_point(_steps(spark, sf_dir))


@query
def start_step(spark, sf_dir):
    return S.start_step(_steps(spark, sf_dir))


@query
def reset_after_failure(spark, sf_dir):
    return S.reset_after_failure(_steps(spark, sf_dir)).select("task_id", "step_id", "status")


@query
def overall_status(spark, sf_dir):
    return S.overall_status(_steps(spark, sf_dir))


@query
def queue_stats(spark, sf_dir):
    return S.queue_stats(D.status_events(spark, sf_dir))


@query
def processor_stats(spark, sf_dir):
    """Completions and failures of a step as runs, their event's counter as seconds."""
    rows = D.status_events(spark, sf_dir).filter("step_id is not null and kind in ('completed', 'failed')")
    runs = rows.select("step_id", "sequence", (F.col("kind") == "completed").alias("success"), F.col("current_item").cast("double").alias("seconds"))
    return S.processor_stats(runs, 50).select("step_id", "processed", "succeeded", "failed", "min_seconds", "max_seconds", F.round("avg_seconds", 6).alias("avg_seconds"), F.round("success_rate", 6).alias("success_rate"))


@query
def resource_hold_stats(spark, sf_dir):
    rows = S.resource_hold_stats(D.resource_log(spark, sf_dir))
    return rows.select("resource_type", "acquired", "most_held", "max_hold_us", F.round("avg_hold_us", 3).alias("avg_hold_us"))


@query
def retry_outcome(spark, sf_dir):
    return S.retry_outcome(D.attempts(spark, sf_dir))


@query
def synth_summary(spark, sf_dir):
    rows = S.synth_summary(S.retry_outcome(D.attempts(spark, sf_dir)))
    return rows.withColumn("failed_segments", F.array_join("failed_segments", ","))


@query
def retry_flow(spark, sf_dir):
    return S.retry_flow(D.status_events(spark, sf_dir)).select("sequence", "task_id", "retry", "action")


@query
def task_flow(spark, sf_dir):
    return S.task_flow(D.status_events(spark, sf_dir))


@query
def scheduler_stats(spark, sf_dir):
    return S.scheduler_stats(S.fold_task_state(D.status_events(spark, sf_dir)))


@query
def batch_summary(spark, sf_dir):
    return S.batch_summary(S.fold_task_state(D.status_events(spark, sf_dir)))


@query
def system_stats(spark, sf_dir):
    return S.system_stats(D.status_events(spark, sf_dir))


@query
def status_health(spark, sf_dir):
    return S.status_health(D.status_events(spark, sf_dir), "1 day", 20).select("from_time", "tasks", "events", "alert")


@query
def dependency_check(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    return P.dependency_check(steps.select("task_id", "step_id"), steps)


@query
def skip_completed(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    return P.skip_completed(steps.select("task_id", "step_id"), steps)


@query
def resume_plan(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    return P.resume_plan(steps.select("task_id", "step_id"), steps).select("task_id", "step_id", "action")


from . import file_queries, record_queries  # noqa: E402, F401
