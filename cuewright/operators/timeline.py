"""Timelines: what is played when, segments without holes, and by how much each is sped up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .retime import before, by_cue
from .walks import clocked

#: Silence shorter than this is not inserted; a segment shorter than SHORT joins the one before.
TOLERANCE_US, SHORT_US = 10_000, 300_000


def by_segment() -> WindowSpec:
    return Window.partitionBy("media_id").orderBy("seg_no")


def sort_cues(cues: DataFrame) -> DataFrame:
    """Cues with `place`, their order by start; cues that start together keep the order that they had."""
    return cues.withColumn("place", F.row_number().over(Window.partitionBy("media_id").orderBy("start_us", "cue_no")))


def sort_segments(segments: DataFrame) -> DataFrame:
    """Segments numbered from 0 in the order of their start, and end."""
    return segments.withColumn("seg_no", F.row_number().over(Window.partitionBy("media_id").orderBy("start_us", "end_us", "kind")) - 1)


def cue_audio_lookup(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """Cues with the clip of their number; of several the shortest, for a fixed order."""
    own = clips.groupBy("media_id", F.col("index").alias("cue_no")).agg(F.min(F.struct("clip_us", "is_empty")).alias("clip"))
    return cues.join(own, ["media_id", "cue_no"], "left")


def playout_timeline(cues: DataFrame, clips: DataFrame, tolerance_us: int = TOLERANCE_US) -> DataFrame:
    """media_id, seg_no, start_us, end_us, is_silence, kind, cue_no, text: cues in order, each at its start or, where what went before
    lasts longer, right after it; silence up to a cue where more than the tolerance is missing.

    kind: gap, clip, or missing (silence of a cue's length for a clip that isn't there). The clock of walks.clocked() is carried from cue to cue, also
    where a media's cues lie in several tasks.
    """
    rows = cue_audio_lookup(cues, clips)
    silent, own = F.coalesce("clip.is_empty", F.lit(True)), F.coalesce("clip.clip_us", F.col("end_us") - F.col("start_us"))
    rows = rows.select("media_id", "cue_no", "start_us", own.alias("own_us"), "text", F.col("clip").isNull().alias("missing"), silent.alias("silent"), F.lit(tolerance_us).cast("long").alias("margin_us"))
    played = clocked(rows, ["media_id"], ["cue_no"], "start_us", "own_us", "margin_us", 0, numbered=True).withColumnRenamed("before_us", "now_us")

    def segment(start: Column, end: Column, silence: Column, kind: Column) -> Column:
        return F.struct(start.alias("start_us"), end.alias("end_us"), silence.alias("is_silence"), kind.alias("kind"))

    until = F.col("at_us") + F.col("own_us")
    clip = segment(F.col("at_us"), until, F.col("silent"), F.when(F.col("missing"), "missing").otherwise("clip"))
    gap = segment(F.col("now_us"), F.col("at_us"), F.lit(True), F.lit("gap"))
    parts = F.when(F.col("at_us") > F.col("now_us"), F.array(gap, clip)).otherwise(F.array(clip))
    parts = played.select("media_id", "cue_no", "text", "number", F.posexplode(parts).alias("place", "of"))
    return parts.select("media_id", (F.col("number") + F.col("place")).cast("int").alias("seg_no"), "of.*", "cue_no", "text")


def playout_starts(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """media_id, cue_no, play_us: the starts of playout_timeline() without a tolerance, by windows alone.

    A cue starts at P + max(s - P') over the cues up to it, where P' is the length of all clips before each and P before it.
    """
    rows = cue_audio_lookup(cues, clips).withColumn("own_us", F.coalesce("clip.clip_us", F.col("end_us") - F.col("start_us")))
    rows = rows.withColumn("before_us", F.coalesce(F.sum("own_us").over(before()), F.lit(0)))
    lead = F.greatest(F.max(F.col("start_us") - F.col("before_us")).over(by_cue().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.select("media_id", "cue_no", (F.col("before_us") + lead).alias("play_us"))


def timeline_summary(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("media_id").agg(F.count("*").alias("segments"), F.count_if("is_silence").alias("silent"), F.count_if(~F.col("is_silence")).alias("spoken"), F.max("end_us").alias("duration_us"))


def align_texts(timeline: DataFrame, cues: DataFrame, by: str = "position") -> DataFrame:
    """Played segments with the text of a cue. position: the i-th that isn't silent with the i-th cue, up to the shorter list, so
    silent cues shift all later texts; index: by the number of the cue that was played."""
    spoken = timeline.filter("not is_silence")
    if by == "index":
        texts = cues.select("media_id", "cue_no", F.col("text").alias("cue_text"))
        return spoken.join(texts, ["media_id", "cue_no"]).select("media_id", "cue_no", "start_us", "end_us", "cue_text")
    place = F.row_number().over(by_segment())
    texts = cues.select("media_id", F.row_number().over(by_cue()).alias("place"), F.col("text").alias("cue_text"))
    joined = spoken.withColumn("place", place).join(texts, ["media_id", "place"])
    return joined.select("media_id", F.col("place").alias("cue_no"), "start_us", "end_us", "cue_text")


def fill_gaps(cues: DataFrame, media: DataFrame) -> DataFrame:
    """media_id, seg_no, kind, cue_no, start_us, end_us, duration_us: before each cue the gap to it (the first is a prefix, and gaps may be
    zero or less), and a suffix where the media is at least as long as its cues."""
    last_end = F.lag("end_us", 1, 0).over(by_cue())
    rows = cues.withColumns({"from_us": last_end, "first": F.row_number().over(by_cue()) == 1, "final": F.lead("cue_no").over(by_cue()).isNull()})
    rows = rows.join(media.select("media_id", "duration_us"), "media_id", "left")

    def part(rank: int, kind: Column, start: Column, end: Column, cue: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), kind.alias("kind"), cue.alias("of_cue"), start.alias("from"), end.alias("to"))

    none = F.lit(None).cast("int")
    gap = part(0, F.when(F.col("first"), "prefix").otherwise("gap"), F.col("from_us"), F.col("start_us"), none)
    own = part(1, F.lit("subtitle"), F.col("start_us"), F.col("end_us"), F.col("cue_no"))
    tail = part(2, F.lit("suffix"), F.col("end_us"), F.col("duration_us"), none)
    parts = F.when(F.col("final") & (F.col("duration_us") >= F.col("end_us")), F.array(gap, own, tail)).otherwise(F.array(gap, own))
    flat = rows.select("media_id", "cue_no", F.explode(parts).alias("p")).select("media_id", F.col("cue_no").alias("by"), "p.*")
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("by", "rank")) - 1
    return flat.select("media_id", number.alias("seg_no"), "kind", F.col("of_cue").alias("cue_no"), F.col("from").alias("start_us"), F.col("to").alias("end_us"), (F.col("to") - F.col("from")).alias("duration_us"))


def merge_segments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Segments of both tracks by position: new_* of the new one where both are cues or both are not, copied where one side is
    missing, null where the kinds disagree."""
    fields = ["kind", "cue_no", "start_us", "end_us", "duration_us"]
    a = old.select("media_id", "seg_no", *[F.col(f).alias(f"a_{f}") for f in fields])
    b = new.select("media_id", "seg_no", *[F.col(f).alias(f"b_{f}") for f in fields])
    both = a.join(b, ["media_id", "seg_no"], "full_outer")
    speech = lambda side: F.col(f"{side}_kind") == "subtitle"
    agree = F.col("a_kind").isNull() | F.col("b_kind").isNull() | (speech("a") == speech("b"))
    out = [F.coalesce(f"a_{f}", f"b_{f}").alias(f) for f in fields]
    out += [F.when(agree, F.coalesce(f"b_{f}", f"a_{f}")).alias(f"new_{f}") for f in ("start_us", "end_us", "duration_us")]
    return both.select("media_id", "seg_no", *out)


def coalesce_short(segments: DataFrame, short_us: int = SHORT_US) -> DataFrame:
    """Segments shorter than short_us, before or after (a missing new length counts as 0), joined to the one kept before; the
    first is always kept, and kinds are those of the kept ones."""
    new = F.coalesce("new_duration_us", F.lit(0))
    short = (F.col("duration_us") < short_us) | (new < short_us)
    keep = (F.row_number().over(by_segment()) == 1) | ~short
    rows = segments.withColumn("island", F.sum(keep.cast("int")).over(by_segment()))
    merged = rows.groupBy("media_id", "island").agg(
        F.min_by("kind", "seg_no").alias("kind"), F.min_by("cue_no", "seg_no").alias("cue_no"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.min("new_start_us").alias("new_start_us"), F.max("new_end_us").alias("new_end_us"), F.count("*").alias("parts"),
    )
    return merged.select(
        "media_id", (F.col("island") - 1).cast("int").alias("seg_no"), "kind", "cue_no", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        "new_start_us", "new_end_us", (F.col("new_end_us") - F.col("new_start_us")).alias("new_duration_us"), "parts",
    )


def speed_plan(segments: DataFrame) -> DataFrame:
    """Segments with speed_ratio, old over new length (1 where the new is not over 0 but the old is, else 0), and the running target times.
    A missing new length counts as the segment's own."""
    new = F.coalesce("new_duration_us", "duration_us")
    ratio = F.when(new > 0, F.round(F.col("duration_us") / new, 8)).when(F.col("duration_us") > 0, 1.0).otherwise(0.0)
    rows = segments.withColumns({"target_us": new, "speed_ratio": ratio})
    end = F.sum("target_us").over(by_segment().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("target_end_us", end).withColumn("target_start_us", F.col("target_end_us") - F.col("target_us"))


def speed_commands(plan: DataFrame) -> DataFrame:
    """Segments that change their speed: ratios over 0, times 0.99 unless exactly 1, and not within 0.01 of 1; pts = 1 / ratio."""
    applied = F.when(F.col("speed_ratio") == 1, 1.0).otherwise(F.col("speed_ratio") * 0.99)
    rows = plan.filter("speed_ratio > 0").withColumn("applied", applied).filter(F.abs(F.col("applied") - 1) >= 0.01)
    return rows.select("media_id", "seg_no", "applied", (1 / F.col("applied")).alias("pts"))


def speed_analysis(old_cues: DataFrame, new_cues: DataFrame, old_media: DataFrame, new_media: DataFrame) -> DataFrame:
    """From both tracks to the plan."""
    return speed_plan(coalesce_short(merge_segments(fill_gaps(old_cues, old_media), fill_gaps(new_cues, new_media))))


def concat_quality(plan: DataFrame, actual: DataFrame) -> DataFrame:
    """Per media: planned against actual length (actual_us), their difference, accuracy in per cent, an alert over 1 s, sped-up segments."""
    planned = plan.groupBy("media_id").agg(F.sum("target_us").alias("planned_us"), F.count_if(F.col("speed_ratio") != 1).alias("sped_up"))
    rows = planned.join(actual, "media_id", "left").withColumn("off_us", F.abs(F.col("planned_us") - F.col("actual_us")))
    accuracy = F.when(F.col("planned_us") > 0, F.greatest(F.lit(0.0), (1 - F.col("off_us") / F.col("planned_us")) * 100))
    return rows.withColumns({"accuracy": accuracy, "alert": F.col("off_us") > 1_000_000})


def mux_plan(media: DataFrame, played: DataFrame) -> DataFrame:
    """Per media the final length, the longer of video and audio, and which side is padded by how much."""
    rows = media.select("media_id", F.col("duration_us").alias("video_us")).join(played.select("media_id", F.col("duration_us").alias("audio_us")), "media_id")
    side = F.when(F.col("video_us") < F.col("audio_us"), "video").when(F.col("audio_us") < F.col("video_us"), "audio").otherwise("none")
    return rows.select("media_id", "video_us", "audio_us", F.greatest("video_us", "audio_us").alias("final_us"), side.alias("padded"), F.abs(F.col("video_us") - F.col("audio_us")).alias("pad_us"))


def mix_plan(timeline: DataFrame, sample_rate: int) -> DataFrame:
    """Sample offsets of every segment in its track, cut off at the track's end."""
    track = F.floor(F.max("end_us").over(Window.partitionBy("media_id")) * sample_rate / 1_000_000)
    start = F.floor(F.col("start_us") * sample_rate / 1_000_000)
    size = F.floor((F.col("end_us") - F.col("start_us")) * sample_rate / 1_000_000)
    rows = timeline.select("media_id", "seg_no", track.alias("track_samples"), start.alias("from_sample"), size.alias("size"))
    return rows.select("media_id", "seg_no", "track_samples", "from_sample", F.least(F.col("from_sample") + F.col("size"), F.col("track_samples")).alias("to_sample"))


def synth_requests(cues: DataFrame, references: DataFrame) -> DataFrame:
    """A request for each cue with text, with its reference file; a blank cue is silence of its length instead."""
    rows = cues.join(references.select("media_id", F.col("index").alias("cue_no"), "file_path"), ["media_id", "cue_no"], "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return rows.select("media_id", "cue_no", "text", blank.alias("is_empty"), F.when(blank, F.col("end_us") - F.col("start_us")).alias("silence_us"), F.when(~blank, F.col("file_path")).alias("reference_file"))
