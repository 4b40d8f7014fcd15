"""Cue tables as subtitle files, and result documents.

A file is rendered inside Spark: blocks are columns, and a media's blocks are joined in the order of its cues. The result is
a row (media_id, content) for each media, written as one text file each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import format_time
from . import subtitles as R
from .keyed import KeyedTable, Merge

# The beginning of an ASS file.
ASS_HEADER = """[Script Info]
ScriptType: v4.00+

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, \
ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,10,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def _span(fmt: str, between: str) -> Column:
    return F.concat(format_time(F.col("start_us"), fmt), F.lit(between), format_time(F.col("end_us"), fmt))


def _joined(cues: DataFrame, block: Column, header: str = "", between: str = "", end: str = "") -> DataFrame:
    """One content for each media. A media's cues are thousands at most."""
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("cue_no"))
    blocks = cues.withColumn("no", number).select("media_id", "no", block.alias("block"))
    own = F.array_sort(F.collect_list(F.struct("no", "block")))
    content = F.concat(F.lit(header), F.array_join(F.transform(own, lambda x: x["block"]), between), F.lit(end))
    return blocks.groupBy("media_id").agg(content.alias("content"))


def render_srt(cues: DataFrame, trailing: bool = False) -> DataFrame:
    """Blocks numbered from 1 with an empty line between them, or with `trailing` after each."""
    block = F.concat(F.col("no").cast("string"), F.lit("\n"), _span("srt", " --> "), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(cues, block, between="\n", end="\n" * trailing)


def render_vtt(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat(_span("vtt", " --> "), F.lit("\n"), F.col("text"), F.lit("\n\n")), "WEBVTT\n\n")


def render_ass(cues: DataFrame) -> DataFrame:
    style = F.coalesce(F.nullif("style", F.lit("")), F.lit("Default"))
    fields = F.concat_ws(",", F.lit("0"), _span("ass", ","), style, F.coalesce("actor", F.lit("")), F.lit("0,0,0,"), F.replace(F.col("text"), F.lit("\n"), F.lit("\\N")))
    return _joined(cues, F.concat(F.lit("Dialogue: "), fields, F.lit("\n")), ASS_HEADER)


def render_lrc(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat(format_time(F.col("start_us"), "lrc"), F.col("text"), F.lit("\n")))


def render_sbv(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat(_span("sbv", ","), F.lit("\n"), F.col("text"), F.lit("\n\n")))


def render_txt(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat(F.col("text"), F.lit("\n")))


RENDERERS = {"srt": render_srt, "vtt": render_vtt, "ass": render_ass, "ssa": render_ass, "lrc": render_lrc, "sbv": render_sbv, "txt": render_txt}


def write_subtitles(cues: DataFrame, folder: str, fmt: str) -> None:
    """Writes one text file for each media, below folder/media_id=…; no cues at all is an error."""
    if cues.isEmpty():
        raise ValueError("no cues to write")
    files = RENDERERS[fmt](cues)
    files.write.partitionBy("media_id").option("lineSep", "\n").text(folder)


def convert_format(files: DataFrame, fmt: str) -> DataFrame:
    """path and content of each readable file in another format; text and times only, but for ASS."""
    cues = R.read_subtitles(files).withColumnRenamed("path", "media_id")
    return RENDERERS[fmt](cues).withColumnRenamed("media_id", "path")


def extract_style_to_srt(files: DataFrame, style: str) -> DataFrame:
    """path and SRT content of one style of ASS files; files without it give no row."""
    return render_srt(R.read_ass_style(files, style).withColumnRenamed("path", "media_id")).withColumnRenamed("media_id", "path")


def result_documents(rows: DataFrame, name: str, order: str, saved_at: str, version: str = "1.0") -> DataFrame:
    """One JSON document for each media: its rows, floats rounded to 8 places, as an array by `order`."""
    fields = [(F.round(c, 8) if t == "double" else F.col(c)).alias(c) for c, t in rows.dtypes if c != "media_id"]
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*fields).alias("_row"))))
    listed = rows.groupBy("media_id").agg(F.transform(own, lambda x: x["_row"]).alias(name))
    document = F.struct(F.lit(True).alias("success"), F.col(name), F.lit(saved_at).alias("saved_at"), F.lit(version).alias("file_version"))
    return listed.select("media_id", F.to_json(document).alias("document"))


def write_results_json(rows: DataFrame, folder: str, name: str, order: str, saved_at: str) -> None:
    """Writes the documents as JSON lines, partitioned by media."""
    result_documents(rows, name, order, saved_at).select("media_id", F.col("document").alias("value")).write.partitionBy("media_id").text(folder)


def upsert_step_status(current: DataFrame, updates: DataFrame) -> DataFrame:
    """The step table after partial updates: a null in an update leaves the old value, the first `processing` sets started_at (to that of the update, if
    it has one, or else to its event_time)."""
    keys = ["task_id", "step_id"]
    fresh = updates.select(*keys, *[F.col(c).alias(f"new_{c}") for c in updates.columns if c not in keys])
    joined = current.join(fresh, keys, "full_outer")
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == "started_at":
            begins = F.col("new_started_at") if "started_at" in updates.columns else F.when(F.col("new_status") == "processing", F.col("new_event_time"))
            out.append(F.coalesce(c, begins).alias(c))
        else:
            out.append((F.coalesce(f"new_{c}", c) if f"new_{c}" in fresh.columns else F.col(c)).alias(c))
    return joined.select(*out)


def fold_updates(updates: DataFrame, keys: list[str], order: str = "sequence") -> DataFrame:
    """One update for each key: of each column the latest value that is not null, and as started_at the time of the first `processing`."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in updates.columns if c not in keys and c != "started_at"]
    first = F.min_by("event_time", F.when(F.col("status") == "processing", F.col(order)))
    return updates.groupBy(*keys).agg(*latest, first.alias("started_at"))


def write_step_status(table: KeyedTable, updates: DataFrame, batch: int, writer: str = "main") -> bool:
    """Applies partial updates (task_id, step_id, status, event_time, sequence and others) to a stored step table, each batch once; false if it was there."""
    return table.apply(fold_updates(updates, table.keys), batch, upsert_step_status, writer)


def _newer(strictly: bool, kept: list[str]) -> Merge:
    """States of a later sequence in place of the stored ones; of `kept` columns a null leaves the stored value."""

    def merge(current: DataFrame, states: DataFrame) -> DataFrame:
        keys = ["task_id", "step_id"]
        fresh = states.select(*keys, *[F.col(c).alias(f"new_{c}") for c in current.columns if c not in keys], F.lit(True).alias("is_new"))
        joined = current.withColumn("is_old", F.lit(True)).join(fresh, keys, "full_outer")
        ahead = F.col("new_sequence") > F.col("sequence") if strictly else F.col("new_sequence") >= F.col("sequence")
        wins = F.col("is_new").isNotNull() & (F.col("is_old").isNull() | ahead)
        return joined.select(*keys, *[F.when(wins, F.coalesce(f"new_{c}", c) if c in kept else F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns if c not in keys])

    return merge


#: A snapshot is the whole state of a step; a critical event tells its status at once, and a snapshot of the same sequence tells more.
merge_snapshots, merge_critical = _newer(False, []), _newer(True, ["current_item", "total_items", "error_message", "started_at"])
