"""Media and their subtitles, and work lists against what is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import STEPS
from ..sources.subtitles import SUBTITLE_EXTENSIONS, VIDEO_EXTENSIONS


def split_path(files: DataFrame) -> DataFrame:
    """Files with dir, stem and lower-case ext of their path."""
    name = F.substring_index("path", "/", -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return files.withColumns({"dir": F.regexp_replace("path", r"/[^/]*$", ""), "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "ext": ext})


def _preference(ext: Column) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in SUBTITLE_EXTENSIONS]), ext)


def _sides(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = split_path(files.select("path").distinct())
    return parts.filter(F.col("ext").isin(VIDEO_EXTENSIONS)), parts.filter(F.col("ext").isin(SUBTITLE_EXTENSIONS))


def _ranked(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = ["dir", "stem"]
    media, subtitles = _sides(files)
    media = media.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("path")))
    order = Window.partitionBy(*key).orderBy(_preference(F.col("ext")), "path")
    return media, subtitles.withColumn("rank", F.row_number().over(order)).select(*key, "rank", F.col("path").alias("subtitle"))


def pair_media_subtitles(files: DataFrame) -> DataFrame:
    """media, subtitle: files of one folder and stem, by path on one side and preference of the format on the other; each is used once."""
    media, subtitles = _ranked(files)
    return media.join(subtitles, ["dir", "stem", "rank"]).select(F.col("path").alias("media"), "subtitle")


def unmatched_media(files: DataFrame) -> DataFrame:
    media, subtitles = _ranked(files)
    return media.join(subtitles, ["dir", "stem", "rank"], "left_anti").select(F.col("path").alias("media"))


def match_subtitle_prefix(files: DataFrame) -> DataFrame:
    """media, subtitle: of the same stem by preference, else the first file whose stem begins with the media's, else null."""
    media, subtitles = _sides(files)
    order = F.struct(_preference(F.col("ext")).alias("p"), F.col("path"))
    exact = subtitles.groupBy("dir", "stem").agg(F.min(order).alias("s")).select("dir", "stem", F.col("s.path").alias("exact"))
    first = media.join(exact, ["dir", "stem"], "left")
    # Subtitles meet media on the beginnings of their stems, of the lengths that are looked for (a file name's at most), not on the folder.
    rest = first.filter("exact is null").select("dir", "stem").distinct()
    lengths = F.broadcast(rest.select(F.length("stem").alias("n")).distinct())
    longer = subtitles.select("dir", F.col("stem").alias("longer"), F.col("path").alias("other")).join(lengths, F.col("n") <= F.length("longer"))
    near = longer.groupBy("dir", F.expr("substring(longer, 1, n)").alias("stem")).agg(F.min("other").alias("near"))
    return first.join(near, ["dir", "stem"], "left").select(F.col("path").alias("media"), F.coalesce("exact", "near").alias("subtitle"))


def match_task_names(tasks: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) with the task (task_id, stem) of that stem, or else of the same word characters."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\W", "")
    by_name = tasks.groupBy("stem").agg(F.min("task_id").alias("task_id"))
    by_word = tasks.groupBy(bare("stem").alias("word")).agg(F.min("task_id").alias("near_id"))
    rows = names.join(by_name, names.name == by_name.stem, "left").withColumn("word", bare("name")).join(by_word, "word", "left")
    return rows.select("name", F.coalesce("task_id", "near_id").alias("task_id"))


def make_task_ids(files: DataFrame, prefix: str = "task") -> DataFrame:
    """Media paths with task_id, prefix, ordinal of three digits within the folder, and stem."""
    number = F.row_number().over(Window.partitionBy("dir").orderBy("path")) - 1
    return split_path(files).withColumn("task_id", F.format_string("%s_%03d_%s", F.lit(prefix), number.cast("int"), F.col("stem")))


# What each derived file of a media is called, behind folder/stem/.
PATHS = {
    "processed_subtitle": "processed/{}.srt", "silent_video": "media/{}_silent.mp4", "vocal_audio": "media/{}_vocal.wav", "background_audio": "media/{}_background.wav",
    "reference_audio": "reference/{}", "reference_results": "reference/{}_results.json", "synthesis": "synthesis/{}", "synthesis_results": "synthesis/{}_results.json",
    "aligned_audio": "aligned/{}_aligned.wav", "aligned_results": "aligned/{}_results.json", "aligned_srt": "aligned/{}_aligned.srt", "adjusted_video": "video/{}_adjusted.mp4",
    "final_video": "{}_final.mp4", "task_state": "state/task_state.json", "step_status": "state/step_status.json", "metadata": "state/metadata.json",
}


def plan_paths(media: DataFrame, root: str) -> DataFrame:
    """Media paths with a map of the files that are derived from each."""
    rows = split_path(media)
    base = F.concat(F.lit(root.rstrip("/") + "/"), F.col("stem"), F.lit("/"))
    pairs = [x for k, p in PATHS.items() for x in (F.lit(k), F.concat(base, F.replace(F.lit(p), F.lit("{}"), F.col("stem"))))]
    return rows.withColumn("paths", F.create_map(*pairs)).drop("dir", "ext")


def retry_selection(segments: DataFrame, failed: DataFrame) -> DataFrame:
    """Segments whose index is on the list of failed ones."""
    return segments.join(failed.select("media_id", "index").distinct(), ["media_id", "index"], "left_semi")


def skip_completed(work: DataFrame, done: DataFrame) -> DataFrame:
    """Work rows (task_id, step_id) without those that are completed."""
    return work.join(done.filter("status = 'completed'").select("task_id", "step_id").distinct(), ["task_id", "step_id"], "left_anti")


def remaining_failures(failed: DataFrame, recovered: DataFrame) -> DataFrame:
    return failed.join(recovered.select("task_id", "segment").distinct(), ["task_id", "segment"], "left_anti")


def clear_tasks(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("task_id").distinct(), "task_id", "left_anti")


def resume_plan(work: DataFrame, status: DataFrame) -> DataFrame:
    """Work rows with what to do: skip what is completed, resume what is processing, clear and run what failed, run the rest."""
    joined = work.join(status.select("task_id", "step_id", "status"), ["task_id", "step_id"], "left")
    action = F.when(F.col("status") == "completed", "skip").when(F.col("status") == "processing", "resume").when(F.col("status") == "failed", "clear_and_run").otherwise("run")
    return joined.withColumn("action", action)


def step_dimension(df: DataFrame) -> DataFrame:
    """The eight steps; always eight rows."""
    return df.sparkSession.createDataFrame(STEPS, "step_id int, step_name string")


def dependency_check(work: DataFrame, status: DataFrame) -> DataFrame:
    """Work rows (task_id, step_id) with may_run: all lower steps of the task are completed."""
    steps = F.broadcast(step_dimension(work).select(F.col("step_id").alias("lower")))
    done = status.filter("status = 'completed'").select("task_id", F.col("step_id").alias("lower"), F.lit(True).alias("ok"))
    needed = work.join(steps, F.col("lower") < F.col("step_id"), "left").join(done, ["task_id", "lower"], "left")
    return needed.groupBy("task_id", "step_id").agg(F.bool_and(F.col("lower").isNull() | F.coalesce("ok", F.lit(False))).alias("may_run"))


def batch_result_lookup(pairs: DataFrame, states: DataFrame) -> DataFrame:
    """Requested pairs with the state of their task; one without a state is a failure."""
    joined = pairs.join(states, "task_id", "left")
    return joined.withColumns({"success": F.coalesce(F.col("status") == "completed", F.lit(False)), "status": F.coalesce("status", F.lit("missing"))})


def validate_synth_files(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments with sound whose file isn't there."""
    return segments.filter("not is_empty").join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")


def union_task_states(active: DataFrame, completed: DataFrame, failed: DataFrame) -> DataFrame:
    """One row for each task; of several buckets the later one counts."""
    parts = [df.withColumns({"bucket": F.lit(name), "rank": F.lit(i)}) for i, (name, df) in enumerate([("active", active), ("completed", completed), ("failed", failed)])]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    last = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("rank")))
    return rows.withColumn("no", last).filter("no = 1").drop("no", "rank")
