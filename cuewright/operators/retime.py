"""Moving cues to the lengths of their clips, and one track's times onto another.

All windows of a chain share partitionBy(media_id).orderBy(cue_no), so Spark plans one exchange and one sort for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_cue() -> WindowSpec:
    return Window.partitionBy("media_id").orderBy("cue_no")


def whole() -> WindowSpec:
    return Window.partitionBy("media_id")


def before() -> WindowSpec:
    return by_cue().rowsBetween(Window.unboundedPreceding, -1)


#: Bounds of a calm change of lengths, and of its mean ratio.
CALM, NEAR = 0.1, (0.8, 1.2)


def attach_durations(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """Cues with new_us, the length of their clip (their own where there is none), and has_clip. Of clips of one index the first counts."""
    own = clips.groupBy("media_id", F.col("index").alias("cue_no")).agg(F.min("clip_us").alias("clip_us"))
    joined = cues.join(own, ["media_id", "cue_no"], "left")
    length = F.col("end_us") - F.col("start_us")
    return joined.withColumns({"old_us": length, "new_us": F.coalesce("clip_us", length), "has_clip": F.col("clip_us").isNotNull()}).drop("clip_us")


def gap_after() -> Column:
    """Microseconds between a cue's end and the next one's start, never negative; 0 after the last."""
    return F.greatest(F.lead("start_us").over(by_cue()) - F.col("end_us"), F.lit(0))


def cue_gaps(cues: DataFrame) -> DataFrame:
    return cues.withColumn("gap_us", F.coalesce(gap_after(), F.lit(0)))


def choose_retiming(lengths: DataFrame) -> DataFrame:
    """media_id, avg_ratio, var_ratio (of the population) and the strategy that they call for; cues of no length don't count."""
    ratio = F.when(F.col("old_us") > 0, F.col("new_us") / F.col("old_us"))
    stats = lengths.groupBy("media_id").agg(F.avg(ratio).alias("avg_ratio"), F.var_pop(ratio).alias("var_ratio"))
    calm = F.col("var_ratio") < CALM
    strategy = F.when(calm & F.col("avg_ratio").between(*NEAR), "gap_preserving").when(calm, "proportional").otherwise("cumulative")
    return stats.withColumn("strategy", strategy)


def retime(cues: DataFrame, clips: DataFrame, strategy: str = "adaptive") -> DataFrame:
    """Cues with new_start_us and new_end_us: lengths of the clips, one after another from 0, with the gaps between them
    times a factor: new over old total (proportional: no rows where the old is 0; gap_preserving: then 1), or 1 (cumulative).
    Any other strategy chooses by media as choose_retiming() does."""
    rows = cue_gaps(attach_durations(cues, clips))
    ratio = F.when(F.col("old_us") > 0, F.col("new_us") / F.col("old_us"))
    if strategy in ("proportional", "cumulative", "gap_preserving"):
        rows = rows.withColumn("strategy", F.lit(strategy))
    else:
        calm, mean = F.var_pop(ratio).over(whole()) < CALM, F.avg(ratio).over(whole())
        rows = rows.withColumn("strategy", F.when(calm & mean.between(*NEAR), "gap_preserving").when(calm, "proportional").otherwise("cumulative"))
    old, new = F.sum("old_us").over(whole()), F.sum("new_us").over(whole())
    rows = rows.withColumns({"old_total": old, "new_total": new})
    rows = rows.filter((F.col("strategy") != "proportional") | (F.col("old_total") > 0))
    scaled = F.floor(F.col("gap_us") * F.col("new_total") / F.col("old_total"))
    gap = F.when((F.col("strategy") == "cumulative") | (F.col("old_total") == 0), F.col("gap_us")).otherwise(scaled)
    rows = rows.withColumn("step_us", F.col("new_us") + gap)
    start = F.coalesce(F.sum("step_us").over(before()), F.lit(0))
    out = rows.withColumn("new_start_us", start).withColumn("new_end_us", F.col("new_start_us") + F.col("new_us"))
    return out.select("media_id", "cue_no", "text", "style", "actor", "strategy", "new_start_us", "new_end_us")


def duration_change_stats(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """Per media: totals before and after, the change in per cent, ratios, and how many clips there are."""
    rows = attach_durations(cues, clips)
    ratio = F.when(F.col("old_us") > 0, F.col("new_us") / F.col("old_us"))
    stats = rows.groupBy("media_id").agg(
        F.count("*").alias("cues"), F.sum("old_us").alias("old_total_us"), F.sum("new_us").alias("new_total_us"),
        F.avg(ratio).alias("avg_ratio"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"),
        F.count_if("has_clip").alias("found"), F.count_if(~F.col("has_clip")).alias("missing"),
    )
    change = F.when(F.col("old_total_us") > 0, (F.col("new_total_us") - F.col("old_total_us")) * 100.0 / F.col("old_total_us")).otherwise(0.0)
    return stats.withColumn("change_percent", change)


def sync_track_times(track: DataFrame, corrected: DataFrame, style: str) -> DataFrame:
    """Rows of a track of several styles with the times of the corrected cue whose ordinal is the number of rows of the
    reference style before it; rows past the last corrected cue keep theirs."""
    ordinal_of = F.coalesce(F.sum((F.col("style") == style).cast("int")).over(before()), F.lit(0))
    ordinal = F.row_number().over(by_cue()) - 1
    times = corrected.select("media_id", ordinal.alias("ordinal"), F.col("start_us").alias("at_us"), F.col("end_us").alias("until_us"))
    joined = track.withColumn("ordinal", ordinal_of).join(times, ["media_id", "ordinal"], "left")
    return joined.withColumns({"start_us": F.coalesce("at_us", "start_us"), "end_us": F.coalesce("until_us", "end_us")}).drop("at_us", "until_us", "ordinal")


def _joined_texts(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(", "), b)).when(b != "", b).otherwise(a)


def merge_repeated_style(cues: DataFrame) -> DataFrame:
    """A track where a style does not follow itself: of a run of one style every second row goes, its text joins the latest kept
    row of the other style, whose end (and that of the row before it) becomes its own.

    The other style is the first by name of the media that isn't the row's own. A media of one style is left as it is. Where no row of the
    other style comes before, the row before is kept once, with its end as it was.
    """
    turns = F.coalesce((F.col("style") != F.lag("style").over(by_cue())).cast("int"), F.lit(1))
    rows = cues.withColumns({"run": F.sum(turns).over(by_cue()), "first_style": F.min("style").over(whole())})
    second = F.min(F.when(F.col("style") > F.col("first_style"), F.col("style"))).over(whole())
    place = F.row_number().over(Window.partitionBy("media_id", "run").orderBy("cue_no")) - 1
    rows = rows.withColumns({"second_style": second, "folded": place % 2 == 1})
    # The latest kept row of each of the two styles that can be another row's other style.
    latest = {f"last_{n}": F.last(F.when(~F.col("folded") & (F.col("style") == F.col(f"{n}_style")), F.col("cue_no")), True).over(before()) for n in ("first", "second")}
    rows = rows.withColumns(latest).withColumn("target", F.when(F.col("style") == F.col("first_style"), F.col("last_second")).otherwise(F.col("last_first")))
    next_end = F.when(F.lead(F.col("folded") & F.col("target").isNotNull()).over(by_cue()), F.lead("end_us").over(by_cue()))
    single = F.col("second_style").isNull()
    folds = rows.filter("folded and target is not null").groupBy("media_id", F.col("target").alias("cue_no")).agg(
        F.max_by("end_us", "cue_no").alias("far_us"), F.array_sort(F.collect_list(F.struct(F.col("cue_no").alias("at"), "text"))).alias("more")
    )
    kept = rows.withColumn("next_end", next_end).filter(single | ~F.col("folded")).join(folds, ["media_id", "cue_no"], "left")
    texts = F.aggregate("more", F.col("text"), lambda t, x: _joined_texts(t, x["text"]))
    merged = {"text": F.when(F.col("more").isNotNull(), texts).otherwise(F.col("text")), "end_us": F.coalesce("far_us", "next_end", "end_us")}
    return kept.withColumns(merged).select(cues.columns)


def pair_tracks(track: DataFrame, other: DataFrame, tolerance_us: int = 2_000_000) -> DataFrame:
    """media_id, cue_no, other_no, off_us: each cue of a track with the cue of another track of its media that starts nearest to it, less than the
    tolerance away, and how much later that starts; nulls where there is none. Of two as near the earlier, of cues that start together the first by number.

    A stretch of a media as long as the tolerance is put in order by itself, with the other track's starts of the stretches beside it, so that a
    media may be many tasks and no pairs are made.
    """
    starts = other.groupBy("media_id", "start_us").agg(F.min("cue_no").alias("other_no"))
    stretch = F.floor(F.col("start_us") / F.lit(tolerance_us))
    near = starts.select("media_id", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"), F.col("start_us").alias("at_us"), "other_no", F.lit(None).cast(track.schema["cue_no"].dataType).alias("cue_no"))
    own = track.select("media_id", stretch.alias("stretch"), F.col("start_us").alias("at_us"), F.lit(None).cast(other.schema["cue_no"].dataType).alias("other_no"), "cue_no")
    order = Window.partitionBy("media_id", "stretch").orderBy("at_us")
    start = F.when(F.col("other_no").isNotNull(), F.struct("at_us", "other_no"))
    behind, ahead = F.last(start, True).over(order.rangeBetween(Window.unboundedPreceding, 0)), F.first(start, True).over(order.rangeBetween(0, Window.unboundedFollowing))
    rows = near.unionByName(own).withColumns({"behind": behind, "ahead": ahead}).filter("cue_no is not null")
    before_us, after_us = F.col("at_us") - F.col("behind.at_us"), F.col("ahead.at_us") - F.col("at_us")
    found = F.when(F.coalesce(before_us <= after_us, after_us.isNull()), F.col("behind")).otherwise(F.col("ahead"))
    rows = rows.withColumn("found", found).withColumn("off_us", F.col("found.at_us") - F.col("at_us"))
    good = F.abs("off_us") < tolerance_us
    return rows.select("media_id", "cue_no", F.when(good, F.col("found.other_no")).alias("other_no"), F.when(good, F.col("off_us")).alias("off_us"))
