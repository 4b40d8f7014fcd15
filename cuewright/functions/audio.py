"""Array columns of samples: silence, loudness and the quality of a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timecode import drop_invalid_times

QUIET = 0.01
SILENT_RMS, SILENT_SHARE = 0.005, 0.8


def _total(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + x)


def rms(samples: Column) -> Column:
    """Root of the mean square; null for no samples."""
    squares = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(samples) > 0, F.sqrt(squares / F.size(samples)))


def silence_ratio(samples: Column, quiet: float = QUIET) -> Column:
    return F.when(F.size(samples) > 0, F.size(F.filter(samples, lambda x: F.abs(x) < quiet)) / F.size(samples))


def is_silence(samples: Column) -> Column:
    return F.coalesce((rms(samples) < SILENT_RMS) | (silence_ratio(samples) > SILENT_SHARE), F.lit(True))


def trim_silence(samples: Column, quiet: float = QUIET) -> Column:
    """Without the samples up to the first and after the last that is louder; all of them where none is."""
    loud = F.transform(samples, lambda x: F.abs(x) > quiet)
    first, last = F.array_position(loud, True), F.size(samples) - F.array_position(F.reverse(loud), True) + 1
    return F.when(first > 0, F.slice(samples, first.cast("int"), (last - first + 1).cast("int"))).otherwise(samples)


def quality_score(samples: Column, sample_rate: Column) -> Column:
    """0.3 of duration, 0.3 of volume, 0.2 of range and 0.2 of what isn't silent, 1 at most; 0 for no samples."""
    n = F.size(samples)
    seconds = n / sample_rate
    duration = F.when(seconds.between(0.5, 3.0), 1.0).when(seconds < 0.5, seconds / 0.5).otherwise(F.greatest(F.lit(0.1), 3.0 / seconds))
    loud = F.transform(samples, F.abs)
    spread = F.array_max(loud) - _total(loud) / n
    volume, reach = F.least(F.lit(1.0), rms(samples) / 0.1), F.least(F.lit(1.0), spread / 0.5)
    heard = F.greatest(F.lit(0.1), 1.0 - silence_ratio(samples))
    return F.when(n > 0, F.least(F.lit(1.0), duration * 0.3 + volume * 0.3 + reach * 0.2 + heard * 0.2)).otherwise(0.0)


def frame_levels(samples: Column, frame: int = 2048, hop: int = 512, centred: bool = True) -> Column:
    """Loudness of frames a hop apart. Centred frames have their middle at each hop, and what lies outside of the clip counts as silence; others
    begin at each hop, and the last ones are cut short."""
    n = F.size(samples)
    if not centred:
        return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(hop)), lambda i: rms(F.slice(samples, i, frame)))
    squares = lambda a, b: F.aggregate(F.slice(samples, a + 1, F.greatest(b - a, F.lit(0))), F.lit(0.0), lambda s, x: s + x * x)
    middles = F.sequence(F.lit(0), n, F.lit(hop))
    return F.transform(middles, lambda i: F.sqrt(squares(F.greatest(i - frame // 2, F.lit(0)), F.least(i + frame // 2, n)) / frame))


def normalize_volume(samples: Column, target: float = 0.15, frame: int = 2048, hop: int = 512, centred: bool = True) -> Column:
    """Samples times target over the mean loudness of the frames that are heard (a gain of 0.1 to 10), softly limited."""
    levels = F.filter(frame_levels(samples, frame, hop, centred), lambda x: x > 0)
    mean = F.when(F.size(levels) > 0, _total(levels) / F.size(levels))
    gain = F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.lit(target) / mean))
    return F.when(mean.isNull(), samples).otherwise(F.transform(samples, lambda x: F.tanh(x * gain * 0.95) * 0.95))


def cut(samples: Column, sample_rate: Column, start_us: Column, end_us: Column) -> Column:
    """The samples from floor(start * rate) up to, not with, floor(end * rate), within what there is."""
    a = F.greatest(F.floor(start_us * sample_rate / 1_000_000), F.lit(0))
    b = F.least(F.floor(end_us * sample_rate / 1_000_000), F.size(samples).cast("bigint"))
    return F.slice(samples, (F.least(a, b) + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


def cut_by_cue(chunks: DataFrame, cues: DataFrame, chunk_us: int) -> DataFrame:
    """Samples of each cue from chunk rows (media_id, chunk_no, sample_rate, samples) of chunk_us each.

    A cue is dealt to the chunks that it touches first, so the join is on media_id and chunk_no.
    """
    touched = F.sequence(F.floor(F.col("start_us") / chunk_us), F.floor((F.greatest("end_us", F.col("start_us") + 1) - 1) / chunk_us))
    dealt = cues.select("media_id", "cue_no", "start_us", "end_us", F.explode(touched).alias("chunk_no"))
    joined = dealt.join(chunks, ["media_id", "chunk_no"])
    base = F.col("chunk_no") * chunk_us
    part = cut(F.col("samples"), F.col("sample_rate"), F.col("start_us") - base, F.col("end_us") - base)
    parts = joined.select("media_id", "cue_no", F.col("sample_rate"), F.struct("chunk_no", part.alias("samples")).alias("part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["samples"]))
    return parts.groupBy("media_id", "cue_no").agg(F.max("sample_rate").alias("sample_rate"), whole.alias("samples"))


def measured(clips: DataFrame) -> DataFrame:
    """Clips (media_id, index, samples, sample_rate) with their length, silence and quality."""
    samples = F.col("samples")
    silent = is_silence(samples)
    return clips.withColumns({
        "audio_length": F.size(samples), "is_silence": silent,
        "quality_score": F.when(silent, 0.0).otherwise(quality_score(samples, F.col("sample_rate"))),
    })


def best_segment(clips: DataFrame) -> DataFrame:
    """Per media the clip of the highest quality that isn't silent, the first of equals."""
    heard = clips.filter("not is_silence")
    best = F.max_by(F.struct("index", "quality_score", "audio_length"), F.struct("quality_score", -F.col("index")))
    return heard.groupBy("media_id").agg(best.alias("best")).select("media_id", "best.*")


def replace_silent(clips: DataFrame) -> DataFrame:
    """Silent clips with quality and length of their media's best, and its index in replaced_with; without one they stay."""
    heard = F.when(~F.col("is_silence"), F.struct("quality_score", (-F.col("index")).alias("order"), "audio_length"))
    best = F.max(heard).over(Window.partitionBy("media_id"))
    rows = clips.withColumn("best", best)
    swap = F.col("is_silence") & F.col("best").isNotNull()
    return rows.withColumns({
        "quality_score": F.when(swap, F.col("best.quality_score")).otherwise(F.col("quality_score")),
        "audio_length": F.when(swap, F.col("best.audio_length")).otherwise(F.col("audio_length")),
        "replaced_with": F.when(swap, -F.col("best.order")), "is_silence": F.col("is_silence") & ~swap,
    }).drop("best")


def reference_segments(chunks: DataFrame, cues: DataFrame, chunk_us: int, normalize: bool = True, centred: bool = True) -> DataFrame:
    """The reference clip of each cue: cut from the media's chunks, measured, of even volume, and where it is silent that of the best one.

    Volume is measured over frames that are centred or begin at each hop. Cues that don't end after they start, or start before 0, have none. A cue beyond the end of the audio has no samples and is silent.
    """
    good = drop_invalid_times(cues, audio=True)
    found = cut_by_cue(chunks, good, chunk_us).select("media_id", "cue_no", "sample_rate", "samples")
    clips = good.join(found, ["media_id", "cue_no"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<double>")))
    clips = measured(clips.select("media_id", F.col("cue_no").alias("index"), "text", "start_us", "end_us", "sample_rate", "samples"))
    if normalize:
        clips = clips.withColumn("samples", F.when(F.col("is_silence"), F.col("samples")).otherwise(normalize_volume(F.col("samples"), centred=centred)))
    return replace_silent(clips.withColumn("duration", F.round((F.col("end_us") - F.col("start_us")) / 1e6, 3)))


def reference_summary(cues: DataFrame, clips: DataFrame) -> DataFrame:
    asked = cues.groupBy("media_id").agg(F.count("*").alias("requested"))
    got = clips.groupBy("media_id").agg(F.count("*").alias("produced"), F.count_if(F.col("is_silence")).alias("silent"), F.count("replaced_with").alias("replaced"))
    return asked.join(got, "media_id", "left").fillna(0)


def silence_samples(seconds: Column, sample_rate: Column, floor: float = 0.01) -> Column:
    return F.floor(sample_rate * F.greatest(F.lit(floor), seconds)).cast("bigint")


def audio_file_info(segments: DataFrame, infos: DataFrame, rate: int = 44_100) -> DataFrame:
    """Segments with sample_rate, audio_length and file_size of their file; defaults where there is none."""
    joined = segments.join(infos, "file_path", "left")
    return joined.withColumns({"sample_rate": F.coalesce("sample_rate", F.lit(rate)), "audio_length": F.coalesce("audio_length", F.lit(0)), "file_size": F.coalesce("file_size", F.lit(0))})
