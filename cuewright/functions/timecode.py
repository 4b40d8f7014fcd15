"""Time columns: five written grammars, microseconds, and float seconds where the grammar of a consumer needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000

# Fixed formats.
PATTERNS = {
    "srt": r"^(\d{2}):(\d{2}):(\d{2}),(\d{3})",
    "ass": r"^(\d+):(\d{2}):(\d{2})\.(\d{2})",
    "vtt": r"^(\d{2}):(\d{2}):(\d{2})\.(\d{3})",
    "lrc": r"^\[(\d{2}):(\d{2})\.(\d{2})\]",
    "sbv": r"^(\d+):(\d{2}):(\d{2})\.(\d{3})",
}


def parse_time(text: Column, fmt: str) -> Column:
    """Microseconds of a written time, or null. What follows the time is ignored, hours count modulo 24, and minutes or
    seconds over 59 make it null."""
    pattern, text = PATTERNS[fmt], F.trim(text)
    group = lambda k: F.regexp_extract(text, pattern, k).cast("bigint")
    parts = [F.lit(0).cast("bigint"), group(1), group(2), group(3)] if fmt == "lrc" else [group(k) for k in range(1, 5)]
    hours, minutes, seconds, rest = parts
    micros = rest * (10_000 if fmt in ("ass", "lrc") else 1_000)
    total = (hours % 24) * HOUR + minutes * MINUTE + seconds * SECOND + micros
    return F.when(text.rlike(pattern) & (minutes < 60) & (seconds < 60), total)


def _part(us: Column, size: int, of: int) -> Column:
    return F.floor(F.pmod(us, F.lit(of)) / size).cast("int")


def format_time(us: Column, fmt: str) -> Column:
    """A written time; fractions are cut off, and times wrap at 24 hours."""
    us = F.pmod(us, F.lit(DAY))
    h, m, s = _part(us, HOUR, DAY), _part(us, MINUTE, HOUR), _part(us, SECOND, MINUTE)
    ms, cs = _part(us, 1_000, SECOND), _part(us, 10_000, SECOND)
    if fmt == "srt":
        return F.format_string("%02d:%02d:%02d,%03d", h, m, s, ms)
    if fmt == "ass":
        return F.format_string("%d:%02d:%02d.%02d", h, m, s, cs)
    if fmt in ("vtt", "sbv"):
        return F.format_string("%02d:%02d:%02d.%03d", h, m, s, ms)
    if fmt == "lrc":
        return F.format_string("[%02d:%02d.%02d]", h * 60 + m, s, cs)
    micros = _part(us, 1, SECOND)
    return F.concat(F.format_string("%02d:%02d:%02d", h, m, s), F.when(micros > 0, F.format_string(".%06d", micros)).otherwise(""))


def to_seconds(us: Column) -> Column:
    return us / F.lit(1e6)


def from_seconds(seconds: Column) -> Column:
    """Microseconds of a clock of 24 hours; negative seconds wrap, and microseconds are cut off."""
    whole = F.floor(seconds)
    return F.pmod(whole, F.lit(86_400)) * SECOND + F.floor((seconds - whole) * 1_000_000)


def seconds_to_srt(seconds: Column) -> Column:
    """A written time from float seconds, with the milliseconds of the float cut off (2.3 prints ,299)."""
    h, m = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return F.format_string("%02d:%02d:%02d,%03d", h.cast("int"), m.cast("int"), F.floor(seconds % 60).cast("int"), F.floor((seconds % 1) * 1000).cast("int"))


def duration(start: Column, end: Column) -> Column:
    return end - start


def shift_time(cues: DataFrame, offset_us: int) -> DataFrame:
    """Moves both ends of every cue; the clock wraps at 24 hours."""
    return cues.withColumns({c: F.pmod(F.col(c) + offset_us, F.lit(DAY)) for c in ("start_us", "end_us")})


def scale_time(cues: DataFrame, factor: float) -> DataFrame:
    """Multiplies both ends of every cue."""
    return cues.withColumns({c: F.pmod(F.floor(F.col(c) * F.lit(factor)), F.lit(DAY)) for c in ("start_us", "end_us")})


def valid_cue() -> Column:
    return (F.col("start_us") < F.col("end_us")) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def drop_invalid_times(cues: DataFrame, audio: bool = False) -> DataFrame:
    """Cues that end after they start, and for audio do not start before 0."""
    good = F.col("start_us") < F.col("end_us")
    return cues.filter(good & (F.col("start_us") >= 0) if audio else good)


def same_time_group(a: Column, b: Column, tolerance_us: int = 2 * SECOND) -> Column:
    return F.abs(a - b) < tolerance_us
