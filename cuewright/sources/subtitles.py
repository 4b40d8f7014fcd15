"""Subtitle files as cue tables.

A file is a row (path, content); every reader turns a table of files into cues with explode and column functions, so files
are read side by side. Cues keep the order of their file as cue_no, from 1. SRT, SBV, LRC and plain text are numbered within their file's array
and shuffle nothing; WebVTT, ASS and SRT by lines look back over lines, or sort, in windows by path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import SECOND, format_time, parse_time

# Fixed formats: extensions and their names.
FORMATS = {
    ".srt": "SubRip Text", ".ass": "Advanced SubStation Alpha", ".ssa": "SubStation Alpha", ".vtt": "WebVTT", ".sub": "MicroDVD/SubViewer", ".lrc": "LRC Lyrics",
    ".sbv": "YouTube SBV", ".smi": "SAMI", ".sami": "SAMI", ".ttml": "Timed Text Markup Language", ".dfxp": "Distribution Format Exchange Profile", ".txt": "Plain Text",
}
VIDEO_EXTENSIONS = ["mp4", "avi", "mov", "mkv", "wmv", "flv", "m4v", "webm", "ts"]
SUBTITLE_EXTENSIONS = ["srt", "ass", "ssa", "sub", "vtt"]
_NO_CUES = [".smi", ".sami", ".ttml", ".dfxp"]


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", "modificationTime")


def scan_media(files: DataFrame) -> DataFrame:
    """The video files of a listing, each path once."""
    return files.filter(F.ltrim(extension(F.col("path")), F.lit(".")).isin(VIDEO_EXTENSIONS)).dropDuplicates(["path"])


def filter_supported_format(files: DataFrame) -> DataFrame:
    """Files of a known subtitle format, with the name of it."""
    names = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return files.withColumn("format", F.element_at(names, extension(F.col("path")))).filter("format is not null")


def decode_text(content: Column) -> Column:
    """Text of bytes: UTF-8 (without a byte-order mark), else GBK, else ISO-8859-1. The session needs javaCharsets."""
    plain = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    gbk = F.decode(content, "GBK")
    return F.when(F.is_valid_utf8(plain.cast("string")), F.decode(plain, "UTF-8")).when(F.encode(gbk, "GBK") == content, gbk).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and decoded content, with line ends as \\n, of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.regexp_replace(decode_text(F.col("content")), r"\r\n?", "\n").alias("content"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    return rows.withColumn("cue_no", number).select("path", "cue_no", "start_us", "end_us", "text", "style", "actor")


def _blocks(pattern: str) -> Column:
    """The lines of each block of a content, as an array of arrays."""
    return F.transform(F.split(T.strip(F.col("content")), pattern), lambda b: F.split(T.strip(b), "\n"))


def _timed(blocks: Column, line: int, sep: str, fmt: str, exact: bool = True) -> Column:
    """start_us, end_us and text of the blocks with two times (or more, if not exact) in this line, from 0; the text is what stands below it."""
    parts = F.transform(blocks, lambda b: F.struct(F.split(F.get(b, F.lit(line)), sep, -1).alias("times"), _rest(b, line + 2).alias("text")))
    parts = F.filter(parts, lambda p: F.size(p["times"]) == 2 if exact else F.size(p["times"]) >= 2)
    return F.transform(parts, lambda p: F.struct(parse_time(p["times"][0], fmt).alias("start_us"), parse_time(p["times"][1], fmt).alias("end_us"), p["text"].alias("text")))


def _numbered_within(files: DataFrame, cues: Column) -> DataFrame:
    """Cues from an array of start_us, end_us and text for each file, numbered in its order; those without a time are left out."""
    good = F.filter(cues, lambda c: c["start_us"].isNotNull() & c["end_us"].isNotNull())
    rows = files.select("path", F.posexplode(good).alias("at", "cue"))
    return _plain(rows.select("path", (F.col("at") + 1).alias("cue_no"), "cue.*"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "raw")).withColumn("line", T.strip(F.col("raw")))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"style": F.lit("Default"), "actor": F.lit("")})


def _rest(lines: Column, first: int) -> Column:
    return F.array_join(F.slice(lines, first, F.greatest(F.size(lines) - (first - 1), F.lit(0))), "\n")


def read_srt(files: DataFrame, mode: str = "strict") -> DataFrame:
    """Cues of SRT files. strict: blocks of three lines or more, parted by one empty line. regex: parted by blank lines, text
    cleaned for speech. allow_empty: two lines are enough. line: a number, a time line, text up to a blank line, sorted by start."""
    if mode == "line":
        return _read_srt_lines(files)
    least = 2 if mode == "allow_empty" else 3
    blocks = F.filter(_blocks("\n\n" if mode == "strict" else r"\n\s*\n"), lambda b: F.size(b) >= least)
    rows = _numbered_within(files, _timed(blocks, 1, " --> ", "srt", exact=mode == "strict"))
    clean = {"strict": lambda t: t, "regex": T.basic_clean, "allow_empty": lambda t: T.strip_html(t, "plain")}[mode]
    return rows.withColumn("text", clean(F.col("text")))


def _loose_time(text: Column) -> Column:
    """Microseconds of h:m:s,ms with any number of digits; anything else counts as 0."""
    pattern = r"^\s*(\d+):\s*(\d+):\s*(\d+)\s*,\s*(\d+)\s*$"
    h, m, s, ms = (F.regexp_extract(text, pattern, k).cast("bigint") for k in range(1, 5))
    return F.when(text.rlike(pattern), ((h * 60 + m) * 60 + s) * SECOND + ms * 1000).otherwise(F.lit(0).cast("bigint"))


def _read_srt_lines(files: DataFrame) -> DataFrame:
    block = r"(?m)^[ \t]*\d+[ \t]*\n([^\n]*-->[^\n]*)(\n(?:[^\n]*\S[^\n]*(?:\n|\z))*)?"
    found = F.regexp_extract_all("content", F.lit(block), F.lit(0))
    rows = files.select("path", F.posexplode(found).alias("at", "block"))
    lines = F.split(T.strip(F.col("block")), "\n")
    text = F.array_join(F.transform(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), T.strip), " ")
    start, end = (_loose_time(F.substring_index(F.get(lines, F.lit(1)), "-->", k)) for k in (1, -1))
    rows = rows.select("path", "at", start.alias("start_us"), end.alias("end_us"), text.alias("text"))
    return _numbered(_plain(rows), "start_us", "at")


def read_srt_timestamps(files: DataFrame) -> DataFrame:
    """SRT cues with both times written as ASS writes them."""
    return read_srt(files).withColumns({"ass_start": format_time(F.col("start_us"), "ass"), "ass_end": format_time(F.col("end_us"), "ass")})


def read_vtt(files: DataFrame) -> DataFrame:
    """Cues of WebVTT files: a time line with two parts, and the lines below it up to a blank one."""
    w = Window.partitionBy("path").orderBy("at")
    rows = _lines(files)
    header = F.min(F.when(F.col("line").startswith("WEBVTT"), F.col("at"))).over(Window.partitionBy("path"))
    rows = rows.withColumn("header", header).filter("header is null or at > header")
    blank = F.sum((F.col("line") == "").cast("int")).over(w)
    rows = rows.withColumn("block", blank).filter("line <> ''")
    times = F.split("line", " --> ", -1)
    start, end = (F.when(F.size(times) == 2, parse_time(times[k], "vtt")) for k in (0, 1))
    # The first good time line of a block takes the rest of it; notes before it are passed over.
    good = F.col("start_us").isNotNull() & F.col("end_us").isNotNull() & ~F.col("line").startswith("NOTE")
    rows = rows.withColumns({"start_us": start, "end_us": end}).withColumn("good", good)
    head = F.min(F.when(F.col("good"), F.struct("at", "start_us", "end_us"))).over(Window.partitionBy("path", "block"))
    rows = rows.withColumn("head", head).filter("at > head.at")
    cues = rows.groupBy("path", "block", "head").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("own"))
    text = T.strip_html(F.array_join(F.transform("own", lambda x: x["line"]), "\n"), "vtt")
    cues = cues.select("path", F.col("head.at").alias("at"), "head.start_us", "head.end_us", text.alias("text"))
    return _numbered(_plain(cues), "at")


def _ass_lines(files: DataFrame) -> DataFrame:
    """path, at and the fields of every dialogue line of the first events section, by name."""
    w = Window.partitionBy("path").orderBy("at")
    rows = _lines(files)
    opens = F.sum((F.col("line") == "[Events]").cast("int")).over(w)
    leaves = F.col("line").rlike(r"^\[.*\]$") & (F.col("line") != "[Events]") & (F.col("opens") > 0)
    rows = rows.withColumn("opens", opens).withColumn("closes", F.sum(leaves.cast("int")).over(w))
    rows = rows.filter("opens > 0 and closes = 0")
    fields = F.when(F.col("line").startswith("Format:"), F.transform(F.split(F.substring("line", 8, 1 << 30), ","), T.strip))
    rows = rows.withColumn("fields", F.last(fields, ignorenulls=True).over(w)).filter(F.col("line").startswith("Dialogue:") & F.col("fields").isNotNull())
    parts = F.split(T.strip(F.substring("line", 10, 1 << 30)), ",", F.size("fields"))
    rows = rows.withColumn("parts", F.transform(parts, T.strip))
    # A filter may be moved below the map, so the map looks at the sizes itself.
    of = F.when(F.size("parts") == F.size("fields"), F.map_from_arrays("fields", "parts"))
    return rows.select("path", "at", of.alias("of")).filter("of is not null")


def read_ass_style(files: DataFrame, style: str | None = None) -> DataFrame:
    """Cues of one style of ASS files in the order of the file (or of every style)."""
    rows = _ass_lines(files)
    of = lambda name: F.coalesce(F.element_at("of", F.lit(name)), F.lit(""))
    rows = rows.select("path", "at", parse_time(of("Start"), "ass").alias("start_us"), parse_time(of("End"), "ass").alias("end_us"), T.clean_ass_text(of("Text")).alias("text"), of("Style").alias("style"), of("Name").alias("actor"))
    rows = rows.filter("start_us is not null and end_us is not null")
    return _numbered(rows if style is None else rows.filter(F.col("style") == style), "at")


def read_ass(files: DataFrame) -> DataFrame:
    """Cues of all styles of ASS files, by start; of one start by style, then in the order of the file."""
    return _numbered(read_ass_style(files).withColumnRenamed("cue_no", "line_no"), "start_us", "style", "line_no")


def list_ass_styles(files: DataFrame) -> DataFrame:
    """path and the sorted styles of its dialogue lines, which are their fourth fields."""
    lines = _lines(files).filter(F.col("line").startswith("Dialogue:"))
    styles = lines.select("path", T.strip(F.get(F.split("line", ","), F.lit(3))).alias("style")).filter("style <> ''").distinct()
    return styles.groupBy("path").agg(F.array_sort(F.collect_set("style")).alias("styles"))


def _stripped() -> Column:
    return F.transform(F.split("content", "\n"), T.strip)


def read_lrc(files: DataFrame) -> DataFrame:
    """Cues of LRC lines with text; each lasts three seconds."""
    cues = F.transform(_stripped(), lambda x: F.struct(parse_time(x, "lrc").alias("start_us"), T.strip(F.regexp_replace(x, r"^\[[^\]]*\]", "")).alias("text")))
    cues = F.filter(cues, lambda c: c["text"] != "")
    return _numbered_within(files, F.transform(cues, lambda c: F.struct(c["start_us"].alias("start_us"), (c["start_us"] + 3 * SECOND).alias("end_us"), c["text"].alias("text"))))


def read_sbv(files: DataFrame) -> DataFrame:
    """Cues of SBV blocks whose first line holds two times."""
    return _numbered_within(files, _timed(F.filter(_blocks("\n\n"), lambda b: F.size(b) >= 2), 0, ",", "sbv"))


def read_txt(files: DataFrame) -> DataFrame:
    """A cue of three seconds for each line; blank lines take their time but give none."""
    start = lambda i: i.cast("bigint") * 3 * SECOND
    cues = F.transform(_stripped(), lambda x, i: F.struct(start(i).alias("start_us"), (start(i) + 3 * SECOND).alias("end_us"), x.alias("text")))
    return _numbered_within(files, F.filter(cues, lambda c: c["text"] != ""))


READERS = {".srt": read_srt, ".vtt": read_vtt, ".ass": read_ass, ".ssa": read_ass, ".lrc": read_lrc, ".sbv": read_sbv, ".txt": read_txt}


def read_subtitles(files: DataFrame) -> DataFrame:
    """Cues of files of all formats, by extension. Formats without a grammar here give none; see unreadable()."""
    kind = extension(F.col("path"))
    return reduce(DataFrame.unionByName, [read(files.filter(kind == ext)) for ext, read in READERS.items()])


def unreadable(files: DataFrame) -> DataFrame:
    """path and status of the files that read_subtitles() takes nothing from."""
    kind = extension(F.col("path"))
    status = F.when(kind.isin(_NO_CUES), "no cues").otherwise("unsupported")
    return files.filter(~kind.isin(list(READERS))).select("path", status.alias("status"))
