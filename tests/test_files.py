"""Readers and writers on small files."""

from pyspark.sql import functions as F

from cuewright.functions.timecode import SECOND
from cuewright.operators import retime as R
from cuewright.sources import sinks as W
from cuewright.sources import subtitles as Q

SRT = "1\n00:00:01,000 --> 00:00:02,000\nHello\nyou\n\nbad\n\n3\n00:00:03,000 --> 00:00:04,500\n(x)\n"
VTT = "WEBVTT\n\nNOTE a\n\n00:00:01.000 --> 00:00:02.000\n<b>Hi</b>\nthere\n\n00:00:03.000 --> 00:00:04.000\n\nlost\n"
ASS = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:02.00,0:00:03.00,B,bob,0,0,0,,two, three\nDialogue: 0,0:00:01.00,0:00:02.00,A,,0,0,0,,{\\i1}one\nDialogue: 0,bad\n[Other]\nDialogue: 0,0:00:09.00,0:00:10.00,A,,0,0,0,,no\n"


def files(spark, **content):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in content.items()], "path string, content string")


def texts(df):
    return [(r["cue_no"], r["start_us"] // 1000, r["text"]) for r in df.orderBy("path", "cue_no").collect()]


def test_srt_modes(spark):
    f = files(spark, a_srt=SRT)
    assert texts(Q.read_srt(f)) == [(1, 1000, "Hello\nyou"), (2, 3000, "(x)")]
    assert texts(Q.read_srt(f, "regex")) == [(1, 1000, "Hello you"), (2, 3000, "")]
    assert texts(Q.read_srt(f, "line")) == [(1, 1000, "Hello you"), (2, 3000, "(x)")]
    assert texts(Q.read_srt(files(spark, a_srt="1\n00:00:01,000 --> 00:00:02,000"), "allow_empty")) == [(1, 1000, "")]


def test_vtt_and_ass(spark):
    assert texts(Q.read_vtt(files(spark, a_vtt=VTT))) == [(1, 1000, "Hi\nthere")]
    got = Q.read_ass(files(spark, a_ass=ASS)).orderBy("cue_no").collect()
    assert [(r["style"], r["text"], r["actor"]) for r in got] == [("A", "one", ""), ("B", "two, three", "bob")]
    assert Q.list_ass_styles(files(spark, a_ass=ASS)).first()["styles"] == ["A", "B"]


def test_minor_formats(spark):
    assert texts(Q.read_lrc(files(spark, a_lrc="[ti:x]\n[00:01.50]la\n[00:02.00]\n"))) == [(1, 1500, "la")]
    assert texts(Q.read_sbv(files(spark, a_sbv="0:00:01.000,0:00:02.000\nhi\nyou\n\nbad\nx\n"))) == [(1, 1000, "hi\nyou")]
    assert texts(Q.read_txt(files(spark, a_txt="one\n\ntwo"))) == [(1, 0, "one"), (2, 6000, "two")]
    assert Q.read_subtitles(files(spark, a_srt=SRT, b_lrc="[00:01.50]la", c_smi="x", d_xyz="y")).count() == 3
    assert {r["status"] for r in Q.unreadable(files(spark, c_smi="x", d_xyz="y")).collect()} == {"no cues", "unsupported"}


def test_decoding(spark):
    raw = [("中文".encode("gbk"), "中文"), (b"\xef\xbb\xbfhi", "hi"), ("é中".encode(), "é中"), (b"\xff\xfe\x80", "ÿþ\x80")]
    df = spark.createDataFrame([(bytearray(b), t) for b, t in raw], "b binary, t string")
    assert df.filter(Q.decode_text(F.col("b")) != F.col("t")).count() == 0


def test_folders(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "a.srt").write_bytes(SRT.replace("\n", "\r\n").encode())
    assert Q.read_srt(Q.read_files(spark, str(tmp_path / "in"))).count() == 2
    cues = Q.read_srt(files(spark, a_srt=SRT)).withColumnRenamed("path", "media_id")
    W.write_subtitles(cues, str(tmp_path / "out"), "srt")
    assert Q.read_srt(Q.read_files(spark, str(tmp_path / "out"))).count() == 2


def track(spark, *rows):
    return spark.createDataFrame([(1, i + 1, i * SECOND, (i + 1) * SECOND, t, s, "") for i, (s, t) in enumerate(rows)], "media_id bigint, cue_no int, start_us bigint, end_us bigint, text string, style string, actor string")


def test_merge_repeated_style(spark):
    got = R.merge_repeated_style(track(spark, ("A", "a1"), ("B", "b1"), ("B", "b2"), ("A", "a2"))).orderBy("cue_no").collect()
    assert [(r["style"], r["text"], r["end_us"] // SECOND) for r in got] == [("A", "a1, b2", 3), ("B", "b1", 3), ("A", "a2", 4)]
    three = R.merge_repeated_style(track(spark, ("A", "a1"), ("B", "b1"), ("B", "b2"), ("C", "c1"))).orderBy("cue_no").collect()
    assert [(r["style"], r["text"], r["end_us"] // SECOND) for r in three] == [("A", "a1, b2", 3), ("B", "b1", 3), ("C", "c1", 4)]
    assert R.merge_repeated_style(track(spark, ("A", "a1"), ("A", "a2"))).count() == 2


def test_merge_repeated_style_same_as_walk(spark):
    """The windows for two styles against a walk over a media's rows."""
    import random

    from .test_operators import _walked_styles

    rng = random.Random(5)
    rows = [(m, i, i * SECOND, (i + 1) * SECOND, f"t{i}", rng.choice("AB"), "") for m in range(30) for i in range(1, 15)]
    cues = spark.createDataFrame(rows, "media_id bigint, cue_no int, start_us bigint, end_us bigint, text string, style string, actor string")
    walked = sorted((m, *r) for m in range(30) for r in _walked_styles([(i, s, e, t) for k, i, _, e, t, s, _ in rows if k == m]))
    assert sorted((r["media_id"], r["cue_no"], r["style"], r["end_us"], r["text"]) for r in R.merge_repeated_style(cues).collect()) == walked


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """A task for each folder made the listing as slow as the writing."""
    for i in range(300):
        (tmp_path / f"media_id={i}").mkdir()
        (tmp_path / f"media_id={i}" / "part.txt").write_text(f"file {i}")
    spark.sparkContext.setJobGroup("listing", "listing")
    files = Q.read_files(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("others", "others")
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(n).numTasks for job in status.getJobIdsForGroup("listing") for n in status.getJobInfo(job).stageIds]
    assert tasks and sum(tasks) <= 128 and files.count() == 300
