"""Hand-worked values of the text and time functions."""

import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.functions import timecode as C


def check(spark, fn, cases):
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(cases)], "i int, t string")
    got = [r["r"] for r in df.select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()]
    assert got == [v for _, v in cases]


CASES = {
    "fix_numbers": (T.fix_numbers, [("１２３", "123"), ("1。2", "1.2"), ("192。168。1。1", "192.168.1.1"), ("v。2", "v.2"), ("1。2345", "1。2345"), ("12：34", "12:34"), ("99：99", "99:99"), (None, "")]),
    "strip_brackets": (T.strip_brackets, [("a (b) c", "a c"), ("[x]【y】{z}<q>（r）", ""), ("a(b", "a(b")]),
    "is_pure_bracket": (T.is_pure_bracket, [("(x)", True), (" [x] ", True), ("(x) y", False), ("", False), (None, False)]),
    "basic_clean": (T.basic_clean, [("!?", ""), ("a", ""), ("a & b", "a 和 b"), ("café \U0001f600 ok", "café ok"), ("", ""), (None, "")]),
    "detect_language": (T.detect_language, [("안녕 abc", "ko"), ("かな", "ja"), ("中文字", "zh"), ("中文 abc", "mixed"), ("abc", "en"), ("123", "unknown"), ("", "unknown"), (None, "unknown")]),
    "space_capitals": (T.space_capitals, [("HelloWorld", "Hello World"), ("aB", "a B")]),
    "space_alnum": (T.space_alnum, [("a1b", "a 1 b")]),
    "dash_to_words": (T.dash_to_words, [("10-15点", "10至15点"), ("问题1 – 问题3", "问题1 至 问题3"), ("单元 1  –  预览", "单元 1  ，  预览"), ("第1章，导论 – 第2章", "第1章，导论 ， 第2章"), ("a-b", "a，b")]),
    "percent_to_words": (T.percent_to_words, [("95%", "百分之九十五"), ("20.5%", "百分之二十点五"), ("只有 5 %", "只有 百分之五"), ("100%", "百分之一百"), ("1005%", "百分之一千零零五"), ("12345%", "百分之一二三四五"), ("x", "x")]),
    "number_to_words": (T.number_to_words, [("0", "零"), ("10", "十"), ("15", "十五"), ("20", "二十"), ("110", "一百一十"), ("115", "一百一十五"), ("205", "二百零五"), ("1010", "一千零十"), ("1015", "一千零十五"), ("3456", "三千四百五十六")]),
    "spell_single_digits": (T.spell_single_digits, [("有 3 人", "有 三 人"), ("3个", "3个"), ("1.2 和 5", "1.2 和 五"), ("12:34", "12:34"), ("1) 2", "1) 二")]),
    "map_punctuation": (T.map_punctuation, [("Hi, you.", "Hi， you。"), ("1.2, 12:34", "1.2， 12:34"), ("192.168.1.1", "192.168。1.1"), ("wait...", "wait。")]),
    "expand_contractions": (T.expand_contractions, [("I don't know", "I do not know"), ("Can't", "cannot"), ("isn't", "isn't")]),
    "sanitize_name": (T.sanitize_name, [("a/b:c.mp4", "a_b_c_mp4"), ("..", "unnamed"), (None, "unnamed")]),
    "split_sentences": (T.split_sentences, [("A. B! C", ["A.", "B!", "C"]), ("", []), (None, [])]),
    "split_length": (lambda t: T.split_length(t, 5), [("aa bb cc", ["aa bb", "cc"]), ("abcdefg h", ["abcdefg", "h"]), ("  ", [])]),
    "split_text": (lambda t: T.split_text(t, "adaptive", 6), [("ab. cd efg hi.", ["ab.", "cd efg", "hi."]), ("abc", ["abc"]), ("", [])]),
    "clean_ass_text": (T.clean_ass_text, [(r"{\b1}a\Nb\hc", "a b c")]),
    "classify_failure": (T.classify_failure, [("CUDA out of memory", "memory"), ("decoder not found", "no_decoder"), ("ffmpeg error", "encoder"), ("", "other"), (None, "other")]),
    "parse_srt": (lambda t: C.parse_time(t, "srt"), [("00:00:01,500", 1_500_000), ("25:00:00,000 x", 3_600_000_000), ("00:61:00,000", None), ("1:2", None), (None, None)]),
    "parse_lrc": (lambda t: C.parse_time(t, "lrc"), [("[01:02.03]x", 62_030_000), ("01:02.03", None)]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_values(spark, name):
    check(spark, *CASES[name])


def test_process_text(spark):
    df = spark.createDataFrame([("我们都有 3 人, (笑) 共20.5%。",), ("   ",), (None,), ("x" * 5000,)], "t string")
    got = [r["r"] for r in df.select(T.process_text(F.col("t")).alias("r")).collect()]
    assert got[0]["cleaned"] == "我们都有 三 人， 共百分之二十点五。" and got[0]["language"] == "zh" and got[0]["is_valid"]
    assert [g["is_valid"] for g in got[1:]] == [False] * 3 and got[1]["error_message"] == "empty text"


def test_time_wraps(spark):
    df = spark.createDataFrame([(1_500_000,), (86_400_000_001,)], "us bigint")
    got = df.select(*[C.format_time(F.col("us"), f).alias(f) for f in ("srt", "ass", "lrc", "iso")], C.from_seconds(F.lit(-0.5)).alias("neg"), C.seconds_to_srt(F.lit(2.3)).alias("cut")).collect()
    assert got[0]["srt"] == "00:00:01,500" and got[0]["ass"] == "0:00:01.50" and got[0]["lrc"] == "[00:01.50]" and got[0]["iso"] == "00:00:01.500000"
    assert got[1]["srt"] == "00:00:00,000" and got[0]["neg"] == 86_399_500_000 and got[0]["cut"] == "00:00:02,299"
