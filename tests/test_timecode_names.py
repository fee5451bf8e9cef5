from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import names, timecode


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_format_time(spark):
    given = [0.0, 1.5, 59.9996, 3599.9999, 3661.25, 0.0625, 0.1875, 0.0005, 360000.0, None]
    want = ["00:00:00,000", "00:00:01,500", "00:01:00,000", "01:00:00,000", "01:01:01,250", "00:00:00,062", "00:00:00,188", "00:00:00,000", "100:00:00,000", None]
    assert column(spark, given, "double", timecode.format_time) == want


def test_seconds_of(spark):
    assert column(spark, ["01:01:01,250", "1:2,3", "x", "", None, "00:00:00"], "string", timecode.seconds_of) == [3661.25, None, None, None, None, None]


def test_normalize_range(spark):
    given = ["1:2:3,4 --> 00:05,006", " 3,4-->5,6 ", "x", "a --> 1,2", "1,2 --> b", "", None, "100:0:0,1 --> 1,2", "1,2-->3,4-->5,6"]
    want = ["01:02:03,004 --> 00:00:05,006", "00:00:03,004 --> 00:00:05,006", "ERROR_NORM_NO_ARROW_SEPARATOR__x", "ERROR_NORM_START_PARSE_FAILED__a --> 1,2", "ERROR_NORM_END_PARSE_FAILED__1,2 --> b", "ERROR_NORM_INVALID_INPUT_TYPE__", "ERROR_NORM_INVALID_INPUT_TYPE__None", "ERROR_NORM_START_PARSE_FAILED__100:0:0,1 --> 1,2", "ERROR_NORM_NO_ARROW_SEPARATOR__1,2-->3,4-->5,6"]
    assert column(spark, given, "string", timecode.normalize_range) == want


def test_names(spark):
    given = ["", None, "a/b:c", "__x__", "电影", "x" * 60 + "_" + "y" * 60, "z" * 120]
    want = ["untitled", "untitled", "a_b_c", "x", "untitled_video", "x" * 60, "z" * 100]
    assert column(spark, given, "string", names.sanitize_filename) == want
    urls = ["https://www.youtube.com/watch?v=AbC&t=3", "https://youtu.be/AbC?si=1", "AbC", None]
    assert column(spark, urls, "string", names.video_id) == ["AbC", "AbC", "AbC", None]
    assert column(spark, ["a.EPUB", "https://youtu.be/x", "b.srt", "c.vtt", "d.md", None], "string", names.input_kind) == ["book", "subtitle", "subtitle", "subtitle", None, None]
