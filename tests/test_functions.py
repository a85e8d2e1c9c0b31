import datetime as dt

import pytest
from pyspark.sql import functions as F

from vidmetrics.functions import coerce, text, watch
from vidmetrics.operators.series import range_start
from vidmetrics.operators.trend import stars_from_delta, stars_from_slope


def apply(spark, build, *values, kinds=None):
    kinds = kinds or ["string"] * len(values)
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    df = spark.createDataFrame([tuple(values)], schema)
    return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("value, want", [
    ("PT1M5S", 65), ("PT1H", 3600), ("", None), ("oops", None), (None, None), ("P1DT1S", 86401),
    ("PT", None), ("P", None), ("PT6M11S", 371), ("P2D", 172800),
])
def test_iso_duration(spark, value, want):
    assert apply(spark, coerce.iso_duration_seconds, value) == want


@pytest.mark.parametrize("title, description, seconds, want", [
    ("Teaser: XYZ", "", 120, True), ("", "extrait de l'émission", 120, True), ("vidéo", "", 30, True),
    ("Long format", "rien de spécial", 300, False), (None, None, None, False),
])
def test_teaser(spark, title, description, seconds, want):
    assert apply(spark, text.is_teaser, title, description, seconds, kinds=["string", "string", "int"]) is want


@pytest.mark.parametrize("value, want", [
    ("12", 12), ("12.9", 12), (" 7 ", 7), ("1e3", 1000), ("", None), (None, None), ("12 views", 12), ("abc", None), ("-", 0), ("-4", -4),
])
def test_lenient_long(spark, value, want):
    assert apply(spark, coerce.lenient_long, value) == want


@pytest.mark.parametrize("value, want", [("3", 3), ("-3", 0), ("2.7", 2), ("", None)])
def test_unsigned(spark, value, want):
    assert apply(spark, coerce.unsigned, value) == want


def test_not_numeric(spark):
    assert apply(spark, coerce.not_numeric, "x1") is True
    assert apply(spark, coerce.not_numeric, "1") is False
    assert apply(spark, coerce.not_numeric, "") is False


@pytest.mark.parametrize("value, want", [
    ("1704103200.5", dt.datetime(2024, 1, 1, 10, 0, 0, 500000)), ("-5", dt.datetime(1969, 12, 31, 23, 59, 55)),
    ("1704103200", dt.datetime(2024, 1, 1, 10)), ("1704103200250", dt.datetime(2024, 1, 1, 10, 0, 0, 250000)),
    ("2025-10-01T11:46:23+0000", dt.datetime(2025, 10, 1, 11, 46, 23)),
    ("2025-10-01T11:46:23+02:00", dt.datetime(2025, 10, 1, 9, 46, 23)), ("soon", None),
    ("", dt.datetime(2030, 1, 1)), (None, dt.datetime(2030, 1, 1)),
])
def test_wire_instant(spark, value, want):
    got = apply(spark, lambda c: F.date_format(coerce.wire_instant(c, F.lit("2030-01-01").cast("timestamp")), "yyyy-MM-dd HH:mm:ss.SSS"), value)
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S.") + f"{want.microsecond // 1000:03d}")


@pytest.mark.parametrize("value, want", [
    ("Teaser: Été à Vaud", "été à vaud"), ("Extrait - red plate", "red plate"), ("Bande-annonce (HD)!", "hd"),
    ("teasers", "teasers"), (None, ""), ("  [a]_{b} ", "a b"), ("éteaser", "éteaser"),
])
def test_normal_title(spark, value, want):
    assert apply(spark, text.normal_title, value) == want


def test_text_widths(spark):
    assert apply(spark, text.abbreviated, "x" * 161) == "x" * 157 + "..."
    assert apply(spark, text.abbreviated, "x" * 160) == "x" * 160
    assert apply(spark, text.truncated, "y" * 200) == "y" * 140
    assert apply(spark, text.fuzzy_text, "Café  N°1") == "caf n 1"
    zurich = apply(spark, lambda c: F.date_format(text.zurich_time(c.cast("timestamp")), "HH:mm"), "2024-07-01 10:00:00")
    assert zurich == "12:00"


@pytest.mark.parametrize("value, want", [("1:02:03", 3723), ("02:03", 123), ("7", 0), ("a:1", 0), (None, 0)])
def test_hms(spark, value, want):
    assert apply(spark, watch.hms_seconds, value) == want


@pytest.mark.parametrize("views, length, total, average, share, want", [
    (10, 60, 500, None, None, 500), (10, 60, 900, None, None, 600), (10, 60, None, 20, None, 200),
    (10, 60, None, 20, 0.25, 150), (0, 60, None, 20, None, 0), (0, 60, 50, None, None, 50), (10, 60, None, None, None, 0),
])
def test_plausible_watch(spark, views, length, total, average, share, want):
    def build(v, ln, t, a, s):
        return watch.plausible_watch_seconds([t], v, ln, a, s)

    row = [None if x is None else float(x) for x in (views, length, total, average, share)]
    assert apply(spark, build, *row, kinds=["double"] * 5) == want


@pytest.mark.parametrize("slope, want", [(32.0, 3), (8.0, 2), (2.0, 1), (1.9, 0), (-5.0, 0)])
def test_slope_stars(spark, slope, want):
    assert apply(spark, stars_from_slope, slope, kinds=["double"]) == want


@pytest.mark.parametrize("delta, growth, now, want", [
    (300.0, 0.01, 9000, 2), (100.0, 0.01, 9000, 1), (50.0, 0.36, 500, 2), (50.0, 0.2, 200, 1), (5.0, 0.3, 100, 1),
    (60.0, 0.6, 100, 2), (99.0, 0.1, 150, 0), (None, None, 50, 0),
])
def test_delta_stars(spark, delta, growth, now, want):
    assert apply(spark, stars_from_delta, delta, growth, now, kinds=["double", "double", "long"]) == want


@pytest.mark.parametrize("text_range, want", [
    ("48h", "2024-01-08"), ("3d", "2024-01-07"), ("all", "2024-01-02"), ("", "2024-01-02"), ("junk", "2024-01-03"),
])
def test_range(spark, text_range, want):
    got = apply(
        spark, lambda c: F.date_format(range_start(text_range, c.cast("timestamp"), "2024-01-10"), "yyyy-MM-dd"), "2024-01-02"
    )
    assert got == want
