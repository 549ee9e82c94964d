"""C1-C17 on hand-written rows (golden values from the sample outputs)."""

import datetime as dt

from pyspark.sql import functions as F

from matforge.functions import cleaning as C


def _one(spark, expr, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_clean_currency(spark):
    got = _one(spark, C.clean_currency, ["$1,234.50", "", "-.", "1-2", "5.", ".", "-", None, "USD 7"])
    assert got == [1234.5, None, None, None, 5.0, None, None, None, 7.0]


def test_to_numeric_strict(spark):
    got = _one(spark, C.to_numeric, ["12", " 3.5 ", "1e3", "23 EA", "", None, "-4"])
    assert got == [12.0, 3.5, 1000.0, None, None, None, -4.0]


def test_canonical_item_key(spark):
    got = _one(spark, C.canonical_item_key, ["258", "258.0", " 258 ", "12,345", "COPPER_CAT6A_7FT", "", None])
    assert got == ["258", "258", "258", "12345", "COPPER_CAT6A_7FT", None, None]


def test_master_item_int(spark):
    got = _one(spark, C.master_item_int, ["  12345 ", "12,345", "12345.0", "Item 4", "1e2", None])
    assert got == [12345, 12345, 12345, None, 100, None]


def test_plan_qty_half_even(spark):
    got = _one(spark, C.plan_qty, ["2.5", "3.5", "1,234", "n/a", None, "0.2"])
    assert got == [2, 4, 1234, 1, 1, 1]


def test_link_qty(spark):
    got = _one(spark, lambda c: C.link_qty(c), ["10", "2.9", "1,200", "", None, "abc"])
    assert got == [10, 2, 1200, 1, 1, 1]


def test_parse_date_month_first(spark):
    got = _one(spark, C.parse_date, ["04/05/2000", "2000-04-05", "not a date", None])
    assert got == [dt.date(2000, 4, 5), dt.date(2000, 4, 5), None, None]


def test_calendar_features(spark):
    df = spark.createDataFrame([(dt.date(2027, 1, 1),), (dt.date(2024, 1, 7),)], "d date")
    rows = df.select(*[c.alias(n) for n, c in C.calendar_features(F.col("d"), "d").items()]).collect()
    assert tuple(rows[0]) == (1, 4, 53, 1)   # Friday, ISO week 53 of 2026
    assert tuple(rows[1]) == (1, 6, 1, 1)    # Sunday -> 6


def test_clean_text(spark):
    got = _one(spark, C.clean_text, ["Cable-Tray  50mm, GALV.", None, "  x  "])
    assert got == ["cable tray 50mm galv", "", "x"]


def test_short_label_and_task_name(spark):
    df = spark.createDataFrame([("a b c d e f g", "1"), (None, "7"), ("", "")], "d string, k string")
    labels = [r[0] for r in df.select(C.short_label(F.col("d"), F.col("k"))).collect()]
    assert labels == ["a b c d e", "Item 7", ""]
    names = [r[0] for r in df.select(C.timeline_task_name(F.col("d"), F.col("k"), F.lit(3))).collect()]
    assert names == ["Procure: a b c d e f g", "Procure: 7", "Procure: row_3"]
