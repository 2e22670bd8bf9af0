"""Shared expressions on literal rows."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import DAY
from pyspark.sql import functions as F

from dealflow.config import DEFAULTS, Thresholds
from dealflow.functions import dates as D
from dealflow.functions import exprs as X
from dealflow.plans import with_lists


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r[0] for r in df.select(expr, "i").orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2001-07-18", dt.date(2001, 7, 18)),
        ("2001-7-1", dt.date(2001, 7, 1)),
        ("  2001-07-18", dt.date(2001, 7, 18)),
        ("2001-07-18 10:00:00", dt.date(2001, 7, 18)),
        ("2001-07-18x", dt.date(2001, 7, 18)),
        ("2000-02-29", dt.date(2000, 2, 29)),
        ("2001-02-29", None),
        ("2001-13-01", None),
        ("2001-00-00", None),
        ("2001", None),
        ("20010718", None),
        ("12001-07-18", None),
        ("+2001-07-18", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, text, expected):
    assert column(spark, [text], D.parse_date(F.col("x"))) == [expected]


def test_parse_date_in_other_format(spark):
    values = ["07/18/2001", "7/1/2001", "18/07/2001", "2001-07-18", ""]
    expected = [dt.date(2001, 7, 18), dt.date(2001, 7, 1), None, None, None]
    assert column(spark, values, D.parse_date(F.col("x"), "MM/dd/yyyy")) == expected
    with pytest.raises(ValueError):
        D.parse_date(F.col("x"), "MM/yyyy")


def test_in_year_and_since_monday(spark):
    days = ["2000-12-31", "2001-01-01", "2001-12-31", "2002-01-01"]
    expr = D.in_year(F.col("x").cast("date"), DAY)
    assert column(spark, days, expr) == [False, True, True, False]
    days = ["2001-07-15", "2001-07-16", "2003-01-01"]
    expr = D.since_monday(F.col("x").cast("date"), DAY)
    assert column(spark, days, expr) == [False, True, True]
    on_sunday = D.since_monday(F.col("x").cast("date"), dt.date(2001, 7, 22))
    assert column(spark, days, on_sunday) == [False, True, True]


def test_report_day_defaults_to_today(spark):
    got, today = spark.range(1).select(D.day(None), F.current_date()).first()
    assert got == today


def test_size_tier(spark):
    df = spark.createDataFrame(
        [(s,) for s in (None, 0, 9999, 10000, 49999, 50000, 99999, 100000)], "Deal_Size int"
    )
    got = [r[0] for r in df.select(X.size_tier(DEFAULTS)).collect()]
    assert got == [
        "Enterprise", "Small", "Small", "Mid", "Mid", "Large", "Large", "Enterprise",
    ]


def test_cycle_bucket(spark):
    days = [0, 15, 16, 30, 31, 60, 61, 90, 91, -1, None]
    df = spark.createDataFrame([(d,) for d in days], "Sales_Cycle_Days int")
    got = [r[0] for r in df.select(X.cycle_bucket(DEFAULTS)).collect()]
    assert got == [
        "01. 0-15 days",
        "01. 0-15 days",
        "02. 16-30 days",
        "02. 16-30 days",
        "03. 31-60 days",
        "03. 31-60 days",
        "04. 61-90 days",
        "04. 61-90 days",
        "05. 90+ days",
        "05. 90+ days",
        "05. 90+ days",
    ]
    other = Thresholds(cycle_cuts=(10, 20))
    assert [r[0] for r in df.select(X.cycle_bucket(other)).take(2)] == [
        "01. 0-10 days",
        "02. 11-20 days",
    ]


def test_exact_division(spark):
    def one(expr):
        return spark.range(1).select(expr).first()[0]

    big = F.lit(1).cast("bigint")
    assert one(X.pct(big, F.lit(8).cast("bigint"))) == 12.5
    assert one(X.pct(F.lit(1), F.lit(16))) == 6.3  # 6.25, half up
    assert one(X.pct(F.lit(5), F.lit(0))) is None
    assert one(X.per(F.lit(5), F.lit(2), 0)) == 3.0
    assert one(X.mean(F.lit(2), F.lit(3))) == 0.6667
    # Half to even for ratios against a DOUBLE
    assert one(X.quota_ratio(X.whole(F.lit(1)), F.lit(8.0))) == 0.12
    assert one(X.quota_ratio(X.whole(F.lit(3)), F.lit(8.0))) == 0.38
    assert one(X.quota_ratio(X.whole(F.lit(3)), F.lit(0.0))) is None
    assert one(X.quota_ratio(X.whole(F.lit(3)), F.lit(None).cast("double"))) is None
    assert one(X.hundredths(F.lit(12345).cast("bigint")).cast("double")) == 123.45
    # Totals of very large tables
    huge = F.lit(9 * 10**18).cast("bigint")
    assert one(X.pct(huge, huge)) == 100.0
    assert one(X.quota_ratio(X.whole(huge), F.lit(3e18))) == 3.0


def test_sizes_do_not_overflow(spark):
    df = spark.createDataFrame([(2_000_000_000, 100)] * 3, "Deal_Size int, Win_Probability int")
    assert df.agg(X.weighted_size()).first()[0] == 600_000_000_000


def test_distinct_lists(spark):
    """Values in order, NULL is none, the empty text is one; several lists at once."""
    df = spark.createDataFrame(
        [("a", "y", None), ("a", "x", "2"), ("a", "y", "10"), ("a", None, "2"), ("b", None, None),
         ("c", "", "1"), ("c", "z", "1"), (None, "n", None)],
        "k string, x string, y string",
    )
    lists = {"xs": (F.col("x"), ", "), "ys": (F.col("y"), ";")}
    got = with_lists(df, ["k"], {"n": F.count("*")}, lists, DEFAULTS).collect()
    assert {r.k: (r.n, r.xs, r.ys) for r in got} == {
        "a": (4, "x, y", "10;2"), "b": (1, None, None), "c": (2, ", z", "1"), None: (1, "n", None)
    }
    arrays = with_lists(df, ["k"], {"n": F.count("*")}, {"xs": (F.col("x"), "")}, DEFAULTS, as_arrays=True)
    assert {r.k: r.xs for r in arrays.collect()} == {"a": ["x", "y"], "b": [], "c": ["", "z"], None: ["n"]}


def test_label_helpers(spark):
    values = ["b", "a", "?", None]
    assert column(spark, values, X.label_order(F.col("x"), ["a", "b"])) == [2, 1, 0, 0]
    assert column(spark, values, X.by_label(F.col("x"), {"a": 1, "b": 2})) == [2, 1, None, None]
    assert column(spark, ["", None, "v"], X.present(F.col("x"))) == [False, False, True]
