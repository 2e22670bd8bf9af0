"""Reading, typing and writing."""

from __future__ import annotations

import datetime as dt

import duckdb
import pyarrow.parquet as pq
import pytest
from conftest import DAY, TESTDATA, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.deals_view import deals, deals_raw
from dealflow.__main__ import main
from dealflow.operators import announced
from dealflow.operators import coverage as P
from dealflow.schema import DEALS_SCHEMA, RAW_SCHEMA
from dealflow.sources import ingest, read_deals, read_raw, write_deals, write_report
from dealflow.sources.readers import range_slices
from dealflow.sources.writers import date_cuts, interleaved

FOLDER = str(TESTDATA / "sf0.001")


def test_view_has_the_raw_schema(spark):
    raw = deals_raw(spark, FOLDER)
    have = [(f.name, f.dataType) for f in raw.schema]
    assert have == [(f.name, f.dataType) for f in RAW_SCHEMA]
    assert raw.count() == raw.select("Opportunity_ID").distinct().count() == 1500


def test_typed_schema(spark):
    typed = deals(spark, FOLDER)
    assert [(f.name, f.dataType) for f in typed.schema] == [
        (f.name, f.dataType) for f in DEALS_SCHEMA
    ]


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="Deal_Size"):
        ingest(deals_raw(spark, FOLDER).drop("Deal_Size"))


def test_further_columns_and_wider_types_are_accepted(spark):
    raw = deals_raw(spark, FOLDER)
    wide = raw.withColumn("Deal_Size", raw.Deal_Size.cast("bigint")).withColumn("more", raw.Region)
    assert ingest(wide).schema["Deal_Size"].dataType == T.IntegerType()
    assert ingest(wide).count() == 1500


@pytest.mark.parametrize("form", ["parquet", "csv", "json", "orc"])
def test_file_formats(spark, tmp_path, form):
    raw = deals_raw(spark, FOLDER)
    path = str(tmp_path / form)
    write = raw.write.option("header", "true")
    if form == "csv":
        write = write.option("nullValue", "NULL").option("emptyValue", "")
    write.format(form).save(path)
    options = {"nullValue": "NULL", "emptyValue": ""} if form == "csv" else {}
    back = read_raw(spark, path, form, **options)
    assert back.schema.names == RAW_SCHEMA.names
    got = P.pipeline_by_close_window(ingest(back), DAY).collect()
    assert got == P.pipeline_by_close_window(ingest(raw), DAY).collect()


def test_catalog_table(spark):
    deals_raw(spark, FOLDER).createOrReplaceTempView("pipeline_deals")
    assert read_raw(spark, "pipeline_deals", "table").count() == 1500


def test_stored_deals_come_back_unchanged(spark, stored):
    assert sorted(stored.collect(), key=str) == sorted(deals(spark, FOLDER).collect(), key=str)


def test_stored_deals_have_a_folder_per_status(spark, tmp_path):
    path = tmp_path / "deals"
    write_deals(deals(spark, FOLDER), str(path))
    assert {p.name for p in path.glob("Deal_Status=*")} == {
        "Deal_Status=Open",
        "Deal_Status=Won",
        "Deal_Status=Lost",
    }
    assert read_deals(spark, str(path)).columns == DEALS_SCHEMA.names


def test_other_date_format(spark):
    row = ("07/16/2001", dt.date(2001, 7, 16))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in RAW_SCHEMA])
    raw = spark.createDataFrame(
        [tuple(row[0] if f.name == "Created_Date" else None for f in schema)], schema
    )
    assert ingest(raw, date_format="MM/dd/yyyy").first().Created_Date == row[1]
    assert ingest(raw).first().Created_Date is None


def test_normalised_labels(spark):
    given = {
        "Deal_Status": " open ",
        "Is_Stalled": "true",
        "Stage": "CLOSED WON",
        "Account_Tier": "mid-market",
        "Forecast_Category": "best case",
        "Region": " North ",
        "Created_Date": " 2001-07-16 ",
    }
    raw = spark.createDataFrame([tuple(given.get(f.name) for f in RAW_SCHEMA)], RAW_SCHEMA)
    got = ingest(raw, normalize=True).first().asDict()
    assert {k: got[k] for k in given if k != "Created_Date"} == {
        "Deal_Status": "Open",
        "Is_Stalled": "TRUE",
        "Stage": "Closed Won",
        "Account_Tier": "Mid-Market",
        "Forecast_Category": "Best Case",
        "Region": "North",
    }
    assert got["Created_Date"] == dt.date(2001, 7, 16)
    assert ingest(raw).first().Deal_Status == " open "


def test_range_slices_cover_every_key_once():
    assert range_slices("k", []) == ["1 = 1"]
    parts = range_slices("k", sorted(["OPP-2", "OPP-5", "O'x"]))
    keys = [None, "", "A", "OPP-1", "OPP-2", "OPP-3", "OPP-5", "Z"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(k,) for k in keys])
    found = [con.sql(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in parts]
    assert len(parts) == 4 and sum(found) == len(keys)


def test_empty_status_survives_storing(spark, make, tmp_path):
    fresh = make(
        *[{"Deal_Status": s} for s in ("Open", "", None, "Won", "")]
    )
    path = str(tmp_path / "deals")
    write_deals(fresh, path)
    again = read_deals(spark, path)
    assert rows(announced.pipeline_by_stage(again, DAY)) == rows(announced.pipeline_by_stage(fresh, DAY))
    assert again.where("Deal_Status = ''").count() == 2 and again.where("Deal_Status IS NULL").count() == 1


def test_a_week_is_in_few_files(spark, tmp_path):
    """Files skipped for a week, by column and status, in many small files."""
    path = tmp_path / "deals"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "192")
    try:
        write_deals(deals(spark, "/root/testdata/sf0.01"), str(path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def skipped(status: str, column: str) -> float:
        """Share of files without a day of a week in the middle of the dates."""
        spans = []
        for file in path.glob(f"Deal_Status={status}/*.parquet"):
            meta = pq.read_metadata(file)
            at = meta.schema.names.index(column)
            stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
            dated = [s for s in stats if s.has_min_max]
            spans.append((min(s.min for s in dated), max(s.max for s in dated)) if dated else None)
        lows = sorted(span[0] for span in spans if span)
        first = lows[len(lows) // 2]
        last = first + dt.timedelta(days=6)
        week = [1 for span in spans if span and span[0] <= last and span[1] >= first]
        assert len(spans) > 25
        return 1 - len(week) / len(spans)

    # Activity dates are of one month only, so a week and its edges are half of them.
    found = {
        (s, c): skipped(s, c)
        for s in ("Won", "Lost", "Open")
        for c in ("Close_Date", "Created_Date", "Last_Activity_Date")
        if (s, c) != ("Open", "Close_Date")
    }
    for (status, column), share in found.items():
        least = {"Close_Date": 0.7, "Created_Date": 0.7, "Last_Activity_Date": 0.2}[column]
        assert share >= least, (status, column, found)


def test_interleaved_bits_follow_every_date(spark):
    """A date's share of the order is its part; NULL comes first; all of them are told apart."""
    days = [None, *(dt.date(2001, 1, 1) + dt.timedelta(days=37 * i) for i in range(12))]
    rows_ = [(a, b, c) for a in days for b in days for c in days[::4]]
    df = spark.createDataFrame(rows_, "Close_Date date, Created_Date date, Last_Activity_Date date")
    cuts = date_cuts(df)
    assert all(len(c) == 12 - 9 * (n == "Last_Activity_Date") for n, c in cuts.items())
    got = df.withColumn("place", interleaved(cuts)).collect()
    assert len({r.place for r in got}) == len(got) == len(rows_)

    def part(place: int, k: int) -> int:
        return sum((place >> (3 * bit + 2 - k) & 1) << bit for bit in range(8))

    for k, column in enumerate(cuts):
        parts = {r[column]: part(r.place, k) for r in got}
        values = sorted((d for d in parts if d), key=lambda d: d)
        assert [parts[d] for d in [None, *values]] == list(range(len(parts)))
    assert date_cuts(df.where("false")) == {c: [] for c in cuts}


def test_reports_are_written(spark, stored, tmp_path):
    report = P.coverage_health(stored, DAY)
    write_report(report, str(tmp_path / "p"))
    assert sorted(map(str, rows(spark.read.parquet(str(tmp_path / "p"))))) == sorted(
        map(str, rows(report))
    )
    write_report(report, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == report.count()


def test_command_line(spark, tmp_path, capsys):
    raw, typed, out = (str(tmp_path / n) for n in ("raw", "typed", "out"))
    deals_raw(spark, FOLDER).write.parquet(raw)
    main(["ingest", "--raw", raw, "--deals", typed])
    main(["report", "coverage_health", "week_closed", "--deals", typed, "--as-of", "2001-07-18",
          "--out", out])
    expected = P.coverage_health(read_deals(spark, typed), DAY).count()
    assert spark.read.parquet(f"{out}/coverage_health").count() == expected
    assert spark.read.parquet(f"{out}/week_closed").count() > 0
    main(["report", "stuck_deals", "--deals", typed, "--as-of", "2001-07-18"])
    lines = capsys.readouterr().out.splitlines()
    stuck = announced.stuck_deals(read_deals(spark, typed), DAY).count()
    assert "Days_in_Stage" in lines[0] and len(lines) == stuck + 1 > 21
    main(["report", "stuck_deals", "--deals", typed, "--as-of", "2001-07-18", "--rows", "5"])
    assert len(capsys.readouterr().out.splitlines()) == 6
    with pytest.raises(SystemExit):
        main(["report", "nothing", "--deals", typed])
