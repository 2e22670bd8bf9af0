from __future__ import annotations

import datetime as dt
import itertools
import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from dealflow.schema import RAW_SCHEMA  # noqa: E402
from dealflow.session import tuned  # noqa: E402
from dealflow.sources import ingest, write_deals  # noqa: E402

TESTDATA = Path("/root/testdata")
DAY = dt.date(2001, 7, 18)


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        tuned(SparkSession.builder)
        .master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Typed deals from partial rows; columns that a row leaves out get a plain value."""
    numbers = itertools.count(1)

    def plain() -> dict:
        n = next(numbers)
        return {
            "Opportunity_ID": f"OPP-{n:04d}",
            "Opportunity_Name": f"Deal {n:04d}",
            "Sales_Rep": "Ann",
            "Region": "North",
            "Product_Line": "Software",
            "Industry": "Retail",
            "Stage": "Proposal",
            "Deal_Size": 20_000,
            "Win_Probability": 50,
            "Created_Date": "2001-01-10",
            "Last_Activity_Date": "2001-07-17",
            "Expected_Close_Date": "2001-09-01",
            "Close_Date": None,
            "Days_in_Stage": 3,
            "Account_Name": "Account",
            "Account_Tier": "SMB",
            "Lead_Source": "Web",
            "Forecast_Category": "Pipeline",
            "Deal_Type": "Upsell",
            "Quota_Contribution": 1000.0,
            "Reason_Lost": None,
            "Competitor_Name": None,
            "Campaign_Name": None,
            "Currency": "USD",
            "Is_Stalled": "FALSE",
            "Deal_Status": "Open",
            "Rep_Tenure_Months": 14,
            "Sales_Cycle_Days": 40,
        }

    def build(*rows: dict) -> DataFrame:
        full = [{**plain(), **row} for row in rows]
        values = [tuple(row[f.name] for f in RAW_SCHEMA) for row in full]
        return ingest(spark.createDataFrame(values, RAW_SCHEMA))

    return build


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory) -> DataFrame:
    """Typed deals of the smallest tables, written and read back."""
    from checks.deals_view import deals
    from dealflow.sources import read_deals

    path = str(tmp_path_factory.mktemp("stored") / "deals")
    write_deals(deals(spark, str(TESTDATA / "sf0.001")), path)
    return read_deals(spark, path)


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
