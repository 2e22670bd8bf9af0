"""Every report against its SQL on random deals full of gaps, ties and edge values."""

from __future__ import annotations

import random
from datetime import timedelta

import duckdb
import pytest
from conftest import DAY

from checks.oracle import all_sql
from dealflow.reports import REPORTS
from dealflow.schema import RAW_SCHEMA
from dealflow.sources import ingest

EDGE_DAYS = (-400, -200, -91, -30, -16, -15, -14, -8, -7, -6, -5, -3, -2, -1, 0, 1, 7, 8, 30, 31,
             90, 91, 166, 167)


def date(pick: random.Random) -> str | None:
    if pick.random() < 0.15:
        return pick.choice([None, "", "junk", "2001-02-30", "0000-00-00"])
    return str(DAY + timedelta(days=pick.choice(EDGE_DAYS)))


def deal(pick: random.Random, n: int) -> tuple:
    def one(*values):
        return pick.choice(values)

    values = {
        "Opportunity_ID": f"OPP-{n}",
        "Opportunity_Name": one(None, "Same", f"Deal {n}"),
        "Sales_Rep": one(None, "", "Ann", "Bob", "Cid"),
        "Region": one(None, "North", "South"),
        "Industry": one(None, "Retail", "Energy"),
        "Stage": one(None, "Prospecting", "Qualification", "Discovery", "Proposal",
                     "Negotiation", "Contract", "Closing", "Closed Won", "Other"),
        "Deal_Size": one(None, 0, 1, 9_999, 10_000, 49_999, 50_000, 99_999, 100_000, 2**31 - 1),
        "Win_Probability": one(None, 0, 29, 30, 100),
        "Created_Date": date(pick),
        "Last_Activity_Date": date(pick),
        "Expected_Close_Date": date(pick),
        "Close_Date": date(pick),
        "Days_in_Stage": one(None, 0, 7, 8, 14, 15, 40),
        "Account_Name": one(None, "Account"),
        "Account_Tier": one(None, "Enterprise", "Mid-Market", "SMB"),
        "Lead_Source": one(None, "Web", "Event"),
        "Forecast_Category": one(None, "Commit", "Best Case", "Upside", "Pipeline", "Omit"),
        "Deal_Type": one(None, "Upsell", "Renewal"),
        "Quota_Contribution": one(None, 0.0, 0.1, 8.0, 1234.56, 999_999.99),
        "Reason_Lost": one(None, "", "Price", "Timing"),
        "Competitor_Name": one(None, "", "Acme", "Globex"),
        "Campaign_Name": one(None, "", "C1", "C2"),
        "Is_Stalled": one(None, "TRUE", "FALSE", ""),
        "Deal_Status": one(None, "Open", "Open", "Won", "Lost", "Hold"),
        "Rep_Tenure_Months": one(None, 11, 12),
        "Sales_Cycle_Days": one(None, -1, 0, 15, 16, 30, 31, 60, 61, 90, 91),
    }
    return tuple(values.get(f.name) for f in RAW_SCHEMA)


@pytest.fixture(scope="module", params=[11, 12])
def both(request, spark, tmp_path_factory):
    pick = random.Random(request.param)
    raw = spark.createDataFrame([deal(pick, n) for n in range(600)], RAW_SCHEMA)
    path = str(tmp_path_factory.mktemp("random") / "raw")
    raw.coalesce(1).write.parquet(path)
    sql = all_sql(f"SELECT * FROM '{path}/*.parquet'")
    return ingest(spark.read.parquet(path)).cache(), sql, duckdb.connect()


@pytest.mark.parametrize("name", REPORTS)
def test_same_result(both, name):
    deals, sql, con = both
    result = con.execute(sql[name])
    names = [d[0] for d in result.description]
    df = REPORTS[name](deals, DAY)
    expected = [tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()]
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
