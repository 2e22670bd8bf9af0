"""A raw deal table over the given order tables: one SQL text for Spark and DuckDB.

FIXTURES.md describes it. The report day of all checks is Wednesday, 2001-07-18.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from dealflow.sources import ingest

AS_OF = dt.date(2001, 7, 18)

TABLES = ("orders", "customer", "nation", "region")

DEALS_RAW = """
WITH base AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, (o.o_custkey + o.o_orderkey) % 8 AS sg,
         CASE WHEN o.o_orderstatus = 'O' AND o.o_custkey % 40 = 37 THEN 'P'
              WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 3 <> 0 AND o.o_orderkey % 5 < 4 AND (o.o_custkey + o.o_orderkey) % 8 BETWEEN 4 AND 6 THEN 'F'
              WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 3 <> 0 AND o.o_orderkey % 5 < 3 AND (o.o_custkey + o.o_orderkey) % 8 = 1 THEN 'P'
              WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 3 <> 0 AND o.o_orderkey % 5 < 1 AND (o.o_custkey + o.o_orderkey) % 8 = 2 THEN 'P'
              ELSE o.o_orderstatus END AS st,
         o.o_orderpriority AS pr,
         CAST(o.o_orderdate AS DATE) AS od, o.o_totalprice AS price, cu.c_mktsegment AS seg,
         cu.c_acctbal AS bal, cu.c_name AS acct, r.r_name AS reg,
         o.o_custkey % 40 AS rep, (o.o_custkey * 5 + o.o_orderkey) % 120 AS cyc, DATE '2001-07-18' AS as_of
  FROM {orders} o
  JOIN {customer} cu ON cu.c_custkey = o.o_custkey
  JOIN {nation} n ON n.n_nationkey = cu.c_nationkey
  JOIN {region} r ON r.r_regionkey = n.n_regionkey
)
SELECT
  concat('OPP-', CAST(k AS VARCHAR(20))) AS Opportunity_ID,
  concat('Deal ', CAST(k AS VARCHAR(20))) AS Opportunity_Name,
  concat('Rep-', CAST(rep AS VARCHAR(20))) AS Sales_Rep,
  reg AS Region,
  CASE k % 4 WHEN 0 THEN 'Hardware' WHEN 1 THEN 'Software' WHEN 2 THEN 'Services' ELSE 'Support' END AS Product_Line,
  seg AS Industry,
  CASE WHEN st = 'F' AND k % 3 = 0 THEN 'Closed Won'
       WHEN st = 'P' AND k % 3 = 0 THEN 'Closed Lost'
       ELSE CASE sg WHEN 0 THEN 'Prospecting' WHEN 1 THEN 'Qualification' WHEN 2 THEN 'Discovery'
            WHEN 3 THEN 'Proposal' WHEN 4 THEN 'Negotiation' WHEN 5 THEN 'Contract' WHEN 6 THEN 'Closing'
            ELSE 'Prospecting' END END AS Stage,
  CASE WHEN k % 500 = 13 THEN NULL ELSE CAST(floor(price / (1 + k % 9)) AS INT) END AS Deal_Size,
  CAST((k * 37) % 101 AS INT) AS Win_Probability,
  CASE WHEN k % 97 = 5 THEN '' WHEN k % 97 = 6 THEN NULL ELSE CAST(od AS VARCHAR(10)) END AS Created_Date,
  CASE WHEN k % 89 = 3 THEN '' ELSE CAST(as_of - CAST((k * 7 + c) % 30 AS INT) AS VARCHAR(10)) END AS Last_Activity_Date,
  CASE WHEN k % 83 = 2 THEN NULL
       WHEN rep = 39 THEN CAST(as_of - CAST(1 + (k * 13 + c) % 40 AS INT) AS VARCHAR(10))
       WHEN rep = 38 THEN CAST(as_of + CAST((k * 13 + c) % 31 AS INT) AS VARCHAR(10))
       ELSE CAST(as_of + CAST((k * 13 + c) % 160 AS INT) - 40 AS VARCHAR(10)) END AS Expected_Close_Date,
  CASE WHEN st = 'O' THEN '' WHEN k % 101 = 7 THEN NULL ELSE CAST(od + CAST(cyc AS INT) AS VARCHAR(10)) END AS Close_Date,
  CAST((k * 11 + c) % 45 AS INT) AS Days_in_Stage,
  acct AS Account_Name,
  CASE WHEN bal > 6000 THEN 'Enterprise' WHEN bal > 2000 THEN 'Mid-Market' ELSE 'SMB' END AS Account_Tier,
  CASE WHEN pr = '1-URGENT' OR (st = 'F' AND k % 3 <> 1 AND pr IN ('3-MEDIUM', '5-LOW')) THEN 'Referral' WHEN pr = '2-HIGH' THEN 'Web' WHEN pr = '3-MEDIUM' THEN 'Event'
       WHEN pr = '4-NOT SPECIFIED' THEN 'Outbound' ELSE 'Partner' END AS Lead_Source,
  CASE (k * 3 + c) % 5 WHEN 0 THEN 'Commit' WHEN 1 THEN 'Best Case' WHEN 2 THEN 'Upside' WHEN 3 THEN 'Pipeline' ELSE 'Omit' END AS Forecast_Category,
  CASE (k + c) % 4 WHEN 0 THEN 'New Business' WHEN 1 THEN 'Upsell' WHEN 2 THEN 'Cross-sell' ELSE 'Renewal' END AS Deal_Type,
  CAST(floor(price * (1 + c % 5) / 12) AS DOUBLE) AS Quota_Contribution,
  CASE WHEN st <> 'P' THEN NULL WHEN k % 6 = 0 THEN '' ELSE
    CASE k % 6 WHEN 1 THEN 'Price' WHEN 2 THEN 'Timing' WHEN 3 THEN 'Features' WHEN 4 THEN 'No Decision' ELSE 'Budget' END END AS Reason_Lost,
  CASE WHEN st <> 'P' THEN NULL WHEN c % 5 = 0 THEN '' WHEN c % 5 = 1 THEN 'Acme' WHEN c % 5 = 2 THEN 'Globex' WHEN c % 5 = 3 THEN 'Initech' ELSE NULL END AS Competitor_Name,
  CASE WHEN c % 13 = 0 THEN '' WHEN c % 13 = 1 THEN NULL ELSE concat('Campaign-', CAST(c % 13 AS VARCHAR(20))) END AS Campaign_Name,
  'USD' AS Currency,
  CASE WHEN k % 71 = 4 THEN NULL
       WHEN k % 50 = 11 THEN 'TRUE'
       WHEN pr = '3-MEDIUM' AND (k * 11 + c) % 45 > 15 THEN 'TRUE'
       WHEN (k * 11 + c) % 45 > 25 AND k % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS Is_Stalled,
  CASE st WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Won' ELSE 'Lost' END AS Deal_Status,
  CAST((rep * 7 + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) % 60 AS INT) AS Rep_Tenure_Months,
  CAST(cyc AS INT) AS Sales_Cycle_Days
FROM base
"""


def duckdb_text() -> str:
    """The view over the tables as DuckDB knows them."""
    return DEALS_RAW.format(**{t: t for t in TABLES}).strip()


def deals_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The view over the Parquet tables in ``folder``."""
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES}
    return spark.sql(DEALS_RAW, **tables)


@lru_cache(maxsize=8)
def deals(spark: SparkSession, folder: str) -> DataFrame:
    """Typed deals. Only the plan is kept per session and folder, no rows."""
    return ingest(deals_raw(spark, folder))
