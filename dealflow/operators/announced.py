"""Further reports on stages, outcomes, loss reasons, creation and commit accuracy.

These are named in the list of reports without queries of their own; what they compute
is defined here.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflow import labels as L
from dealflow.config import DEFAULTS, Thresholds
from dealflow.functions import dates as D
from dealflow.functions import exprs as X


def pipeline_by_stage(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Number, value and probability-weighted value per stage and status."""
    return (
        deals.groupBy("Stage", "Deal_Status")
        .agg(
            F.count("*").alias("deal_count"),
            F.sum(X.size()).alias("total_value"),
            X.hundredths(X.weighted_size()).cast("double").alias("weighted_value"),
        )
        .orderBy("Stage", "Deal_Status")
    )


def stuck_deals(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals too long in their stage, longest first."""
    return (
        deals.where(X.is_open() & (F.col("Days_in_Stage") > cfg.stuck_days))
        .select(
            "Opportunity_ID",
            "Opportunity_Name",
            "Sales_Rep",
            "Region",
            "Stage",
            "Deal_Size",
            "Days_in_Stage",
        )
        .orderBy(F.desc("Days_in_Stage"), "Opportunity_ID")
    )


def _won_lost_pct(deals: DataFrame, start: str) -> DataFrame:
    won, lost = F.count_if(X.is_won()), F.count_if(X.is_lost())
    return (
        deals.where(X.is_closed() & X.present(F.col("Close_Date_raw")))
        .groupBy(F.trunc("Close_Date", start).cast("string").alias("period_start"))
        .agg(
            won.alias("won"),
            lost.alias("lost"),
            X.pct(won, won + lost).alias("won_pct"),
            X.pct(lost, won + lost).alias("lost_pct"),
        )
        .orderBy("period_start")
    )


def won_lost_pct_by_month(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Shares of won and lost deals per closing month; NULL for dates that cannot be read."""
    return _won_lost_pct(deals, "month")


def won_lost_pct_by_quarter(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Shares of won and lost deals per closing quarter; NULL for dates that cannot be read."""
    return _won_lost_pct(deals, "quarter")


def won_lost_pct_by_year(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Shares of won and lost deals per closing year; NULL for dates that cannot be read."""
    return _won_lost_pct(deals, "year")


def top_loss_reasons(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """The most frequent reasons given for lost deals."""
    return (
        deals.where(X.is_lost() & X.present(F.col("Reason_Lost")))
        .groupBy("Reason_Lost")
        .agg(F.count("*").alias("lost_deals"), F.sum(X.size()).alias("lost_value"))
        .orderBy(F.desc("lost_deals"), "Reason_Lost")
        .limit(cfg.top_reasons)
    )


def weekly_deal_creation(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Deals created per week, named by its Monday; NULL for dates that cannot be read."""
    return (
        deals.where(X.present(F.col("Created_Date_raw")))
        .groupBy(F.trunc("Created_Date", "week").cast("string").alias("week_start"))
        .agg(F.count("*").alias("deals_created"), F.sum(X.size()).alias("pipeline_added"))
        .orderBy("week_start")
    )


def mom_creation(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Deals created per month against the month before in the list and the best month.

    Deals whose date cannot be read are a group of their own, with a NULL month, which is
    compared with no other. The windows see one row per month.
    """
    months = (
        deals.where(X.present(F.col("Created_Date_raw")))
        .groupBy(D.month(F.col("Created_Date")).alias("created_month"))
        .agg(F.count("*").alias("deals_created"))
    )
    month = F.col("created_month")
    previous = F.lag("deals_created").over(Window.partitionBy(month.isNull()).orderBy(month))
    dated = F.when(month.isNotNull(), F.col("deals_created"))
    best = F.when(month.isNotNull(), F.max(dated).over(Window.partitionBy()))
    return (
        months.withColumns({"previous_month": previous, "max_month": best})
        .withColumn("change", F.col("deals_created") - F.col("previous_month"))
        .withColumn("pct_of_max", X.pct(F.col("deals_created"), F.col("max_month")))
        .orderBy("created_month")
    )


def commit_accuracy(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """How often the closed deals that a rep had committed were won, with a profile."""
    won, lost = F.count_if(X.is_won()), F.count_if(X.is_lost())
    high, good, low = cfg.accuracy_cuts
    rate = F.col("accuracy_pct")
    profile = (
        F.when(rate >= high, L.ACCURACY_HIGH)
        .when(rate >= good, L.ACCURACY_GOOD)
        .when(rate >= low, L.ACCURACY_LOW)
        .otherwise(L.ACCURACY_POOR)
    )
    return (
        deals.where(X.is_closed() & (F.col("Forecast_Category") == L.COMMIT))
        .groupBy("Sales_Rep")
        .agg(
            won.alias("committed_won"),
            lost.alias("committed_lost"),
            X.win_rate(won, lost).alias("accuracy_pct"),
        )
        .withColumn("profile", profile)
        .orderBy(F.desc("accuracy_pct"), "Sales_Rep")
    )
