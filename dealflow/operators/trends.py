"""Results of the year, stuck deals and monthly trends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflow import labels as L
from dealflow.config import DEFAULTS, Thresholds
from dealflow.functions import dates as D
from dealflow.functions import exprs as X
from dealflow.plans import ranked, with_lists

REP = ["Sales_Rep", "Region"]


def _closed_this_year(deals: DataFrame, as_of: dt.date | None) -> DataFrame:
    return deals.where(X.is_closed() & D.in_year(F.col("Close_Date"), as_of))


def ytd_won_lost_by_rep(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Deals won and lost this year per rep and region, by number and value."""
    totals = (
        _closed_this_year(deals, as_of)
        .groupBy(*REP)
        .agg(
            F.count_if(X.is_won()).alias("won_deals"),
            F.count_if(X.is_lost()).alias("lost_deals"),
            X.sum_if(X.is_won(), X.size()).alias("ytd_won_value"),
            X.sum_if(X.is_lost(), X.size()).alias("ytd_lost_value"),
            F.sum(X.size()).alias("_value"),
        )
    )
    return totals.select(
        *REP,
        "won_deals",
        "lost_deals",
        "ytd_won_value",
        "ytd_lost_value",
        (F.col("ytd_won_value") - F.col("ytd_lost_value")).alias("net_value"),
        X.win_rate(F.col("won_deals"), F.col("lost_deals")).alias("win_rate_pct"),
        X.pct(F.col("ytd_won_value"), F.col("_value")).alias("won_value_pct"),
    ).orderBy(F.desc("ytd_won_value"), *REP)


def ytd_quota_attainment(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Won value of the year against the quota of the won deals, per rep and region."""
    cycle = F.col("Sales_Cycle_Days")
    totals = (
        _closed_this_year(deals, as_of)
        .groupBy(*REP)
        .agg(
            X.sum_if(X.is_won(), X.size()).alias("ytd_won_value"),
            X.sum_if(X.is_lost(), X.size()).alias("ytd_lost_value"),
            X.quota_total(F.when(X.is_won(), F.col("Quota_Contribution")).otherwise(0.0)).alias(
                "ytd_quota_contribution"
            ),
            X.average(F.when(X.is_won(), X.size())).alias("avg_won_deal_size"),
            X.average(F.when(X.is_lost(), X.size())).alias("avg_lost_deal_size"),
            X.average(F.when(X.is_won(), cycle)).alias("avg_won_cycle_days"),
            X.average(F.when(X.is_lost(), cycle)).alias("avg_lost_cycle_days"),
        )
    )
    attainment = X.quota_ratio(
        X.whole(F.col("ytd_won_value")), F.col("ytd_quota_contribution"), 1, factor=100
    )
    return totals.select(
        *REP,
        "ytd_won_value",
        "ytd_lost_value",
        "ytd_quota_contribution",
        attainment.alias("quota_attainment_pct"),
        "avg_won_deal_size",
        "avg_lost_deal_size",
        "avg_won_cycle_days",
        "avg_lost_cycle_days",
    ).orderBy(F.desc("ytd_won_value"), *REP)


def stuck_deals_by_rep(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals too long in their stage, per rep and region, with the stages concerned."""
    totals = with_lists(
        deals.where(X.is_open() & (F.col("Days_in_Stage") > cfg.stuck_days)),
        REP,
        {
            "stuck_deals": F.count("*"),
            "total_stuck_value": F.sum(X.size()),
            "_days": F.sum("Days_in_Stage"),
        },
        {"stages_affected": (F.col("Stage"), ", ")},
        cfg,
    )
    return totals.select(
        *REP,
        "stuck_deals",
        "total_stuck_value",
        X.mean(F.col("_days"), F.col("stuck_deals")).alias("avg_days_stuck"),
        "stages_affected",
    ).orderBy(F.desc("stuck_deals"), *REP)


def ytd_monthly_progression(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Deals won and lost per rep and closing month of the year."""
    return (
        _closed_this_year(deals, as_of)
        .groupBy("Sales_Rep", D.month(F.col("Close_Date")).alias("close_month"))
        .agg(
            X.sum_if(X.is_won(), X.size()).alias("won_value"),
            X.sum_if(X.is_lost(), X.size()).alias("lost_value"),
            F.count_if(X.is_won()).alias("won_deals"),
            F.count_if(X.is_lost()).alias("lost_deals"),
        )
        .orderBy("Sales_Rep", "close_month")
    )


def peak_and_lowest_months(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Months ranked by deals created, the highest and lowest flagged.

    Texts that are no date form one NULL month. The windows see one row per month.
    """
    months = (
        deals.where(X.present(F.col("Created_Date_raw")))
        .groupBy(D.month(F.col("Created_Date")).alias("created_month"))
        .agg(F.count("*").alias("deals_created"), F.sum(X.size()).alias("total_pipeline_added"))
    )
    everything = Window.partitionBy()
    flag = (
        F.when(F.col("deals_created") == F.max("deals_created").over(everything), L.PEAK)
        .when(F.col("deals_created") == F.min("deals_created").over(everything), L.LOWEST)
        .otherwise("")
    )
    return months.select(
        "created_month",
        "deals_created",
        "total_pipeline_added",
        F.rank().over(Window.orderBy(F.desc("deals_created"))).alias("rank_by_count"),
        flag.alias("flag"),
    ).orderBy(F.desc("deals_created"), "created_month")


def rep_leaderboard(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Reps ranked by value won this year, one row per rep and region, at any number of them."""
    totals = (
        _closed_this_year(deals, as_of)
        .groupBy(*REP)
        .agg(
            X.sum_if(X.is_won(), X.size()).alias("ytd_won_value"),
            X.sum_if(X.is_lost(), X.size()).alias("ytd_lost_value"),
            F.count_if(X.is_won()).alias("won_deals"),
            F.count_if(X.is_lost()).alias("lost_deals"),
        )
    )
    return ranked(totals, "ytd_won_value", REP, "leaderboard_rank", cfg).select(
        "leaderboard_rank",
        *REP,
        "won_deals",
        "lost_deals",
        "ytd_won_value",
        "ytd_lost_value",
        (F.col("ytd_won_value") - F.col("ytd_lost_value")).alias("net_value"),
        X.win_rate(F.col("won_deals"), F.col("lost_deals")).alias("win_rate_pct"),
    )
