"""How the sources of leads compare: conversion, speed, decay, mix, season, competition."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow import labels as L
from dealflow.config import DEFAULTS, Thresholds
from dealflow.functions import dates as D
from dealflow.functions import exprs as X
from dealflow.plans import with_lists

SOURCE = "Lead_Source"


def _won() -> Column:
    return F.count_if(X.is_won())


def _lost() -> Column:
    return F.count_if(X.is_lost())


def _won_value() -> Column:
    return X.sum_if(X.is_won(), X.size())


def _won_only(name: str) -> Column:
    return F.when(X.is_won(), F.col(name))


def _has_competitor() -> Column:
    return X.is_lost() & X.present(F.col("Competitor_Name"))


def _stalled_open() -> Column:
    return X.is_open() & X.is_stalled()


def _revenue_per_day(value: Column, days: Column, deals: Column) -> Column:
    """Won value over the mean cycle, unrounded: value * deals / days in one division."""
    product = (value.cast("decimal(20,0)") * deals.cast("decimal(18,0)")).cast("decimal(38,0)")
    return product / F.nullif(days.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def source_by_stage(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Deals per source and current stage, with the win rate of the closed ones."""
    return (
        deals.groupBy(SOURCE, "Stage")
        .agg(
            F.count("*").alias("deal_count"),
            F.sum(X.size()).alias("total_value"),
            X.average(F.col("Win_Probability")).alias("avg_win_probability"),
            _won().alias("won"),
            _lost().alias("lost"),
            X.win_rate(_won(), _lost()).alias("stage_win_rate_pct"),
        )
        .orderBy(SOURCE, "Stage")
    )


def stage_conversion(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """How far the deals of a source have come, by their current stage."""

    def reached(stage: str) -> Column:
        return F.count_if(F.col("Stage").isin(*L.STAGES[L.STAGES.index(stage) :]))

    return (
        deals.groupBy(SOURCE)
        .agg(
            F.count("*").alias("total_deals"),
            reached(L.QUALIFICATION).alias("past_qualification"),
            reached(L.PROPOSAL).alias("past_proposal"),
            reached(L.NEGOTIATION).alias("past_negotiation"),
            _won().alias("closed_won"),
            X.pct(reached(L.PROPOSAL), F.count("*")).alias("pct_reach_proposal"),
            X.pct(_won(), F.count("*")).alias("pct_closed_won"),
        )
        .orderBy(F.desc("pct_closed_won"), SOURCE)
    )


def cycle_by_outcome(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Sales cycle and size of closed deals per source and outcome."""
    cycle = F.col("Sales_Cycle_Days")
    return (
        deals.where(X.is_closed())
        .groupBy(SOURCE, "Deal_Status")
        .agg(
            F.count("*").alias("deal_count"),
            X.average(cycle).alias("avg_cycle_days"),
            F.min(cycle).alias("fastest_cycle"),
            F.max(cycle).alias("slowest_cycle"),
            X.average(X.size()).alias("avg_deal_size"),
        )
        .orderBy(SOURCE, "Deal_Status")
    )


def velocity_scorecard(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Sources ranked by won value per day of the mean won cycle.

    The rank takes the unrounded value; its window sees one row per source.
    """
    totals = (
        deals.where(X.is_closed())
        .groupBy(SOURCE)
        .agg(
            _won().alias("won_deals"),
            _lost().alias("_lost"),
            F.sum(_won_only("Sales_Cycle_Days")).alias("_days"),
            F.count(_won_only("Sales_Cycle_Days")).alias("_timed"),
            _won_value().alias("total_won_value"),
        )
        .withColumn(
            "_per_day",
            _revenue_per_day(F.col("total_won_value"), F.col("_days"), F.col("_timed")),
        )
    )
    return totals.select(
        SOURCE,
        "won_deals",
        X.mean(F.col("_days"), F.col("_timed")).alias("avg_won_cycle_days"),
        "total_won_value",
        F.round("_per_day", 0).cast("double").alias("revenue_per_day"),
        X.win_rate(F.col("won_deals"), F.col("_lost")).alias("win_rate_pct"),
        F.rank().over(Window.orderBy(F.desc("_per_day"))).alias("velocity_rank"),
    ).orderBy("velocity_rank", SOURCE)


def cycle_length_distribution(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Closed deals per source and bucket of the sales cycle."""
    return (
        deals.where(X.is_closed())
        .groupBy(SOURCE, X.cycle_bucket(cfg).alias("cycle_bucket"))
        .agg(
            F.count("*").alias("deal_count"),
            _won().alias("won"),
            X.pct(_won(), F.count("*")).alias("win_rate_pct"),
        )
        .orderBy(SOURCE, "cycle_bucket")
    )


def stall_rate(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals per source and how many of them are stalled."""
    stalled = F.count_if(X.is_stalled())
    return (
        deals.where(X.is_open())
        .groupBy(SOURCE)
        .agg(
            F.count("*").alias("total_open_deals"),
            stalled.alias("stalled_deals"),
            X.pct(stalled, F.count("*")).alias("stall_rate_pct"),
            X.sum_if(X.is_stalled(), X.size()).alias("stalled_value"),
            X.average(F.when(X.is_stalled(), F.col("Days_in_Stage"))).alias("avg_days_stuck"),
            X.average(D.days_idle(as_of)).alias("avg_days_since_activity"),
        )
        .orderBy(F.desc("stall_rate_pct"), SOURCE)
    )


def decay_funnel(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """What became of the deals of a source. An open deal with no stall flag is in no class."""
    stalled = F.count_if(_stalled_open())
    return (
        deals.groupBy(SOURCE)
        .agg(
            F.count("*").alias("total_created"),
            F.count_if(X.is_open() & (F.col("Is_Stalled") == L.NOT_STALLED)).alias("active_open"),
            stalled.alias("stalled"),
            _won().alias("won"),
            _lost().alias("lost"),
            X.pct(stalled, F.count("*")).alias("pct_decayed"),
            X.pct(_lost() + stalled, F.count("*")).alias("total_waste_pct"),
        )
        .orderBy(F.desc("total_waste_pct"), SOURCE)
    )


def _mix(deals: DataFrame, column: str, share: str) -> DataFrame:
    """Deals per source and value of ``column``, with the share in the source."""
    return (
        deals.groupBy(SOURCE, column)
        .agg(
            F.count("*").alias("deal_count"),
            F.sum(X.size()).alias("total_value"),
            X.average(X.size()).alias("avg_deal_size"),
            _won().alias("won"),
            X.win_rate(_won(), _lost()).alias("win_rate_pct"),
        )
        .withColumn(
            share,
            X.pct(F.col("deal_count"), F.sum("deal_count").over(Window.partitionBy(SOURCE))),
        )
    )


def deal_type_fit(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Deal types of each source."""
    return _mix(deals, "Deal_Type", "pct_of_source_total").orderBy(
        SOURCE, F.desc("deal_count"), "Deal_Type"
    )


def tier_distribution(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Account tiers of each source."""
    return _mix(deals, "Account_Tier", "pct_of_source").orderBy(SOURCE, "Account_Tier")


def source_quality(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Account tiers per source and won value per lead."""

    def tier(name: str) -> Column:
        return F.count_if(F.col("Account_Tier") == name)

    enterprise_won = X.is_won() & (F.col("Account_Tier") == L.ENTERPRISE)
    return (
        deals.groupBy(SOURCE)
        .agg(
            F.count("*").alias("total_deals"),
            tier(L.ENTERPRISE).alias("enterprise_deals"),
            tier(L.MID_MARKET).alias("midmarket_deals"),
            tier(L.SMB).alias("smb_deals"),
            X.pct(tier(L.ENTERPRISE), F.count("*")).alias("pct_enterprise"),
            X.per(_won_value(), F.count("*"), 0).alias("revenue_per_lead"),
            X.per(X.sum_if(enterprise_won, X.size()), tier(L.ENTERPRISE), 0).alias(
                "revenue_per_enterprise_lead"
            ),
        )
        .orderBy(F.desc("revenue_per_lead"), SOURCE)
    )


def campaign_performance(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Results per source and campaign."""
    return (
        deals.where(X.present(F.col("Campaign_Name")))
        .groupBy(SOURCE, "Campaign_Name")
        .agg(
            F.count("*").alias("total_deals"),
            _won().alias("won"),
            _lost().alias("lost"),
            X.win_rate(_won(), _lost()).alias("win_rate_pct"),
            _won_value().alias("won_value"),
            X.average(_won_only("Deal_Size")).alias("avg_won_deal_size"),
            X.average(_won_only("Sales_Cycle_Days")).alias("avg_won_cycle_days"),
            X.per(_won_value(), F.count("*"), 0).alias("revenue_per_deal_generated"),
        )
        .orderBy(F.desc("won_value"), SOURCE, "Campaign_Name")
    )


def top_campaigns(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """The campaigns with the highest won value, and the account tiers they reached."""
    totals = with_lists(
        deals.where(X.is_closed() & X.present(F.col("Campaign_Name"))),
        ["Campaign_Name", SOURCE],
        {"total_deals": F.count("*"), "won": _won(), "_lost": _lost(), "_value": _won_value()},
        {"tiers_reached": (F.col("Account_Tier"), ", ")},
        cfg,
    )
    return (
        totals.select(
            "Campaign_Name",
            SOURCE,
            "total_deals",
            "won",
            X.win_rate(F.col("won"), F.col("_lost")).alias("win_rate_pct"),
            F.col("_value").alias("total_won_value"),
            "tiers_reached",
        )
        .orderBy(F.desc("total_won_value"), "Campaign_Name", SOURCE)
        .limit(cfg.top_n)
    )


def monthly_creation_by_source(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Deals created per source and month."""
    return (
        deals.where(X.present(F.col("Created_Date_raw")))
        .groupBy(SOURCE, D.month(F.col("Created_Date")).alias("created_month"))
        .agg(
            F.count("*").alias("deals_created"),
            F.sum(X.size()).alias("pipeline_added"),
            X.average(X.size()).alias("avg_deal_size"),
        )
        .orderBy(SOURCE, "created_month")
    )


def quarterly_win_rate(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Closed deals and win rate per source and quarter, such as ``2001-Q3``."""
    close = F.col("Close_Date")
    quarter = F.concat(F.year(close).cast("string"), F.lit("-Q"), F.quarter(close).cast("string"))
    return (
        deals.where(X.is_closed() & X.present(F.col("Close_Date_raw")))
        .groupBy(SOURCE, quarter.alias("close_quarter"))
        .agg(
            F.count("*").alias("closed_deals"),
            _won().alias("won"),
            X.pct(_won(), F.count("*")).alias("win_rate_pct"),
            _won_value().alias("won_value"),
        )
        .orderBy(SOURCE, "close_quarter")
    )


def best_worst_month(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Months of the year, over all years, in which a source creates most and fewest deals.

    The windows see at most 13 rows per source: twelve months and the unreadable dates.
    """
    months = (
        deals.where(X.present(F.col("Created_Date_raw")))
        .groupBy(SOURCE, F.month("Created_Date").alias("_month"))
        .agg(F.count("*").alias("deals_created"), F.sum(X.size()).alias("pipeline_added"))
    )
    per_source = Window.partitionBy(SOURCE)
    ranked = months.withColumns(
        {
            "_best": F.rank().over(per_source.orderBy(F.desc("deals_created"))),
            "_worst": F.rank().over(per_source.orderBy("deals_created")),
        }
    ).where((F.col("_best") == 1) | (F.col("_worst") == 1))
    # Any date of the month serves to spell its name.
    name = F.date_format(F.make_date(F.lit(2000), F.col("_month"), F.lit(1)), "MMMM")
    return (
        ranked.orderBy(SOURCE, "_best", "_month")
        .select(
            SOURCE,
            name.alias("month_name"),
            "deals_created",
            "pipeline_added",
            F.when(F.col("_best") == 1, L.BEST_MONTH).otherwise(L.WORST_MONTH).alias("label"),
        )
    )


def competitive_loss_rate(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Share of losses to a named competitor per source."""
    totals = with_lists(
        deals,
        [SOURCE],
        {
            "total_losses": _lost(),
            "competitive_losses": F.count_if(_has_competitor()),
            "competitive_lost_value": X.sum_if(_has_competitor(), X.size()),
        },
        {"competitors_faced": (F.when(_has_competitor(), F.col("Competitor_Name")), ", ")},
        cfg,
    )
    return totals.select(
        SOURCE,
        "total_losses",
        "competitive_losses",
        X.pct(F.col("competitive_losses"), F.col("total_losses")).alias(
            "competitive_loss_rate_pct"
        ),
        "competitive_lost_value",
        "competitors_faced",
    ).orderBy(F.desc("competitive_loss_rate_pct"), SOURCE)


def source_competitor_matrix(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Losses per source and competitor. An empty reason is a reason in the list."""
    totals = with_lists(
        deals.where(_has_competitor()),
        [SOURCE, "Competitor_Name"],
        {
            "losses_to_competitor": F.count("*"),
            "lost_value": F.sum(X.size()),
            "_sized": F.count(X.size()),
            "_days": F.sum("Sales_Cycle_Days"),
            "_timed": F.count("Sales_Cycle_Days"),
        },
        {"loss_reasons": (F.col("Reason_Lost"), ", ")},
        cfg,
    )
    return totals.select(
        SOURCE,
        "Competitor_Name",
        "losses_to_competitor",
        "lost_value",
        X.mean(F.col("lost_value"), F.col("_sized")).alias("avg_lost_deal_size"),
        X.mean(F.col("_days"), F.col("_timed")).alias("avg_cycle_days"),
        "loss_reasons",
    ).orderBy(SOURCE, F.desc("losses_to_competitor"), "Competitor_Name")


def source_scorecard(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """One line per source over all dimensions, graded on the rounded rates.

    A source without open deals has no stall rate and cannot get the best grade.
    """
    totals = deals.groupBy(SOURCE).agg(
        F.count("*").alias("total_deals"),
        X.win_rate(_won(), _lost()).alias("win_rate_pct"),
        _won_value().alias("total_won_value"),
        X.per(_won_value(), F.count("*"), 0).alias("revenue_per_lead"),
        X.average(_won_only("Sales_Cycle_Days")).alias("avg_won_cycle_days"),
        F.round(
            _revenue_per_day(
                _won_value(),
                F.sum(_won_only("Sales_Cycle_Days")),
                F.count(_won_only("Sales_Cycle_Days")),
            ),
            0,
        )
        .cast("double")
        .alias("revenue_per_day"),
        X.pct(F.count_if(_stalled_open()), F.count_if(X.is_open())).alias("stall_rate_pct"),
        X.pct(F.count_if(F.col("Account_Tier") == L.ENTERPRISE), F.count("*")).alias(
            "pct_enterprise"
        ),
        X.pct(F.count_if(_has_competitor()), _lost()).alias("competitive_loss_rate_pct"),
    )
    win, stall = F.col("win_rate_pct"), F.col("stall_rate_pct")
    grade = (
        F.when((win >= cfg.grade_a_win) & (stall < cfg.grade_a_stall), L.GRADE_A)
        .when(win >= cfg.grade_b_win, L.GRADE_B)
        .when(stall >= cfg.grade_d_stall, L.GRADE_D)
        .otherwise(L.GRADE_C)
    )
    return totals.withColumn("source_grade", grade).orderBy(F.desc("revenue_per_lead"), SOURCE)
