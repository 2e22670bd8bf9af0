"""Open pipeline by closing window, and its ratio to the quota."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow import labels as L
from dealflow.config import DEFAULTS, Thresholds
from dealflow.functions import dates as D
from dealflow.functions import exprs as X

REP = ["Sales_Rep", "Region"]


def _coverage(value: str, quota: str) -> Column:
    return X.quota_ratio(X.whole(F.col(value)), F.col(quota))


def pipeline_by_close_window(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals per rep and region, split by days to the expected close.

    A deal without a valid expected close counts in the totals only.
    """
    near, mid = X.closes_near(as_of, cfg), X.closes_mid(as_of, cfg)
    return (
        deals.where(X.is_open())
        .groupBy(*REP)
        .agg(
            F.count("*").alias("total_open_deals"),
            F.sum(X.size()).alias("total_pipeline"),
            X.sum_if(near, X.size()).alias("pipeline_0_30_days"),
            F.count_if(near).alias("deals_0_30_days"),
            X.sum_if(mid, X.size()).alias("pipeline_31_90_days"),
            F.count_if(mid).alias("deals_31_90_days"),
            X.sum_if(X.closes_late(as_of, cfg), X.size()).alias("pipeline_90_plus_days"),
            X.sum_if(D.overdue(as_of), X.size()).alias("pipeline_overdue"),
        )
        .orderBy(F.desc("total_pipeline"), *REP)
    )


def coverage_by_rep(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Pipeline, probability-weighted pipeline and closing windows against the quota."""
    totals = (
        deals.where(X.is_open())
        .groupBy(*REP)
        .agg(
            F.sum(X.size()).alias("total_pipeline"),
            X.weighted_size().alias("_weighted"),
            X.quota_total(F.col("Quota_Contribution")).alias("quota_target"),
            X.sum_if(X.closes_near(as_of, cfg), X.size()).alias("pipeline_0_30_days"),
            X.sum_if(X.closes_mid(as_of, cfg), X.size()).alias("pipeline_31_90_days"),
        )
    )
    weighted = X.hundredths(F.col("_weighted"))
    return totals.select(
        *REP,
        "total_pipeline",
        weighted.cast("double").alias("weighted_pipeline"),
        "quota_target",
        _coverage("total_pipeline", "quota_target").alias("pipeline_coverage_ratio"),
        X.quota_ratio(weighted, F.col("quota_target")).alias("weighted_coverage_ratio"),
        "pipeline_0_30_days",
        _coverage("pipeline_0_30_days", "quota_target").alias("coverage_0_30_days"),
        "pipeline_31_90_days",
        _coverage("pipeline_31_90_days", "quota_target").alias("coverage_31_90_days"),
    ).orderBy(F.desc("pipeline_coverage_ratio"), *REP)


def coverage_by_forecast_category(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals per rep, region and forecast category."""
    return (
        deals.where(X.is_open())
        .groupBy(*REP, "Forecast_Category")
        .agg(
            F.count("*").alias("deal_count"),
            F.sum(X.size()).alias("pipeline_value"),
            X.hundredths(X.weighted_size()).cast("double").alias("weighted_value"),
            X.sum_if(X.closes_near(as_of, cfg), X.size()).alias("value_0_30_days"),
            X.sum_if(X.closes_mid(as_of, cfg), X.size()).alias("value_31_90_days"),
        )
        .orderBy("Sales_Rep", "Forecast_Category", "Region")
    )


def coverage_by_region(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open pipeline, quota and number of reps per region.

    Deals are first added up per region and rep, so that a region with most of the
    deals is spread over its reps before it becomes one row.
    """
    by_rep = (
        deals.where(X.is_open())
        .groupBy("Region", "Sales_Rep")
        .agg(
            F.sum(X.size()).alias("total_pipeline"),
            X.weighted_size().alias("_weighted"),
            X.quota_sum(F.col("Quota_Contribution")).alias("total_quota"),
            X.sum_if(X.closes_near(as_of, cfg), X.size()).alias("pipeline_0_30_days"),
            X.sum_if(X.closes_mid(as_of, cfg), X.size()).alias("pipeline_31_90_days"),
            X.sum_if(X.closes_late(as_of, cfg), X.size()).alias("pipeline_90_plus_days"),
        )
    )
    totals = by_rep.groupBy("Region").agg(
        F.count("Sales_Rep").alias("rep_count"),
        *[F.sum(c).alias(c) for c in by_rep.columns if c not in ("Region", "Sales_Rep")],
    )
    totals = totals.withColumn("total_quota", X.quota_double(F.col("total_quota")))
    return totals.select(
        "Region",
        "rep_count",
        "total_pipeline",
        X.hundredths(F.col("_weighted")).cast("double").alias("weighted_pipeline"),
        "total_quota",
        _coverage("total_pipeline", "total_quota").alias("region_coverage_ratio"),
        "pipeline_0_30_days",
        "pipeline_31_90_days",
        "pipeline_90_plus_days",
    ).orderBy(F.desc("region_coverage_ratio"), "Region")


def coverage_health(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Every rep and region with a label for its rounded coverage ratio.

    Without a quota there is no ratio, and the label is the healthy one.
    """
    totals = (
        deals.where(X.is_open())
        .groupBy(*REP)
        .agg(
            F.sum(X.size()).alias("total_pipeline"),
            X.quota_total(F.col("Quota_Contribution")).alias("quota_target"),
            X.sum_if(X.closes_near(as_of, cfg), X.size()).alias("pipeline_0_30_days"),
            X.sum_if(X.closes_mid(as_of, cfg), X.size()).alias("pipeline_31_90_days"),
        )
        .withColumn("coverage_ratio", _coverage("total_pipeline", "quota_target"))
    )
    critical, at_risk, healthy = cfg.coverage_cuts
    ratio = F.col("coverage_ratio")
    health = (
        F.when(ratio < critical, L.COVERAGE_CRITICAL)
        .when(ratio < at_risk, L.COVERAGE_AT_RISK)
        .when(ratio < healthy, L.COVERAGE_BELOW_TARGET)
        .otherwise(L.COVERAGE_HEALTHY)
    )
    return totals.select(
        *REP,
        "total_pipeline",
        "quota_target",
        "coverage_ratio",
        "pipeline_0_30_days",
        "pipeline_31_90_days",
        health.alias("coverage_health"),
    ).orderBy("coverage_ratio", *REP)
