"""All reports by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame

from dealflow.config import DEFAULTS, Thresholds
from dealflow.operators import announced, automation, coverage, lead_source, trends

Report = Callable[..., DataFrame]

REPORTS: dict[str, Report] = {
    f.__name__: f
    for f in (
        trends.ytd_won_lost_by_rep,
        trends.ytd_quota_attainment,
        trends.stuck_deals_by_rep,
        trends.ytd_monthly_progression,
        trends.peak_and_lowest_months,
        trends.rep_leaderboard,
        coverage.pipeline_by_close_window,
        coverage.coverage_by_rep,
        coverage.coverage_by_forecast_category,
        coverage.coverage_by_region,
        coverage.coverage_health,
        lead_source.source_by_stage,
        lead_source.stage_conversion,
        lead_source.cycle_by_outcome,
        lead_source.velocity_scorecard,
        lead_source.cycle_length_distribution,
        lead_source.stall_rate,
        lead_source.decay_funnel,
        lead_source.deal_type_fit,
        lead_source.tier_distribution,
        lead_source.source_quality,
        lead_source.campaign_performance,
        lead_source.top_campaigns,
        lead_source.monthly_creation_by_source,
        lead_source.quarterly_win_rate,
        lead_source.best_worst_month,
        lead_source.competitive_loss_rate,
        lead_source.source_competitor_matrix,
        lead_source.source_scorecard,
        automation.deal_health_scores,
        automation.health_by_rep,
        automation.priority_queue,
        automation.forecast_suggestions,
        automation.pipeline_gap_alerts,
        automation.stale_deal_reminders,
        automation.loss_patterns,
        automation.coaching_prompts,
        automation.week_created,
        automation.week_created_deals,
        automation.week_closed,
        automation.week_stalled,
        automation.week_stalled_deals,
        automation.weekly_digest,
        automation.rep_capability,
        automation.deal_rep_matches,
        announced.pipeline_by_stage,
        announced.stuck_deals,
        announced.won_lost_pct_by_month,
        announced.won_lost_pct_by_quarter,
        announced.won_lost_pct_by_year,
        announced.top_loss_reasons,
        announced.weekly_deal_creation,
        announced.mom_creation,
        announced.commit_accuracy,
    )
}


def run(
    name: str, deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Result of the report called ``name``."""
    if name not in REPORTS:
        raise KeyError(f"no report {name!r}; there are {', '.join(sorted(REPORTS))}")
    return REPORTS[name](deals, as_of, cfg)
