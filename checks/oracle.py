"""SQL for DuckDB that gives the result of each report from the same order tables.

Written from the rules of the reports, with whole-number arithmetic for every rounding. Labels,
texts and thresholds are fixed values of the rules, stated as they are.
"""

from __future__ import annotations

from checks.deals_view import AS_OF, duckdb_text

TODAY = f"DATE '{AS_OF}'"
MONDAY = "DATE '2001-07-16'"

WON = "Deal_Status = 'Won'"
LOST = "Deal_Status = 'Lost'"
OPEN = "Deal_Status = 'Open'"
CLOSED = "Deal_Status IN ('Won', 'Lost')"
STALLED = "Is_Stalled = 'TRUE'"
THIS_YEAR = "Close_Date BETWEEN DATE '2001-01-01' AND DATE '2001-12-31'"
TO_CLOSE = f"CAST(date_diff('day', {TODAY}, Expected_Close_Date) AS INTEGER)"
IDLE = f"CAST(date_diff('day', Last_Activity_Date, {TODAY}) AS INTEGER)"
OVERDUE = f"Expected_Close_Date < {TODAY}"
NEAR = f"{TO_CLOSE} BETWEEN 0 AND 30"
MID = f"{TO_CLOSE} BETWEEN 31 AND 90"
LATER = f"{TO_CLOSE} > 90"
COMPETITOR = f"({LOST} AND Competitor_Name <> '')"
SIZE_TIER = (
    "CASE WHEN Deal_Size IS NULL OR Deal_Size >= 100000 THEN 'Enterprise' "
    "WHEN Deal_Size >= 50000 THEN 'Large' WHEN Deal_Size >= 10000 THEN 'Mid' ELSE 'Small' END"
)


def _n(condition: str) -> str:
    """Number of rows for which the condition holds."""
    return f"count(*) FILTER (WHERE {condition})"


def _total(value: str) -> str:
    return f"CAST(sum({value}) AS BIGINT)"


def _total_if(condition: str, value: str = "Deal_Size") -> str:
    """Sum in which rows outside the condition count as 0."""
    return _total(f"CASE WHEN {condition} THEN {value} ELSE 0 END")


def _round(n: str, d: str, digits: int, factor: int = 1) -> str:
    """factor * n / d for d >= 0, rounded half away from zero."""
    scale = 10**digits
    top, low = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    rounded = f"((abs({top}) * {2 * factor * scale} + {low}) // (2 * {low}))"
    return f"(CASE WHEN {low} <> 0 THEN CAST(sign({top}) * {rounded} AS DOUBLE) / {scale} END)"


def _pct(n: str, d: str, digits: int = 1) -> str:
    return _round(n, d, digits, 100)


def _mean(value: str, where: str = "TRUE") -> str:
    """Average to four decimals over the rows of a condition."""
    shown = f"CASE WHEN {where} THEN {value} END"
    return _round(f"sum({shown})", f"count({shown})", 4)


def _ratio(n: str, d: str, digits: int = 2, factor: int = 1, divisor: int = 1) -> str:
    """factor * n / (divisor * d), rounded half to even, for whole n and d in millionths."""
    scale = 10**digits
    top = f"(CAST({n} AS HUGEINT) * {factor * scale * 10**6})"
    low = f"(CAST(round({d} * 1000000) AS HUGEINT) * {divisor})"
    quotient, rest = f"({top} // {low})", f"({top} % {low})"
    up = f"(2 * {rest} > {low} OR (2 * {rest} = {low} AND {quotient} % 2 = 1))"
    return (
        f"(CASE WHEN {low} <> 0 THEN "
        f"CAST({quotient} + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / {scale} END)"
    )


# Quotas are added as decimals, so that the sum is the same in any order.
QUOTA = "CAST(sum(CAST(Quota_Contribution AS DECIMAL(28, 10))) AS DOUBLE)"


def _list(value: str, separator: str = ", ") -> str:
    return f"string_agg(DISTINCT {value}, '{separator}' ORDER BY {value})"


WEIGHTED = "sum(CAST(Deal_Size AS BIGINT) * Win_Probability)"
WEIGHTED_VALUE = f"CAST({WEIGHTED} AS DOUBLE) / 100"
WIN_RATE = _pct(_n(WON), _n(CLOSED))
PER_DAY_PARTS = (
    _total_if(WON),
    f"sum(Sales_Cycle_Days) FILTER (WHERE {WON})",
    f"count(Sales_Cycle_Days) FILTER (WHERE {WON})",
)

TRENDS = {
    "ytd_won_lost_by_rep": f"""
SELECT Sales_Rep, Region, {_n(WON)} AS won_deals, {_n(LOST)} AS lost_deals,
  {_total_if(WON)} AS ytd_won_value, {_total_if(LOST)} AS ytd_lost_value,
  {_total_if(WON)} - {_total_if(LOST)} AS net_value,
  {_pct(_n(WON), 'count(*)')} AS win_rate_pct,
  {_pct(_total_if(WON), 'sum(Deal_Size)')} AS won_value_pct
FROM deals WHERE {CLOSED} AND {THIS_YEAR}
GROUP BY ALL ORDER BY ytd_won_value DESC, Sales_Rep, Region""",
    "ytd_quota_attainment": f"""
SELECT *, {_ratio('ytd_won_value', 'ytd_quota_contribution', 1, 100)} AS quota_attainment_pct
FROM (
  SELECT Sales_Rep, Region, {_total_if(WON)} AS ytd_won_value,
    {_total_if(LOST)} AS ytd_lost_value,
    CAST(sum(CASE WHEN {WON} THEN CAST(Quota_Contribution AS DECIMAL(28, 10)) ELSE 0 END) AS DOUBLE)
      AS ytd_quota_contribution,
    {_mean('Deal_Size', WON)} AS avg_won_deal_size,
    {_mean('Deal_Size', LOST)} AS avg_lost_deal_size,
    {_mean('Sales_Cycle_Days', WON)} AS avg_won_cycle_days,
    {_mean('Sales_Cycle_Days', LOST)} AS avg_lost_cycle_days
  FROM deals WHERE {CLOSED} AND {THIS_YEAR} GROUP BY ALL)
ORDER BY ytd_won_value DESC, Sales_Rep, Region""",
    "stuck_deals_by_rep": f"""
SELECT Sales_Rep, Region, count(*) AS stuck_deals, {_total('Deal_Size')} AS total_stuck_value,
  {_mean('Days_in_Stage')} AS avg_days_stuck, {_list('Stage')} AS stages_affected
FROM deals WHERE {OPEN} AND Days_in_Stage > 7
GROUP BY Sales_Rep, Region ORDER BY stuck_deals DESC, Sales_Rep, Region""",
    "ytd_monthly_progression": f"""
SELECT Sales_Rep, strftime(Close_Date, '%Y-%m') AS close_month,
  {_total_if(WON)} AS won_value, {_total_if(LOST)} AS lost_value,
  {_n(WON)} AS won_deals, {_n(LOST)} AS lost_deals
FROM deals WHERE {CLOSED} AND {THIS_YEAR}
GROUP BY Sales_Rep, close_month ORDER BY Sales_Rep, close_month""",
    "peak_and_lowest_months": f"""
, months AS (
  SELECT strftime(Created_Date, '%Y-%m') AS created_month, count(*) AS deals_created,
    {_total('Deal_Size')} AS total_pipeline_added
  FROM deals WHERE Created_Date_raw <> '' GROUP BY created_month),
extremes AS (SELECT max(deals_created) AS most, min(deals_created) AS fewest FROM months)
SELECT created_month, deals_created, total_pipeline_added,
  CAST(1 + (SELECT count(*) FROM months o WHERE o.deals_created > m.deals_created) AS INTEGER)
    AS rank_by_count,
  CASE deals_created WHEN most THEN 'PEAK' WHEN fewest THEN 'LOWEST' ELSE '' END AS flag
FROM months m, extremes ORDER BY deals_created DESC, created_month NULLS FIRST""",
    "rep_leaderboard": f"""
, totals AS (
  SELECT Sales_Rep, Region, {_n(WON)} AS won_deals, {_n(LOST)} AS lost_deals,
    {_total_if(WON)} AS ytd_won_value, {_total_if(LOST)} AS ytd_lost_value
  FROM deals WHERE {CLOSED} AND {THIS_YEAR} GROUP BY Sales_Rep, Region)
SELECT CAST(rank() OVER (ORDER BY ytd_won_value DESC NULLS LAST) AS INTEGER)
    AS leaderboard_rank, *,
  ytd_won_value - ytd_lost_value AS net_value,
  {_pct('won_deals', '(won_deals + lost_deals)')} AS win_rate_pct
FROM totals ORDER BY leaderboard_rank, Sales_Rep, Region""",
}

COVERAGE = {
    "pipeline_by_close_window": f"""
SELECT Sales_Rep, Region, count(*) AS total_open_deals, {_total('Deal_Size')} AS total_pipeline,
  {_total_if(NEAR)} AS pipeline_0_30_days, {_n(NEAR)} AS deals_0_30_days,
  {_total_if(MID)} AS pipeline_31_90_days, {_n(MID)} AS deals_31_90_days,
  {_total_if(LATER)} AS pipeline_90_plus_days,
  {_total_if(f'{TO_CLOSE} < 0')} AS pipeline_overdue
FROM deals WHERE {OPEN} GROUP BY Sales_Rep, Region
ORDER BY total_pipeline DESC, Sales_Rep, Region""",
    "coverage_by_rep": f"""
, totals AS (
  SELECT Sales_Rep, Region, {_total('Deal_Size')} AS total_pipeline, {WEIGHTED} AS points,
    {QUOTA} AS quota_target,
    {_total_if(NEAR)} AS pipeline_0_30_days, {_total_if(MID)} AS pipeline_31_90_days
  FROM deals WHERE {OPEN} GROUP BY Sales_Rep, Region)
SELECT * EXCLUDE (points), CAST(points AS DOUBLE) / 100 AS weighted_pipeline,
  {_ratio('total_pipeline', 'quota_target')} AS pipeline_coverage_ratio,
  {_ratio('points', 'quota_target', divisor=100)} AS weighted_coverage_ratio,
  {_ratio('pipeline_0_30_days', 'quota_target')} AS coverage_0_30_days,
  {_ratio('pipeline_31_90_days', 'quota_target')} AS coverage_31_90_days
FROM totals ORDER BY pipeline_coverage_ratio DESC NULLS LAST, Sales_Rep, Region""",
    "coverage_by_forecast_category": f"""
SELECT Sales_Rep, Region, Forecast_Category, count(*) AS deal_count,
  {_total('Deal_Size')} AS pipeline_value, {WEIGHTED_VALUE} AS weighted_value,
  {_total_if(NEAR)} AS value_0_30_days, {_total_if(MID)} AS value_31_90_days
FROM deals WHERE {OPEN} GROUP BY Sales_Rep, Region, Forecast_Category
ORDER BY Sales_Rep, Forecast_Category, Region""",
    "coverage_by_region": f"""
SELECT Region, count(DISTINCT Sales_Rep) AS rep_count, {_total('Deal_Size')} AS total_pipeline,
  {WEIGHTED_VALUE} AS weighted_pipeline, {QUOTA} AS total_quota,
  {_ratio('sum(Deal_Size)', QUOTA)} AS region_coverage_ratio,
  {_total_if(NEAR)} AS pipeline_0_30_days, {_total_if(MID)} AS pipeline_31_90_days,
  {_total_if(LATER)} AS pipeline_90_plus_days
FROM deals WHERE {OPEN} GROUP BY Region
ORDER BY region_coverage_ratio DESC NULLS LAST, Region""",
    "coverage_health": f"""
, totals AS (
  SELECT Sales_Rep, Region, {_total('Deal_Size')} AS total_pipeline,
    {QUOTA} AS quota_target,
    {_ratio('sum(Deal_Size)', QUOTA)} AS coverage_ratio,
    {_total_if(NEAR)} AS pipeline_0_30_days, {_total_if(MID)} AS pipeline_31_90_days
  FROM deals WHERE {OPEN} GROUP BY Sales_Rep, Region)
SELECT *, CASE WHEN coverage_ratio >= 3 OR coverage_ratio IS NULL THEN 'HEALTHY'
  WHEN coverage_ratio >= 2 THEN 'BELOW TARGET' WHEN coverage_ratio >= 1 THEN 'AT RISK'
  ELSE 'CRITICAL' END AS coverage_health
FROM totals ORDER BY coverage_ratio NULLS FIRST, Sales_Rep, Region""",
}


def _mix(column: str, share: str, order: str) -> str:
    return f"""
, cells AS (
  SELECT Lead_Source, {column}, count(*) AS deal_count, {_total('Deal_Size')} AS total_value,
    {_mean('Deal_Size')} AS avg_deal_size, {_n(WON)} AS won, {WIN_RATE} AS win_rate_pct
  FROM deals GROUP BY Lead_Source, {column}),
sources AS (SELECT Lead_Source AS source, count(*) AS all_deals FROM deals GROUP BY ALL)
SELECT cells.*, {_pct('deal_count', 'all_deals')} AS {share}
FROM cells JOIN sources ON source IS NOT DISTINCT FROM Lead_Source
ORDER BY Lead_Source, {order}"""


def _per_day(digits: int | None) -> str:
    value, days, timed = PER_DAY_PARTS
    product = f"CAST({value} AS HUGEINT) * {timed}"
    if digits is None:
        return f"CASE WHEN {days} > 0 THEN CAST({product} AS DOUBLE) / {days} END"
    return _round(f"({product})", days, digits)


LEAD_SOURCE = {
    "source_by_stage": f"""
SELECT Lead_Source, Stage, count(*) AS deal_count, {_total('Deal_Size')} AS total_value,
  {_mean('Win_Probability')} AS avg_win_probability, {_n(WON)} AS won, {_n(LOST)} AS lost,
  {WIN_RATE} AS stage_win_rate_pct
FROM deals GROUP BY Lead_Source, Stage ORDER BY Lead_Source, Stage""",
    "stage_conversion": f"""
, steps AS (
  SELECT *, list_position(['Qualification', 'Discovery', 'Proposal', 'Negotiation', 'Contract',
    'Closing', 'Closed Won'], Stage) AS step FROM deals)
SELECT Lead_Source, count(*) AS total_deals, {_n('step >= 1')} AS past_qualification,
  {_n('step >= 3')} AS past_proposal, {_n('step >= 4')} AS past_negotiation,
  {_n(WON)} AS closed_won, {_pct(_n('step >= 3'), 'count(*)')} AS pct_reach_proposal,
  {_pct(_n(WON), 'count(*)')} AS pct_closed_won
FROM steps GROUP BY Lead_Source ORDER BY pct_closed_won DESC, Lead_Source""",
    "cycle_by_outcome": f"""
SELECT Lead_Source, Deal_Status, count(*) AS deal_count,
  {_mean('Sales_Cycle_Days')} AS avg_cycle_days, min(Sales_Cycle_Days) AS fastest_cycle,
  max(Sales_Cycle_Days) AS slowest_cycle, {_mean('Deal_Size')} AS avg_deal_size
FROM deals WHERE {CLOSED} GROUP BY Lead_Source, Deal_Status ORDER BY Lead_Source, Deal_Status""",
    "velocity_scorecard": f"""
, totals AS (
  SELECT Lead_Source, {_n(WON)} AS won_deals,
    {_mean('Sales_Cycle_Days', WON)} AS avg_won_cycle_days, {_total_if(WON)} AS total_won_value,
    {_per_day(0)} AS revenue_per_day, {WIN_RATE} AS win_rate_pct, {_per_day(None)} AS speed
  FROM deals WHERE {CLOSED} GROUP BY Lead_Source)
SELECT * EXCLUDE (speed), CAST(rank() OVER (ORDER BY speed DESC NULLS LAST) AS INTEGER)
  AS velocity_rank
FROM totals ORDER BY velocity_rank, Lead_Source""",
    "cycle_length_distribution": f"""
SELECT Lead_Source, CASE WHEN Sales_Cycle_Days < 0 THEN '05. 90+ days'
    WHEN Sales_Cycle_Days <= 15 THEN '01. 0-15 days'
    WHEN Sales_Cycle_Days <= 30 THEN '02. 16-30 days'
    WHEN Sales_Cycle_Days <= 60 THEN '03. 31-60 days'
    WHEN Sales_Cycle_Days <= 90 THEN '04. 61-90 days' ELSE '05. 90+ days' END AS cycle_bucket,
  count(*) AS deal_count, {_n(WON)} AS won, {_pct(_n(WON), 'count(*)')} AS win_rate_pct
FROM deals WHERE {CLOSED} GROUP BY Lead_Source, cycle_bucket
ORDER BY Lead_Source, cycle_bucket""",
    "stall_rate": f"""
SELECT Lead_Source, count(*) AS total_open_deals, {_n(STALLED)} AS stalled_deals,
  {_pct(_n(STALLED), 'count(*)')} AS stall_rate_pct, {_total_if(STALLED)} AS stalled_value,
  {_mean('Days_in_Stage', STALLED)} AS avg_days_stuck, {_mean(IDLE)} AS avg_days_since_activity
FROM deals WHERE {OPEN} GROUP BY Lead_Source ORDER BY stall_rate_pct DESC, Lead_Source""",
    "decay_funnel": f"""
, counts AS (
  SELECT Lead_Source, count(*) AS total_created,
    {_n(f"{OPEN} AND Is_Stalled = 'FALSE'")} AS active_open,
    {_n(f'{OPEN} AND {STALLED}')} AS stalled, {_n(WON)} AS won, {_n(LOST)} AS lost
  FROM deals GROUP BY Lead_Source)
SELECT *, {_pct('stalled', 'total_created')} AS pct_decayed,
  {_pct('(lost + stalled)', 'total_created')} AS total_waste_pct
FROM counts ORDER BY total_waste_pct DESC, Lead_Source""",
    "deal_type_fit": _mix("Deal_Type", "pct_of_source_total", "deal_count DESC, Deal_Type"),
    "tier_distribution": _mix("Account_Tier", "pct_of_source", "Account_Tier"),
    "source_quality": f"""
, counts AS (
  SELECT Lead_Source, count(*) AS total_deals,
    {_n("Account_Tier = 'Enterprise'")} AS enterprise_deals,
    {_n("Account_Tier = 'Mid-Market'")} AS midmarket_deals,
    {_n("Account_Tier = 'SMB'")} AS smb_deals, {_total_if(WON)} AS revenue,
    {_total_if(f"{WON} AND Account_Tier = 'Enterprise'")} AS enterprise_revenue
  FROM deals GROUP BY Lead_Source)
SELECT * EXCLUDE (revenue, enterprise_revenue),
  {_pct('enterprise_deals', 'total_deals')} AS pct_enterprise,
  {_round('revenue', 'total_deals', 0)} AS revenue_per_lead,
  {_round('enterprise_revenue', 'enterprise_deals', 0)} AS revenue_per_enterprise_lead
FROM counts ORDER BY revenue_per_lead DESC, Lead_Source""",
    "campaign_performance": f"""
SELECT Lead_Source, Campaign_Name, count(*) AS total_deals, {_n(WON)} AS won, {_n(LOST)} AS lost,
  {WIN_RATE} AS win_rate_pct, {_total_if(WON)} AS won_value,
  {_mean('Deal_Size', WON)} AS avg_won_deal_size,
  {_mean('Sales_Cycle_Days', WON)} AS avg_won_cycle_days,
  {_round(_total_if(WON), 'count(*)', 0)} AS revenue_per_deal_generated
FROM deals WHERE Campaign_Name <> '' GROUP BY Lead_Source, Campaign_Name
ORDER BY won_value DESC, Lead_Source, Campaign_Name""",
    "top_campaigns": f"""
SELECT Campaign_Name, Lead_Source, count(*) AS total_deals, {_n(WON)} AS won,
  {WIN_RATE} AS win_rate_pct, {_total_if(WON)} AS total_won_value,
  {_list('Account_Tier')} AS tiers_reached
FROM deals WHERE Campaign_Name <> '' AND {CLOSED} GROUP BY Campaign_Name, Lead_Source
ORDER BY total_won_value DESC, Campaign_Name, Lead_Source LIMIT 10""",
    "monthly_creation_by_source": f"""
SELECT Lead_Source, strftime(Created_Date, '%Y-%m') AS created_month, count(*) AS deals_created,
  {_total('Deal_Size')} AS pipeline_added, {_mean('Deal_Size')} AS avg_deal_size
FROM deals WHERE Created_Date_raw <> '' GROUP BY Lead_Source, created_month
ORDER BY Lead_Source, created_month NULLS FIRST""",
    "quarterly_win_rate": f"""
SELECT Lead_Source, strftime(Close_Date, '%Y') || '-Q' || quarter(Close_Date) AS close_quarter,
  count(*) AS closed_deals, {_n(WON)} AS won, {_pct(_n(WON), 'count(*)')} AS win_rate_pct,
  {_total_if(WON)} AS won_value
FROM deals WHERE {CLOSED} AND Close_Date_raw <> '' GROUP BY Lead_Source, close_quarter
ORDER BY Lead_Source, close_quarter NULLS FIRST""",
    "best_worst_month": f"""
, months AS (
  SELECT Lead_Source, month(Created_Date) AS nr, monthname(Created_Date) AS month_name,
    count(*) AS deals_created, {_total('Deal_Size')} AS pipeline_added
  FROM deals WHERE Created_Date_raw <> '' GROUP BY ALL),
extremes AS (
  SELECT Lead_Source AS source, max(deals_created) AS most, min(deals_created) AS fewest
  FROM months GROUP BY ALL)
SELECT Lead_Source, month_name, deals_created, pipeline_added,
  CASE deals_created WHEN most THEN 'BEST MONTH' ELSE 'WORST MONTH' END AS label
FROM months JOIN extremes ON source IS NOT DISTINCT FROM Lead_Source
WHERE deals_created IN (most, fewest)
ORDER BY Lead_Source, deals_created DESC, nr""",
    "competitive_loss_rate": f"""
SELECT Lead_Source, {_n(LOST)} AS total_losses, {_n(COMPETITOR)} AS competitive_losses,
  {_pct(_n(COMPETITOR), _n(LOST))} AS competitive_loss_rate_pct,
  {_total_if(COMPETITOR)} AS competitive_lost_value,
  {_list(f'CASE WHEN {COMPETITOR} THEN Competitor_Name END')} AS competitors_faced
FROM deals GROUP BY Lead_Source ORDER BY competitive_loss_rate_pct DESC NULLS LAST, Lead_Source""",
    "source_competitor_matrix": f"""
SELECT Lead_Source, Competitor_Name, count(*) AS losses_to_competitor,
  {_total('Deal_Size')} AS lost_value, {_mean('Deal_Size')} AS avg_lost_deal_size,
  {_mean('Sales_Cycle_Days')} AS avg_cycle_days, {_list('Reason_Lost')} AS loss_reasons
FROM deals WHERE {COMPETITOR} GROUP BY Lead_Source, Competitor_Name
ORDER BY Lead_Source, losses_to_competitor DESC, Competitor_Name""",
    "source_scorecard": f"""
, rates AS (
  SELECT Lead_Source, count(*) AS total_deals, {WIN_RATE} AS win_rate_pct,
    {_total_if(WON)} AS total_won_value,
    {_round(_total_if(WON), 'count(*)', 0)} AS revenue_per_lead,
    {_mean('Sales_Cycle_Days', WON)} AS avg_won_cycle_days, {_per_day(0)} AS revenue_per_day,
    {_pct(_n(f'{OPEN} AND {STALLED}'), _n(OPEN))} AS stall_rate_pct,
    {_pct(_n("Account_Tier = 'Enterprise'"), 'count(*)')} AS pct_enterprise,
    {_pct(_n(COMPETITOR), _n(LOST))} AS competitive_loss_rate_pct
  FROM deals GROUP BY Lead_Source)
SELECT *, CASE WHEN win_rate_pct >= 60 AND stall_rate_pct < 30 THEN 'A - HIGH PERFORMER'
  WHEN win_rate_pct >= 40 THEN 'B - SOLID' WHEN stall_rate_pct >= 50 THEN 'D - HIGH DECAY'
  ELSE 'C - AVERAGE' END AS source_grade
FROM rates ORDER BY revenue_per_lead DESC, Lead_Source""",
}

# Points lost for risks that show on the deal alone.
_PENALTY = (
    f"(CASE WHEN {STALLED} THEN 25 ELSE 0 END + CASE WHEN {OVERDUE} THEN 20 ELSE 0 END"
    f" + CASE WHEN {IDLE} > 14 THEN 10 WHEN {IDLE} >= 7 THEN 5 ELSE 0 END"
    " + CASE WHEN Win_Probability < 30 THEN 10 ELSE 0 END)"
)

_PATTERNS = f"""
, patterns AS (
  SELECT Lead_Source, Industry, {SIZE_TIER} AS size_tier, count(*) AS total_closed,
    {_n(LOST)} AS lost, {_pct(_n(LOST), 'count(*)')} AS loss_rate_pct,
    {_list(f"CASE WHEN {LOST} AND Reason_Lost <> '' THEN Reason_Lost END")}
      AS common_loss_reasons,
    {_list(f'CASE WHEN {COMPETITOR} THEN Competitor_Name END')} AS competitors
  FROM deals WHERE {CLOSED} GROUP BY Lead_Source, Industry, size_tier
  HAVING count(*) >= 3 AND {_pct(_n(LOST), 'count(*)')} >= 50)"""

# The sizes compared here leave out deals without one.
_TIERS = {
    "small": "Deal_Size < 10000",
    "mid": "Deal_Size >= 10000 AND Deal_Size < 50000",
    "large": "Deal_Size >= 50000 AND Deal_Size < 100000",
    "enterprise": "Deal_Size >= 100000",
}

AUTOMATION = {
    "deal_health_scores": f"""
, benchmarks AS (
  SELECT Stage AS at_stage, avg(Sales_Cycle_Days) FILTER (WHERE {LOST}) AS lost_cycle,
    avg(Days_in_Stage) FILTER (WHERE {WON}) AS won_days
  FROM deals WHERE {CLOSED} GROUP BY Stage),
risks AS (
  SELECT *, {IDLE} AS idle, coalesce({OVERDUE}, FALSE) AS late,
    coalesce({STALLED}, FALSE) AS stalled,
    coalesce(Sales_Cycle_Days > coalesce(lost_cycle, 999), FALSE) AS long_cycle,
    coalesce(Days_in_Stage > coalesce(2 * won_days, 999), FALSE) AS stuck
  FROM deals LEFT JOIN benchmarks ON Stage = at_stage WHERE {OPEN})
SELECT Opportunity_ID, Opportunity_Name, Sales_Rep, Stage, Deal_Size, Win_Probability,
  Days_in_Stage, Sales_Cycle_Days, Is_Stalled, idle AS days_since_activity,
  {TO_CLOSE} AS days_to_expected_close,
  CAST(greatest(0, 100 - {_PENALTY} - 20 * CAST(long_cycle AS INTEGER)
    - 15 * CAST(stuck AS INTEGER)) AS INTEGER) AS health_score,
  concat_ws(', ', CASE WHEN stalled THEN 'STALLED' END, CASE WHEN late THEN 'OVERDUE' END,
    CASE WHEN long_cycle THEN 'EXCEEDS LOST CYCLE AVG' END,
    CASE WHEN stuck THEN 'STUCK IN STAGE' END,
    CASE WHEN idle > 14 THEN 'NO RECENT ACTIVITY' END,
    CASE WHEN Win_Probability < 30 THEN 'LOW PROBABILITY' END) AS risk_flags,
  CASE WHEN CAST(stalled AS INTEGER) + CAST(late AS INTEGER) + CAST(long_cycle AS INTEGER) > 1
      THEN 'INTERVENE NOW'
    WHEN stuck THEN 'NEEDS ATTENTION' ELSE 'MONITOR' END AS action_category
FROM risks ORDER BY health_score, Deal_Size DESC NULLS LAST, Opportunity_ID""",
    "health_by_rep": f"""
, scored AS (SELECT *, 100 - {_PENALTY} AS score FROM deals WHERE {OPEN})
SELECT Sales_Rep, Region, count(*) AS open_deals,
  {_round('sum(score)', 'count(*)', 1)} AS avg_health_score,
  {_n('score < 40')} AS critical_deals, {_n('score >= 40 AND score < 70')} AS at_risk_deals,
  {_n('score >= 70')} AS healthy_deals, {_total_if('score < 40')} AS critical_value,
  {_pct(_total_if('score < 40'), 'sum(Deal_Size)')} AS pct_pipeline_critical
FROM scored GROUP BY Sales_Rep, Region ORDER BY avg_health_score, Sales_Rep, Region""",
    "priority_queue": f"""
, signals AS (
  SELECT *, {IDLE} AS idle, {TO_CLOSE} AS due,
    CASE WHEN {OVERDUE} THEN 50 WHEN {TO_CLOSE} <= 7 THEN 40 ELSE 0 END
      + CASE WHEN {STALLED} THEN 30 ELSE 0 END + CASE WHEN {IDLE} > 7 THEN 20 ELSE 0 END
      + CASE WHEN Forecast_Category = 'Commit' THEN 15 ELSE 0 END AS urgency
  FROM deals WHERE {OPEN})
SELECT Sales_Rep, Opportunity_ID, Opportunity_Name, Stage, Deal_Size, Account_Tier,
  Days_in_Stage, idle AS days_since_activity, due AS days_to_close, Is_Stalled,
  Forecast_Category,
  CASE WHEN Deal_Size IS NOT NULL THEN CAST(
    10000 * (urgency + CASE WHEN Account_Tier = 'Enterprise' THEN 10 ELSE 0 END)
    + least(Deal_Size, 100000) AS DOUBLE) / 10000 END AS priority_score,
  CASE WHEN due < 0 THEN CASE WHEN {STALLED} THEN 'ESCALATE: Overdue & stalled — involve manager'
      ELSE 'URGENT: Update close date or push to close' END
    WHEN due <= 7 THEN 'CLOSING: Final push — confirm next steps'
    WHEN {STALLED} THEN CASE WHEN Stage IN ('Proposal', 'Negotiation', 'Contract')
      THEN 'RE-ENGAGE: Late-stage stall — schedule call'
      ELSE 'REVIVE: Send value-add content or re-qualify' END
    WHEN idle > 14 THEN 'FOLLOW UP: No activity in 2+ weeks'
    WHEN idle > 7 THEN 'CHECK IN: No activity in 1+ week'
    ELSE 'ON TRACK: Continue current cadence' END AS suggested_action,
  CAST(row_number() OVER (PARTITION BY Sales_Rep ORDER BY urgency DESC, Opportunity_ID)
    AS INTEGER) AS daily_rank
FROM signals ORDER BY Sales_Rep, daily_rank""",
    "forecast_suggestions": f"""
, tiered AS (SELECT *, {SIZE_TIER} AS tier FROM deals),
history AS (
  SELECT Stage AS at_stage, tier AS of_tier, {WIN_RATE} AS historical_win_rate
  FROM tiered WHERE {CLOSED} GROUP BY ALL),
joined AS (
  SELECT *, Stage IN ('Negotiation', 'Contract', 'Closing') AS late_stage
  FROM tiered LEFT JOIN history ON Stage = at_stage AND tier = of_tier WHERE {OPEN})
SELECT Opportunity_ID, Opportunity_Name, Sales_Rep, Stage, Deal_Size, Win_Probability,
  Forecast_Category AS current_forecast, Days_in_Stage, Is_Stalled, historical_win_rate,
  CASE WHEN {STALLED} AND (Days_in_Stage > 14 OR {OVERDUE}) THEN 'Omit'
    WHEN Is_Stalled = 'FALSE' AND late_stage AND historical_win_rate >= 70 THEN 'Commit'
    WHEN Is_Stalled = 'FALSE' AND historical_win_rate >= 50 THEN 'Best Case'
    WHEN historical_win_rate >= 30 THEN 'Upside' ELSE 'Pipeline' END AS suggested_forecast,
  CASE WHEN Forecast_Category = 'Commit' THEN
      CASE WHEN {STALLED} THEN 'MISMATCH: Committed but stalled'
        WHEN historical_win_rate < 40 THEN 'MISMATCH: Committed but low historical win rate'
        ELSE '' END
    WHEN Forecast_Category IN ('Pipeline', 'Upside') AND late_stage AND historical_win_rate >= 70
      THEN 'UNDER-CALLED: Consider upgrading to Commit'
    ELSE '' END AS forecast_flag
FROM joined ORDER BY Sales_Rep, Stage, Opportunity_ID""",
    "pipeline_gap_alerts": f"""
, pipeline AS (
  SELECT Sales_Rep, Region, {_total('Deal_Size')} AS total_pipeline,
    {_total_if(NEAR)} AS pipeline_0_30, {_total_if(MID)} AS pipeline_31_90,
    {QUOTA} AS quota_target
  FROM deals WHERE {OPEN} GROUP BY Sales_Rep, Region),
won AS (
  SELECT Sales_Rep AS winner, {_total('Deal_Size')} AS won_value
  FROM deals WHERE {WON} AND {THIS_YEAR} GROUP BY Sales_Rep),
levels AS (
  SELECT *, CASE WHEN pipeline_31_90 = 0 AND pipeline_0_30 = 0 THEN 1
    WHEN pipeline_31_90 = 0 THEN 2 WHEN pipeline_31_90 < quota_target * 0.5 THEN 3
    WHEN pipeline_0_30 < quota_target * 0.3 THEN 4 ELSE 5 END AS level
  FROM pipeline LEFT JOIN won ON Sales_Rep = winner)
SELECT Sales_Rep, Region, total_pipeline, pipeline_0_30, pipeline_31_90, quota_target,
  coalesce(won_value, 0) AS ytd_won,
  {_ratio('total_pipeline', 'quota_target')} AS coverage_ratio,
  ['CRITICAL: No pipeline in next 90 days',
   'ALERT: No pipeline for days 31-90 — next quarter at risk',
   'WARNING: Mid-term pipeline below 50% of quota',
   'WARNING: Short-term pipeline below 30% of quota', 'OK'][level] AS pipeline_alert,
  ['Prioritize prospecting and outbound immediately',
   'Prioritize prospecting and outbound immediately',
   'Increase outbound activity and work marketing leads',
   'Focus on accelerating existing mid-stage deals',
   'Maintain current activity levels'][level] AS recommended_action
FROM levels ORDER BY level, total_pipeline, Sales_Rep, Region""",
    "stale_deal_reminders": f"""
, limits(at_stage, days, outreach) AS (VALUES
  ('Prospecting', 5, 'Send re-engagement email or reassign lead'),
  ('Qualification', 5, 'Send re-engagement email or reassign lead'),
  ('Discovery', 7, 'Schedule discovery call follow-up'),
  ('Proposal', 7, 'Follow up on proposal — ask for feedback'),
  ('Negotiation', 5, 'Call directly — resolve blockers'),
  ('Contract', 3, 'Call directly — resolve blockers'),
  ('Closing', 3, 'Escalate — involve manager to close')),
idle AS (
  SELECT *, {IDLE} AS waited FROM deals JOIN limits ON Stage = at_stage
  WHERE {OPEN} AND {IDLE} > days)
SELECT Sales_Rep, Opportunity_ID, Opportunity_Name, Stage, Deal_Size, Account_Name,
  Last_Activity_Date_raw AS Last_Activity_Date, waited AS days_since_activity,
  days AS stage_threshold, waited - days AS days_overdue,
  CASE WHEN waited > 3 * days THEN 'CRITICAL: 3x overdue — likely dead'
    WHEN waited > 2 * days THEN 'URGENT: 2x overdue — re-engage immediately'
    ELSE 'REMINDER: Past activity threshold' END AS reminder_level,
  outreach AS suggested_outreach
FROM idle ORDER BY Sales_Rep, waited <= 3 * days, waited <= 2 * days,
  Deal_Size DESC NULLS LAST, Opportunity_ID""",
    "loss_patterns": f"""{_PATTERNS}
SELECT * FROM patterns
ORDER BY loss_rate_pct DESC, total_closed DESC, Lead_Source, Industry, size_tier""",
    "coaching_prompts": f"""{_PATTERNS}
SELECT Opportunity_ID, Opportunity_Name, Sales_Rep, Stage, Deal_Size, d.Lead_Source, d.Industry,
  loss_rate_pct AS pattern_loss_rate, common_loss_reasons,
  'WARNING: Deals from ' || d.Lead_Source || ' in ' || d.Industry || ' (' || size_tier
    || ' tier) historically lose ' || printf('%.1f', loss_rate_pct)
    || '% of the time. Common reasons: ' || coalesce(common_loss_reasons, 'Unknown')
    || '. Consider adjusting strategy early.' AS coaching_prompt
FROM deals d JOIN patterns p ON p.Lead_Source = d.Lead_Source AND p.Industry = d.Industry
  AND p.size_tier = {SIZE_TIER}
WHERE {OPEN} ORDER BY loss_rate_pct DESC, Deal_Size DESC NULLS LAST, Opportunity_ID""",
    "week_created": f"""
SELECT Sales_Rep, Region, count(*) AS deals_created_this_week,
  {_total('Deal_Size')} AS new_pipeline_value, {_mean('Deal_Size')} AS avg_new_deal_size,
  string_agg(Opportunity_Name, ', ' ORDER BY Deal_Size DESC NULLS LAST, Opportunity_Name)
    AS new_deals
FROM deals WHERE Created_Date >= {MONDAY} GROUP BY Sales_Rep, Region
ORDER BY new_pipeline_value DESC NULLS LAST, Sales_Rep, Region""",
    "week_created_deals": f"""
SELECT Sales_Rep, Region, row_number() OVER (PARTITION BY Sales_Rep, Region
    ORDER BY Deal_Size DESC NULLS LAST, Opportunity_Name NULLS FIRST, Opportunity_ID) AS position,
  Opportunity_ID, Opportunity_Name, Deal_Size
FROM deals WHERE Created_Date >= {MONDAY} ORDER BY Sales_Rep, Region, position""",
    "week_closed": f"""
SELECT Sales_Rep, Region, {_n(WON)} AS won_this_week, {_n(LOST)} AS lost_this_week,
  {_total_if(WON)} AS won_value, {_total_if(LOST)} AS lost_value
FROM deals WHERE {CLOSED} AND Close_Date >= {MONDAY} GROUP BY Sales_Rep, Region
ORDER BY won_value DESC NULLS LAST, Sales_Rep, Region""",
    "week_stalled": f"""
SELECT Sales_Rep, Region, count(*) AS newly_stalled, {_total('Deal_Size')} AS stalled_value,
  string_agg(Opportunity_Name || ' (' || Stage || ')', '; '
    ORDER BY Deal_Size DESC NULLS LAST, Opportunity_Name || ' (' || Stage || ')')
    AS stalled_deals
FROM deals WHERE {OPEN} AND {STALLED} AND {IDLE} BETWEEN 7 AND 14 GROUP BY Sales_Rep, Region
ORDER BY stalled_value DESC NULLS LAST, Sales_Rep, Region""",
    "week_stalled_deals": f"""
SELECT Sales_Rep, Region, row_number() OVER (PARTITION BY Sales_Rep, Region
    ORDER BY Deal_Size DESC NULLS LAST, Opportunity_Name NULLS FIRST, Opportunity_ID) AS position,
  Opportunity_ID, Opportunity_Name, Stage, Deal_Size
FROM deals WHERE {OPEN} AND {STALLED} AND {IDLE} BETWEEN 7 AND 14
ORDER BY Sales_Rep, Region, position""",
    "weekly_digest": f"""
, snapshot AS (
  SELECT Sales_Rep, Region, count(*) AS open_deals, {_total('Deal_Size')} AS open_pipeline,
    {_n(STALLED)} AS stalled_deals, {_total_if(STALLED)} AS stalled_value
  FROM deals WHERE {OPEN} GROUP BY Sales_Rep, Region),
created AS (
  SELECT Sales_Rep AS rep, count(*) AS n, sum(Deal_Size) AS v FROM deals
  WHERE Created_Date >= {MONDAY} GROUP BY Sales_Rep),
won AS (
  SELECT Sales_Rep AS rep, count(*) AS n, sum(Deal_Size) AS v FROM deals
  WHERE {WON} AND Close_Date >= {MONDAY} GROUP BY Sales_Rep),
lost AS (
  SELECT Sales_Rep AS rep, count(*) AS n, sum(Deal_Size) AS v FROM deals
  WHERE {LOST} AND Close_Date >= {MONDAY} GROUP BY Sales_Rep)
SELECT s.*, coalesce(created.n, 0) AS deals_created,
  CAST(coalesce(created.v, 0) AS BIGINT) AS new_pipeline_value,
  coalesce(won.n, 0) AS deals_won, CAST(coalesce(won.v, 0) AS BIGINT) AS won_value,
  coalesce(lost.n, 0) AS deals_lost, CAST(coalesce(lost.v, 0) AS BIGINT) AS lost_value
FROM snapshot s LEFT JOIN created ON created.rep = Sales_Rep
  LEFT JOIN won ON won.rep = Sales_Rep LEFT JOIN lost ON lost.rep = Sales_Rep
ORDER BY Sales_Rep, Region""",
    "rep_capability": f"""
, totals AS (
  SELECT Sales_Rep, Region, Rep_Tenure_Months, {_n(OPEN)} AS current_open_deals,
    {_total_if(OPEN)} AS current_pipeline, {_n(WON)} AS won, {_n(CLOSED)} AS closed,
    {', '.join(f"{_pct(_n(f'{WON} AND {c}'), _n(f'{CLOSED} AND {c}'))} AS {t}_deal_win_rate"
               for t, c in _TIERS.items())},
    {_list(f'CASE WHEN {WON} THEN Industry END')} AS industries_won,
    {_mean('Sales_Cycle_Days', WON)} AS avg_won_cycle
  FROM deals GROUP BY Sales_Rep, Region, Rep_Tenure_Months)
SELECT * EXCLUDE (won, closed), CASE WHEN current_open_deals > 0 THEN coalesce(
  {_pct('won', '(current_open_deals * closed)', 2)}, 0.0) END AS routing_score
FROM totals ORDER BY routing_score DESC NULLS LAST, Sales_Rep, Region, Rep_Tenure_Months""",
    "deal_rep_matches": f"""
, profiles AS (
  SELECT Sales_Rep, Region AS area, Rep_Tenure_Months, {_n(OPEN)} AS workload,
    {WIN_RATE} AS overall_win_rate,
    list(DISTINCT Industry) FILTER (WHERE {WON} AND Industry IS NOT NULL) AS won_in
  FROM deals GROUP BY ALL),
prospects AS (
  SELECT Opportunity_ID, Opportunity_Name, Region, Industry, Deal_Size, {SIZE_TIER} AS size_tier
  FROM deals WHERE {OPEN} AND Stage = 'Prospecting')
SELECT p.*, Sales_Rep AS recommended_rep, Rep_Tenure_Months, overall_win_rate,
  workload AS current_workload,
  concat_ws('; ', 'Same region',
    CASE WHEN list_contains(won_in, Industry) THEN 'Industry experience' END,
    CASE WHEN size_tier = 'Enterprise' THEN 'Senior for enterprise' END,
    CASE WHEN workload < 10 THEN 'Has capacity' END) AS fit_reasons
FROM prospects p JOIN profiles ON area = Region
WHERE size_tier <> 'Enterprise' OR Rep_Tenure_Months >= 12
ORDER BY Opportunity_ID, overall_win_rate DESC NULLS LAST, workload, Sales_Rep,
  Rep_Tenure_Months""",
}



def _won_lost(period: str) -> str:
    return f"""
SELECT CAST(CAST(date_trunc('{period}', Close_Date) AS DATE) AS VARCHAR) AS period_start,
  {_n(WON)} AS won, {_n(LOST)} AS lost,
  {_pct(_n(WON), 'count(*)')} AS won_pct, {_pct(_n(LOST), 'count(*)')} AS lost_pct
FROM deals WHERE {CLOSED} AND Close_Date_raw <> '' GROUP BY ALL
ORDER BY period_start NULLS FIRST"""


ANNOUNCED = {
    "pipeline_by_stage": f"""
SELECT Stage, Deal_Status, count(*) AS deal_count, {_total('Deal_Size')} AS total_value,
  {WEIGHTED_VALUE} AS weighted_value
FROM deals GROUP BY Stage, Deal_Status ORDER BY Stage, Deal_Status""",
    "stuck_deals": f"""
SELECT Opportunity_ID, Opportunity_Name, Sales_Rep, Region, Stage, Deal_Size, Days_in_Stage
FROM deals WHERE {OPEN} AND Days_in_Stage > 7 ORDER BY Days_in_Stage DESC, Opportunity_ID""",
    "won_lost_pct_by_month": _won_lost("month"),
    "won_lost_pct_by_quarter": _won_lost("quarter"),
    "won_lost_pct_by_year": _won_lost("year"),
    "top_loss_reasons": f"""
SELECT Reason_Lost, count(*) AS lost_deals, {_total('Deal_Size')} AS lost_value
FROM deals WHERE {LOST} AND Reason_Lost <> '' GROUP BY Reason_Lost
ORDER BY lost_deals DESC, Reason_Lost LIMIT 10""",
    "weekly_deal_creation": f"""
SELECT CAST(CAST(date_trunc('week', Created_Date) AS DATE) AS VARCHAR) AS week_start,
  count(*) AS deals_created, {_total('Deal_Size')} AS pipeline_added
FROM deals WHERE Created_Date_raw <> '' GROUP BY ALL ORDER BY week_start NULLS FIRST""",
    "mom_creation": f"""
, months AS (
  SELECT strftime(Created_Date, '%Y-%m') AS created_month, count(*) AS deals_created
  FROM deals WHERE Created_Date_raw <> '' GROUP BY ALL),
dated AS (
  SELECT *, lag(deals_created) OVER (ORDER BY created_month) AS previous_month,
    max(deals_created) OVER () AS max_month
  FROM months WHERE created_month IS NOT NULL)
SELECT m.created_month, m.deals_created, previous_month, max_month,
  m.deals_created - previous_month AS change, {_pct('m.deals_created', 'max_month')} AS pct_of_max
FROM months m LEFT JOIN dated d ON d.created_month = m.created_month
ORDER BY m.created_month NULLS FIRST""",
    "commit_accuracy": f"""
, rates AS (
  SELECT Sales_Rep, {_n(WON)} AS committed_won, {_n(LOST)} AS committed_lost,
    {WIN_RATE} AS accuracy_pct
  FROM deals WHERE {CLOSED} AND Forecast_Category = 'Commit' GROUP BY Sales_Rep)
SELECT *, CASE WHEN accuracy_pct < 40 THEN 'UNRELIABLE' WHEN accuracy_pct < 60 THEN 'LOW'
  WHEN accuracy_pct < 80 THEN 'GOOD' ELSE 'HIGH ACCURACY' END AS profile
FROM rates ORDER BY accuracy_pct DESC, Sales_Rep""",
}

_DATES = ("Created_Date", "Last_Activity_Date", "Expected_Close_Date", "Close_Date")


def _deals(raw: str) -> str:
    typed = ", ".join(f"CAST(try_strptime({c}, '%Y-%m-%d') AS DATE) AS {c}" for c in _DATES)
    texts = ", ".join(f"{c} AS {c}_raw" for c in _DATES)
    return (
        f"WITH deals_raw AS (\n{raw}\n),\n"
        f"deals AS (SELECT * REPLACE ({typed}), {texts} FROM deals_raw)"
    )


def all_sql(raw: str | None = None) -> dict[str, str]:
    """The complete statement for each report, over the view or another raw deal query."""
    head = _deals(raw or duckdb_text())
    return {
        name: f"{head}{body}"
        for part in (TRENDS, COVERAGE, LEAD_SOURCE, AUTOMATION, ANNOUNCED)
        for name, body in part.items()
    }
