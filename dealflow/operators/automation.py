"""Work lists for reps and their managers: scores, queues, alerts, digests, routing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow import labels as L
from dealflow.config import DEFAULTS, Thresholds
from dealflow.functions import dates as D
from dealflow.functions import exprs as X
from dealflow.plans import (
    count_pairs,
    down,
    fits_broadcast,
    join_lookup,
    listed,
    numbered,
    pair_partitions,
    paired_in_order,
    settled,
    with_lists,
)

REP = ["Sales_Rep", "Region"]
PROFILE = ["Sales_Rep", "Region", "Rep_Tenure_Months"]


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


# --- deal health ----------------------------------------------------------


def _stage_benchmarks(deals: DataFrame) -> DataFrame:
    """Mean cycle of lost deals and mean stage age of won deals, per stage."""
    return (
        deals.where(X.is_closed())
        .groupBy("Stage")
        .agg(
            F.avg(F.when(X.is_lost(), F.col("Sales_Cycle_Days"))).alias("_lost_cycle"),
            F.avg(F.when(X.is_won(), F.col("Days_in_Stage"))).alias("_won_stage_days"),
        )
    )


def _common_penalties(as_of: dt.date | None, cfg: Thresholds) -> list[Column]:
    """Points lost for risks that show on the deal alone."""
    idle = D.days_idle(as_of)
    return [
        _points(X.is_stalled(), cfg.penalty_stalled),
        _points(D.overdue(as_of), cfg.penalty_overdue),
        _points(idle > cfg.long_idle_days, cfg.penalty_long_idle),
        _points(idle.between(cfg.idle_days, cfg.long_idle_days), cfg.penalty_idle),
        _points(F.col("Win_Probability") < cfg.low_probability, cfg.penalty_low_probability),
    ]


def _score(penalties: list[Column]) -> Column:
    """100 less the penalties, kept within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - sum(penalties, F.lit(0))))


def deal_health_scores(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Every open deal with a health score, its risks and the kind of action it needs.

    Cycle and stage age are held against closed deals of the same stage.
    """
    joined = join_lookup(
        deals.where(X.is_open()),
        _stage_benchmarks(deals),
        ["Stage"],
        F.col("Opportunity_ID"),
        cfg,
        "left",
    )
    none = F.lit(cfg.no_benchmark_days)
    long_cycle = F.col("Sales_Cycle_Days") > F.coalesce(F.col("_lost_cycle"), none)
    stuck = F.col("Days_in_Stage") > F.coalesce(F.col("_won_stage_days") * cfg.stuck_factor, none)
    from_benchmarks = [
        _points(F.col("_long_cycle"), cfg.penalty_long_cycle),
        _points(F.col("_stuck"), cfg.penalty_stuck),
    ]
    ranked = (
        joined.withColumns({"_long_cycle": long_cycle, "_stuck": stuck})
        .select(
            "Opportunity_ID",
            "Opportunity_Name",
            "Sales_Rep",
            "Stage",
            "Deal_Size",
            "Win_Probability",
            "Days_in_Stage",
            "Sales_Cycle_Days",
            "Is_Stalled",
            D.days_idle(as_of).alias("days_since_activity"),
            D.days_to_close(as_of).alias("days_to_expected_close"),
            _score([*_common_penalties(as_of, cfg), *from_benchmarks]).alias("health_score"),
            "_long_cycle",
            "_stuck",
        )
        .orderBy("health_score", F.desc("Deal_Size"), "Opportunity_ID")
    )

    # Texts are made after the sort, which then moves numbers only.
    late = F.col("days_to_expected_close") < 0
    idle = F.col("days_since_activity") > cfg.long_idle_days
    flags = F.concat_ws(
        ", ",
        F.when(X.is_stalled(), L.RISK_STALLED),
        F.when(late, L.RISK_OVERDUE),
        F.when(F.col("_long_cycle"), L.RISK_LONG_CYCLE),
        F.when(F.col("_stuck"), L.RISK_STUCK),
        F.when(idle, L.RISK_IDLE),
        F.when(F.col("Win_Probability") < cfg.low_probability, L.RISK_LOW_PROBABILITY),
    )
    severe = (
        _points(X.is_stalled(), cfg.penalty_stalled)
        + _points(late, cfg.penalty_overdue)
        + _points(F.col("_long_cycle"), cfg.penalty_long_cycle)
    )
    moderate = _points(F.col("_stuck"), cfg.penalty_stuck) + _points(idle, cfg.penalty_long_idle)
    action = (
        F.when(severe >= cfg.intervene_points, L.INTERVENE)
        .when(moderate >= cfg.attention_points, L.ATTENTION)
        .otherwise(L.MONITOR)
    )
    return ranked.withColumns({"risk_flags": flags, "action_category": action}).drop(
        "_long_cycle", "_stuck"
    )


def health_by_rep(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals per rep and region in three health bands.

    The score leaves out the risks that need stage benchmarks.
    """
    score = F.col("_score")
    critical = score < cfg.health_critical
    critical_value = X.sum_if(critical, X.size())
    return (
        deals.where(X.is_open())
        .select(*REP, "Deal_Size", _score(_common_penalties(as_of, cfg)).alias("_score"))
        .groupBy(*REP)
        .agg(
            F.count("*").alias("open_deals"),
            X.per(F.sum(score), F.count("*"), 1).alias("avg_health_score"),
            F.count_if(critical).alias("critical_deals"),
            F.count_if((score >= cfg.health_critical) & (score < cfg.health_good)).alias(
                "at_risk_deals"
            ),
            F.count_if(score >= cfg.health_good).alias("healthy_deals"),
            critical_value.alias("critical_value"),
            X.pct(critical_value, F.sum(X.size())).alias("pct_pipeline_critical"),
        )
        .orderBy("avg_health_score", *REP)
    )


# --- priority queue -------------------------------------------------------


def priority_queue(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals of each rep in the order to work on them, with the next step.

    The rank looks at urgency only; account tier and size count in the score but not in
    the rank. A deal without a size has no score.
    """
    idle, close = F.col("days_since_activity"), F.col("days_to_close")
    late, due_soon = close < 0, close.between(0, cfg.due_soon_days)
    urgency = (
        _points(late, cfg.priority_overdue)
        + _points(due_soon, cfg.priority_due_soon)
        + _points(X.is_stalled(), cfg.priority_stalled)
        + _points(idle > cfg.idle_days, cfg.priority_idle)
        + _points(F.col("Forecast_Category") == L.COMMIT, cfg.priority_commit)
    )
    queue = (
        deals.where(X.is_open())
        .select(
            "Sales_Rep",
            "Opportunity_ID",
            "Opportunity_Name",
            "Stage",
            "Deal_Size",
            "Account_Tier",
            "Days_in_Stage",
            D.days_idle(as_of).alias("days_since_activity"),
            D.days_to_close(as_of).alias("days_to_close"),
            "Is_Stalled",
            "Forecast_Category",
        )
        .withColumn("_urgency", urgency)
    )
    order = [*down(F.col("_urgency")), F.col("Opportunity_ID")]
    queued = numbered(queue, ["Sales_Rep"], order, "daily_rank", cfg, ordered=True)

    # Whole numbers up to one last division, so that scores are exact.
    unit = cfg.priority_size_unit
    points = F.col("_urgency") + _points(
        F.col("Account_Tier") == L.ENTERPRISE, cfg.priority_enterprise
    )
    from_size = F.when(
        X.size().isNotNull(), F.least(X.size(), F.lit(cfg.priority_size_cap * unit))
    )
    step = (
        F.when(late & X.is_stalled(), L.ESCALATE)
        .when(late, L.URGENT)
        .when(due_soon, L.FINAL_PUSH)
        .when(X.is_stalled() & F.col("Stage").isin(*L.RE_ENGAGE_STAGES), L.RE_ENGAGE)
        .when(X.is_stalled(), L.REVIVE)
        .when(idle > cfg.long_idle_days, L.FOLLOW_UP)
        .when(idle > cfg.idle_days, L.CHECK_IN)
        .otherwise(L.ON_TRACK)
    )
    return queued.select(
        *[c for c in queue.columns if c != "_urgency"],
        ((points * unit + from_size) / unit).alias("priority_score"),
        step.alias("suggested_action"),
        F.col("daily_rank").cast("int").alias("daily_rank"),
    )


# --- forecast -------------------------------------------------------------


def forecast_suggestions(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals with the forecast category that closed deals of their kind suggest."""
    tiered = deals.withColumn("_tier", X.size_tier(cfg))
    history = (
        tiered.where(X.is_closed())
        .groupBy("Stage", "_tier")
        .agg(
            X.win_rate(F.count_if(X.is_won()), F.count_if(X.is_lost())).alias(
                "historical_win_rate"
            )
        )
    )
    # In the order of the result before rates and texts are added, which then stay put.
    order = ["Sales_Rep", "Stage", "Opportunity_ID"]
    joined = join_lookup(
        tiered.where(X.is_open()),
        history,
        ["Stage", "_tier"],
        F.col("Opportunity_ID"),
        cfg,
        "left",
        order,
    )
    rate = F.col("historical_win_rate")
    moving = F.col("Is_Stalled") == L.NOT_STALLED
    late = F.col("Stage").isin(*L.LATE_STAGES)
    committed = F.col("Forecast_Category") == L.COMMIT
    suggestion = (
        F.when(X.is_stalled() & (F.col("Days_in_Stage") > cfg.omit_days_in_stage), L.OMIT)
        .when(X.is_stalled() & D.overdue(as_of), L.OMIT)
        .when((rate >= cfg.rate_commit) & moving & late, L.COMMIT)
        .when((rate >= cfg.rate_best_case) & moving, L.BEST_CASE)
        .when(rate >= cfg.rate_upside, L.UPSIDE)
        .otherwise(L.PIPELINE)
    )
    modest = F.col("Forecast_Category").isin(L.PIPELINE, L.UPSIDE)
    flag = (
        F.when(committed & X.is_stalled(), L.COMMITTED_STALLED)
        .when(committed & (rate < cfg.rate_low), L.COMMITTED_LOW_RATE)
        .when(modest & (rate >= cfg.rate_commit) & late, L.UNDER_CALLED)
        .otherwise("")
    )
    return joined.select(
        "Opportunity_ID",
        "Opportunity_Name",
        "Sales_Rep",
        "Stage",
        "Deal_Size",
        "Win_Probability",
        F.col("Forecast_Category").alias("current_forecast"),
        "Days_in_Stage",
        "Is_Stalled",
        "historical_win_rate",
        suggestion.alias("suggested_forecast"),
        flag.alias("forecast_flag"),
    ).orderBy(*order)


# --- alerts and reminders -------------------------------------------------


def _over_rep(value: str) -> Column:
    """Total of a rep over all regions, 0 for none; deals without a rep are no rep's."""
    total = F.sum(value).over(Window.partitionBy("Sales_Rep"))
    return F.coalesce(F.when(F.col("Sales_Rep").isNotNull(), total), F.lit(0))


def pipeline_gap_alerts(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Reps whose open pipeline is thin in the near or middle window.

    ``ytd_won`` is the rep's total and shows in each of the rep's regions. Open deals and the
    year's won deals are read from their own folders and dates, and added up together before
    they are spread over regions.
    """
    near, mid = X.closes_near(as_of, cfg), X.closes_mid(as_of, cfg)
    open_deals = deals.where(X.is_open()).select(
        *REP,
        F.lit(1).alias("_open"),
        X.size().alias("_size"),
        F.when(near, X.size()).otherwise(0).alias("_near"),
        F.when(mid, X.size()).otherwise(0).alias("_mid"),
        "Quota_Contribution",
    )
    won_deals = deals.where(X.is_won() & D.in_year(F.col("Close_Date"), as_of)).select(
        *REP, X.size().alias("_won_size")
    )
    totals = (
        open_deals.unionByName(won_deals, allowMissingColumns=True)
        .groupBy(*REP)
        .agg(
            F.count("_open").alias("_open"),
            F.sum("_size").alias("total_pipeline"),
            F.sum("_near").alias("pipeline_0_30"),
            F.sum("_mid").alias("pipeline_31_90"),
            X.quota_total(F.col("Quota_Contribution")).alias("quota_target"),
            F.sum("_won_size").alias("_won"),
        )
        .withColumn("ytd_won", _over_rep("_won"))
        .where(F.col("_open") > 0)
    )
    near_value, mid_value, quota = (
        F.col("pipeline_0_30"),
        F.col("pipeline_31_90"),
        F.col("quota_target"),
    )
    low_mid = mid_value < quota * cfg.gap_mid_share
    low_near = near_value < quota * cfg.gap_near_share
    alert = (
        F.when((mid_value == 0) & (near_value == 0), L.ALERT_NONE_90)
        .when(mid_value == 0, L.ALERT_NONE_MID)
        .when(low_mid, L.ALERT_LOW_MID)
        .when(low_near, L.ALERT_LOW_NEAR)
        .otherwise(L.ALERT_OK)
    )
    action = (
        F.when(mid_value == 0, L.DO_PROSPECT)
        .when(low_mid, L.DO_OUTBOUND)
        .when(low_near, L.DO_ACCELERATE)
        .otherwise(L.DO_MAINTAIN)
    )
    return totals.select(
        *REP,
        "total_pipeline",
        "pipeline_0_30",
        "pipeline_31_90",
        "quota_target",
        "ytd_won",
        X.quota_ratio(X.whole(F.col("total_pipeline")), quota).alias("coverage_ratio"),
        alert.alias("pipeline_alert"),
        action.alias("recommended_action"),
    ).orderBy(X.label_order(F.col("pipeline_alert"), L.ALERTS), "total_pipeline", *REP)


def stale_deal_reminders(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals idle for longer than their stage allows; other stages have no limit."""
    limit, idle = F.col("stage_threshold"), F.col("days_since_activity")
    shortest = min(cfg.stage_limits.values(), default=0)
    level = (
        F.when(idle > limit * cfg.stale_dead, L.REMIND_DEAD)
        .when(idle > limit * cfg.stale_urgent, L.REMIND_URGENT)
        .otherwise(L.REMIND)
    )
    return (
        deals.where(
            X.is_open()
            & F.col("Stage").isin(*cfg.stage_limits)
            # No more than the test below, as a date that the scan can prune by.
            & (F.col("Last_Activity_Date") < F.date_sub(D.day(as_of), shortest))
        )
        .select(
            "Sales_Rep",
            "Opportunity_ID",
            "Opportunity_Name",
            "Stage",
            "Deal_Size",
            "Account_Name",
            F.col("Last_Activity_Date_raw").alias("Last_Activity_Date"),
            D.days_idle(as_of).alias("days_since_activity"),
            X.by_label(F.col("Stage"), cfg.stage_limits).alias("stage_threshold"),
        )
        .where(idle > limit)
        .orderBy(
            "Sales_Rep",
            X.label_order(level, L.REMINDERS),
            F.desc("Deal_Size"),
            "Opportunity_ID",
        )
        .withColumns(
            {
                "days_overdue": idle - limit,
                "reminder_level": level,
                "suggested_outreach": X.by_label(F.col("Stage"), L.OUTREACH, L.OUTREACH_OTHER),
            }
        )
    )


# --- loss patterns --------------------------------------------------------


def _patterns(deals: DataFrame, cfg: Thresholds) -> DataFrame:
    """Kinds of closed deals (source, industry, size) that are mostly lost."""

    def of_lost(name: str) -> Column:
        return F.when(X.is_lost() & X.present(F.col(name)), F.col(name))

    totals = with_lists(
        deals.where(X.is_closed()).withColumn("size_tier", X.size_tier(cfg)),
        ["Lead_Source", "Industry", "size_tier"],
        {"total_closed": F.count("*"), "lost": F.count_if(X.is_lost())},
        {
            "common_loss_reasons": (of_lost("Reason_Lost"), ", "),
            "competitors": (of_lost("Competitor_Name"), ", "),
        },
        cfg,
    )
    rate = X.pct(F.col("lost"), F.col("total_closed"))
    return (
        totals.where(F.col("total_closed") >= cfg.pattern_min_deals)
        .withColumn("loss_rate_pct", rate)
        .where(F.col("loss_rate_pct") >= cfg.pattern_loss_rate)
    )


def loss_patterns(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Kinds of deals that are mostly lost, with reasons and competitors."""
    return (
        _patterns(deals, cfg)
        .select(
            "Lead_Source",
            "Industry",
            "size_tier",
            "total_closed",
            "lost",
            "loss_rate_pct",
            "common_loss_reasons",
            "competitors",
        )
        .orderBy(
            F.desc("loss_rate_pct"),
            F.desc("total_closed"),
            "Lead_Source",
            "Industry",
            "size_tier",
        )
    )


def coaching_prompts(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open deals of a kind that is mostly lost, with a warning for the rep."""
    patterns = _patterns(deals, cfg).select(
        "Lead_Source",
        "Industry",
        "size_tier",
        F.col("loss_rate_pct").alias("pattern_loss_rate"),
        "common_loss_reasons",
    )
    joined = join_lookup(
        deals.where(X.is_open()).withColumn("size_tier", X.size_tier(cfg)),
        patterns,
        ["Lead_Source", "Industry", "size_tier"],
        F.col("Opportunity_ID"),
        cfg,
    )
    prompt = F.concat(
        F.lit("WARNING: Deals from "),
        F.col("Lead_Source"),
        F.lit(" in "),
        F.col("Industry"),
        F.lit(" ("),
        F.col("size_tier"),
        F.lit(" tier) historically lose "),
        F.col("pattern_loss_rate").cast("decimal(5,1)").cast("string"),
        F.lit("% of the time. Common reasons: "),
        F.coalesce(F.col("common_loss_reasons"), F.lit(L.UNKNOWN_REASONS)),
        F.lit(". Consider adjusting strategy early."),
    )
    return (
        joined.select(
            "Opportunity_ID",
            "Opportunity_Name",
            "Sales_Rep",
            "Stage",
            "Deal_Size",
            "Lead_Source",
            "Industry",
            "size_tier",
            "pattern_loss_rate",
            "common_loss_reasons",
        )
        .orderBy(F.desc("pattern_loss_rate"), F.desc("Deal_Size"), "Opportunity_ID")
        .withColumn("coaching_prompt", prompt)
        .drop("size_tier")
    )


# --- weekly digest --------------------------------------------------------


def week_created(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Deals created since Monday per rep and region, whatever their status, with names."""
    created = listed(
        deals.where(D.since_monday(F.col("Created_Date"), as_of)),
        REP,
        {
            "deals_created_this_week": F.count("*"),
            "new_pipeline_value": F.sum(X.size()),
            "avg_new_deal_size": X.average(X.size()),
        },
        "new_deals",
        F.col("Opportunity_Name"),
        ", ",
        cfg,
    )
    return created.orderBy(F.desc("new_pipeline_value"), *REP)


def _in_list_order(deals: DataFrame, columns: list[str], cfg: Thresholds) -> DataFrame:
    """One row per deal, with its position in the list of its rep and region."""
    order = [*down(F.col("Deal_Size")), F.col("Opportunity_Name"), F.col("Opportunity_ID")]
    placed = numbered(deals.select(*REP, *columns), REP, order, "position", cfg, ordered=True)
    return placed.select(*REP, "position", *columns)


def week_created_deals(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """The deals behind ``week_created``, one row each, for lists of any length."""
    created = deals.where(D.since_monday(F.col("Created_Date"), as_of))
    return _in_list_order(created, ["Opportunity_ID", "Opportunity_Name", "Deal_Size"], cfg)


def week_closed(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Deals won and lost since Monday per rep and region."""
    return (
        deals.where(X.is_closed() & D.since_monday(F.col("Close_Date"), as_of))
        .groupBy(*REP)
        .agg(
            F.count_if(X.is_won()).alias("won_this_week"),
            F.count_if(X.is_lost()).alias("lost_this_week"),
            X.sum_if(X.is_won(), X.size()).alias("won_value"),
            X.sum_if(X.is_lost(), X.size()).alias("lost_value"),
        )
        .orderBy(F.desc("won_value"), *REP)
    )


def _newly_stalled(deals: DataFrame, as_of: dt.date | None, cfg: Thresholds) -> DataFrame:
    recent = D.idle_between(cfg.idle_days, cfg.long_idle_days, as_of)
    return deals.where(X.is_open() & X.is_stalled() & recent)


def week_stalled(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open stalled deals idle for one to two weeks per rep and region, with names."""
    stalled = listed(
        _newly_stalled(deals, as_of, cfg),
        REP,
        {"newly_stalled": F.count("*"), "stalled_value": F.sum(X.size())},
        "stalled_deals",
        F.concat(F.col("Opportunity_Name"), F.lit(" ("), F.col("Stage"), F.lit(")")),
        "; ",
        cfg,
    )
    return stalled.orderBy(F.desc("stalled_value"), *REP)


def week_stalled_deals(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """The deals behind ``week_stalled``, one row each, for lists of any length."""
    columns = ["Opportunity_ID", "Opportunity_Name", "Stage", "Deal_Size"]
    return _in_list_order(_newly_stalled(deals, as_of, cfg), columns, cfg)


def weekly_digest(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """The week per rep and region with open deals.

    Created, won and lost are totals of the rep and show in each of the rep's regions; a
    rep without open deals does not appear. Open deals, deals created since Monday and deals
    closed since Monday are read by their own folders and dates and added up together.
    """
    size = X.size().alias("_size")
    kind = lambda c: F.lit(True).alias(c)
    open_deals = deals.where(X.is_open()).select(
        *REP, size, kind("_is_open"), X.is_stalled().alias("_is_stalled")
    )
    created_deals = deals.where(D.since_monday(F.col("Created_Date"), as_of)).select(
        *REP, size, kind("_is_created")
    )
    closed_deals = deals.where(
        X.is_closed() & D.since_monday(F.col("Close_Date"), as_of)
    ).select(*REP, size, X.is_won().alias("_is_won"), X.is_lost().alias("_is_lost"))
    parts = open_deals.unionByName(created_deals, allowMissingColumns=True).unionByName(
        closed_deals, allowMissingColumns=True
    )
    value = lambda c: F.sum(F.when(F.col(c), F.col("_size")))
    stalled_size = F.when(F.col("_is_stalled"), F.col("_size")).otherwise(0)
    totals = parts.groupBy(*REP).agg(
        F.count_if("_is_created").alias("_created"),
        value("_is_created").alias("_created_value"),
        F.count_if("_is_won").alias("_won"),
        value("_is_won").alias("_won_value"),
        F.count_if("_is_lost").alias("_lost"),
        value("_is_lost").alias("_lost_value"),
        F.count("_is_open").alias("open_deals"),
        value("_is_open").alias("open_pipeline"),
        F.count_if(F.col("_is_open") & F.col("_is_stalled")).alias("stalled_deals"),
        F.sum(F.when(F.col("_is_open"), stalled_size)).alias("stalled_value"),
    )
    spread = totals.select(
        *REP,
        _over_rep("_created").alias("deals_created"),
        _over_rep("_created_value").alias("new_pipeline_value"),
        _over_rep("_won").alias("deals_won"),
        _over_rep("_won_value").alias("won_value"),
        _over_rep("_lost").alias("deals_lost"),
        _over_rep("_lost_value").alias("lost_value"),
        "open_deals",
        "open_pipeline",
        "stalled_deals",
        "stalled_value",
    )
    return spread.where(F.col("open_deals") > 0).orderBy(*REP)


# --- routing --------------------------------------------------------------


def rep_capability(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Workload, win rates by deal size and industries won, per rep, region and tenure.

    A deal without a size is in no size tier here.
    """
    small, mid, large = cfg.size_cuts
    tiers = {
        "small": X.size() < small,
        "mid": (X.size() >= small) & (X.size() < mid),
        "large": (X.size() >= mid) & (X.size() < large),
        "enterprise": X.size() >= large,
    }
    outcomes = {}
    for tier, inside in tiers.items():
        outcomes[f"_{tier}_won"] = F.count_if(X.is_won() & inside)
        outcomes[f"_{tier}_lost"] = F.count_if(X.is_lost() & inside)
    won_cycle = F.when(X.is_won(), F.col("Sales_Cycle_Days"))
    totals = with_lists(
        deals,
        PROFILE,
        {
            "current_open_deals": F.count_if(X.is_open()),
            "current_pipeline": X.sum_if(X.is_open(), X.size()),
            "_won": F.count_if(X.is_won()),
            "_lost": F.count_if(X.is_lost()),
            "_days": F.sum(won_cycle),
            "_timed": F.count(won_cycle),
            **outcomes,
        },
        {"industries_won": (F.when(X.is_won(), F.col("Industry")), ", ")},
        cfg,
    )
    open_deals, closed = F.col("current_open_deals"), F.col("_won") + F.col("_lost")
    hundred = F.lit(100).cast("decimal(3,0)")
    routing = F.round(
        X.whole(F.col("_won"))
        * hundred
        / F.nullif(
            open_deals.cast("decimal(18,0)") * closed.cast("decimal(18,0)"),
            F.lit(0).cast("decimal(37,0)"),
        ),
        2,
    ).cast("double")
    score = F.when(open_deals > 0, F.coalesce(routing, F.lit(0.0)))
    return totals.select(
        *PROFILE,
        "current_open_deals",
        "current_pipeline",
        *[
            X.win_rate(F.col(f"_{t}_won"), F.col(f"_{t}_lost")).alias(f"{t}_deal_win_rate")
            for t in tiers
        ],
        "industries_won",
        X.mean(F.col("_days"), F.col("_timed")).alias("avg_won_cycle"),
        score.alias("routing_score"),
    ).orderBy(F.desc("routing_score"), *PROFILE)


def deal_rep_matches(
    deals: DataFrame, as_of: dt.date | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Open prospects with every rep profile of their region that may take them.

    Deals of the largest tier need a senior rep. All candidates are part of the result,
    so it has as many rows as there are prospects times eligible profiles of the region;
    with ``cfg.match_candidates`` only so many of the best per prospect.
    """
    senior = F.col("Rep_Tenure_Months") >= cfg.senior_months
    # The order of candidates is that of the profiles, the same for all prospects of a region.
    best_first = [
        F.desc("overall_win_rate"),
        F.col("current_workload"),
        F.col("recommended_rep"),
        F.col("Rep_Tenure_Months"),
    ]
    by_region = Window.partitionBy("Region").orderBy(*best_first)
    by_senior = Window.partitionBy("Region", senior).orderBy(*best_first)
    profiles = (
        with_lists(
            deals.where(F.col("Region").isNotNull()),
            PROFILE,
            {
                "current_workload": F.count_if(X.is_open()),
                "_won": F.count_if(X.is_won()),
                "_lost": F.count_if(X.is_lost()),
            },
            {"_industries": (F.when(X.is_won(), F.col("Industry")), "")},
            cfg,
            as_arrays=True,
        ).select(
            F.col("Sales_Rep").alias("recommended_rep"),
            "Region",
            "Rep_Tenure_Months",
            "current_workload",
            X.win_rate(F.col("_won"), F.col("_lost")).alias("overall_win_rate"),
            "_industries",
        )
    )
    if cfg.match_candidates is not None:
        profiles = profiles.withColumns(
            {
                "_place": F.row_number().over(by_region),
                "_place_senior": F.row_number().over(by_senior),
            }
        )
    profiles = settled(profiles)
    prospects = deals.where(X.is_open() & (F.col("Stage") == L.PROSPECTING)).select(
        "Opportunity_ID",
        "Opportunity_Name",
        "Region",
        "Industry",
        "Deal_Size",
        X.size_tier(cfg).alias("size_tier"),
    )
    largest = F.col("size_tier") == L.ENTERPRISE
    # Prospects are put into the order of the result before they multiply, so that the pairs are
    # sorted where they arise, in as many partitions as they need.
    pairs = count_pairs(prospects, profiles, "Region")
    small = fits_broadcast(profiles, cfg)
    if small:
        parts = pair_partitions(pairs, prospects, cfg)
        placed = prospects.repartitionByRange(parts, "Opportunity_ID")
        joined = placed.join(F.broadcast(profiles), "Region")
    else:
        joined = paired_in_order(prospects, profiles, "Region", ["Opportunity_ID"], pairs, cfg)
    joined = joined.where(~largest | senior)
    if cfg.match_candidates is not None:
        place = F.when(largest, F.col("_place_senior")).otherwise(F.col("_place"))
        joined = joined.where(place <= cfg.match_candidates)
    reasons = F.concat_ws(
        "; ",
        F.lit(L.FIT_REGION),
        F.when(F.array_contains("_industries", F.col("Industry")), L.FIT_INDUSTRY),
        F.when(largest & senior, L.FIT_SENIOR),
        F.when(F.col("current_workload") < cfg.capacity_deals, L.FIT_CAPACITY),
    )
    order = ["Opportunity_ID", *best_first]
    joined = joined.select(
        "Opportunity_ID",
        "Opportunity_Name",
        "Region",
        "Industry",
        "Deal_Size",
        "size_tier",
        "recommended_rep",
        "Rep_Tenure_Months",
        "overall_win_rate",
        "current_workload",
        reasons.alias("fit_reasons"),
    )
    return joined.orderBy(*order) if small else joined.sortWithinPartitions(*order)
