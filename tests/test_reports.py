"""Particular rules of the reports on small literal tables."""

from __future__ import annotations

from conftest import DAY, rows
from pyspark.sql import functions as F

from dealflow import labels as L
from dealflow.config import Thresholds
from dealflow.operators import announced as N
from dealflow.operators import automation as A
from dealflow.operators import coverage as P
from dealflow.operators import lead_source as S
from dealflow.operators import trends as T
from dealflow.reports import REPORTS, run

WON = {"Deal_Status": "Won", "Stage": "Closed Won", "Close_Date": "2001-03-01"}
LOST = {"Deal_Status": "Lost", "Stage": "Closed Lost", "Close_Date": "2001-03-01"}


def close_in(days: int) -> str:
    from datetime import timedelta

    return str(DAY + timedelta(days=days))


def test_year_includes_later_closes_and_both_ends(make):
    deals = make(
        *[{**WON, "Close_Date": d} for d in ("2001-01-01", "2001-12-31")],
        *[{**WON, "Close_Date": d} for d in ("2000-12-31", "2002-01-01", "", None, "junk")],
    )
    assert T.ytd_won_lost_by_rep(deals, DAY).first().won_deals == 2


def test_attainment_takes_quota_of_won_deals_only(make):
    deals = make(
        {**WON, "Deal_Size": 100, "Quota_Contribution": 400.0},
        {**LOST, "Deal_Size": 300, "Quota_Contribution": 999.0, "Sales_Cycle_Days": None},
    )
    row = T.ytd_quota_attainment(deals, DAY).first()
    assert (row.ytd_quota_contribution, row.quota_attainment_pct) == (400.0, 25.0)
    assert (row.avg_won_deal_size, row.avg_lost_deal_size) == (100.0, 300.0)
    assert (row.avg_won_cycle_days, row.avg_lost_cycle_days) == (40.0, None)


def test_all_won_without_quota_has_no_attainment(make):
    row = T.ytd_quota_attainment(make({**WON, "Quota_Contribution": 0.0}), DAY).first()
    assert row.quota_attainment_pct is None


def test_stuck_means_more_than_seven_days(make):
    deals = make(
        {"Days_in_Stage": 7},
        {"Days_in_Stage": 8, "Stage": "Proposal"},
        {"Days_in_Stage": 9, "Stage": "Closing"},
        {**WON, "Days_in_Stage": 50},
    )
    row = T.stuck_deals_by_rep(deals).first()
    assert (row.stuck_deals, row.avg_days_stuck) == (2, 8.5)
    assert row.stages_affected == "Closing, Proposal"
    assert N.stuck_deals(deals).count() == 2


def test_months_tie_and_junk_dates_form_a_group(make):
    days = ["2001-01-05"] * 2 + ["2001-02-05"] * 2 + ["2001-03-05", "junk", "", None]
    result = rows(T.peak_and_lowest_months(make(*[{"Created_Date": d} for d in days])))
    assert [(r["created_month"], r["rank_by_count"], r["flag"]) for r in result] == [
        ("2001-01", 1, "PEAK"),
        ("2001-02", 1, "PEAK"),
        (None, 3, "LOWEST"),
        ("2001-03", 3, "LOWEST"),
    ]


def test_single_month_is_the_peak(make):
    assert T.peak_and_lowest_months(make({})).first().flag == "PEAK"


def test_leaderboard_leaves_gaps_after_ties(make):
    deals = make(
        *[{**WON, "Sales_Rep": r, "Deal_Size": s} for r, s in (("A", 5), ("B", 5), ("C", 1))]
    )
    assert [r["leaderboard_rank"] for r in rows(T.rep_leaderboard(deals, DAY))] == [1, 1, 3]


def test_close_windows_are_inclusive(make):
    days = (-1, 0, 30, 31, 90, 91)
    deals = make(
        *[{"Expected_Close_Date": close_in(d), "Deal_Size": 1} for d in days],
        {"Expected_Close_Date": None, "Deal_Size": 1},
        {"Expected_Close_Date": "junk", "Deal_Size": 1},
    )
    row = P.pipeline_by_close_window(deals, DAY).first()
    assert (row.total_open_deals, row.pipeline_overdue) == (8, 1)
    assert (row.pipeline_0_30_days, row.deals_0_30_days) == (2, 2)
    assert (row.pipeline_31_90_days, row.deals_31_90_days) == (2, 2)
    assert row.pipeline_90_plus_days == 1


def test_health_uses_the_rounded_ratio_and_is_healthy_without_quota(make):
    cases = {"a": 994.0, "b": 996.0, "c": 2000.0, "d": 3000.0, "e": None, "f": 0.0}
    deals = make(
        *[
            {
                "Sales_Rep": rep,
                "Deal_Size": 1000 if quota in (None, 0.0) else int(quota),
                "Quota_Contribution": quota if quota in (None, 0.0) else 1000.0,
            }
            for rep, quota in cases.items()
        ]
    )
    got = {r["Sales_Rep"]: r["coverage_health"] for r in rows(P.coverage_health(deals, DAY))}
    assert got == {
        "a": "CRITICAL",  # 0.99
        "b": "AT RISK",  # 0.996 shows as 1.0
        "c": "BELOW TARGET",
        "d": "HEALTHY",
        "e": "HEALTHY",
        "f": "HEALTHY",
    }
    first = P.coverage_health(deals, DAY).first()
    assert first.coverage_ratio is None


def test_region_counts_each_rep_once(make):
    deals = make({"Sales_Rep": "A"}, {"Sales_Rep": "A"}, {"Sales_Rep": "B"}, {"Sales_Rep": None})
    row = P.coverage_by_region(deals, DAY).first()
    assert (row.rep_count, row.total_pipeline) == (2, 80_000)


def test_conversion_takes_current_stage_but_won_status(make):
    deals = make(
        {"Stage": "Prospecting"},
        {"Stage": "Discovery"},
        {"Stage": "Closed Won", "Deal_Status": "Open"},
        {"Stage": "Prospecting", "Deal_Status": "Won"},
    )
    row = S.stage_conversion(deals).first()
    assert (row.past_qualification, row.past_proposal, row.past_negotiation) == (2, 1, 1)
    assert (row.closed_won, row.pct_closed_won) == (1, 25.0)


def test_rates_without_closed_deals_are_null(make):
    assert S.source_by_stage(make({})).first().stage_win_rate_pct is None
    card = S.source_scorecard(make({**WON})).first()
    assert card.stall_rate_pct is None and card.source_grade == L.GRADE_B


def test_velocity_ranks_unrounded_and_zero_cycles_last(make):
    deals = make(
        {**WON, "Lead_Source": "a", "Deal_Size": 1000, "Sales_Cycle_Days": 10},
        {**WON, "Lead_Source": "b", "Deal_Size": 1001, "Sales_Cycle_Days": 10},
        {**WON, "Lead_Source": "c", "Deal_Size": 9000, "Sales_Cycle_Days": 0},
        {**WON, "Lead_Source": "d", "Deal_Size": 100, "Sales_Cycle_Days": None},
        {**WON, "Lead_Source": "d", "Deal_Size": 100, "Sales_Cycle_Days": 4},
    )
    got = [(r["Lead_Source"], r["revenue_per_day"], r["velocity_rank"])
           for r in rows(S.velocity_scorecard(deals))]
    assert got == [("b", 100.0, 1), ("a", 100.0, 2), ("d", 50.0, 3), ("c", None, 4)]


def test_decay_needs_an_explicit_flag(make):
    row = S.decay_funnel(
        make({"Is_Stalled": "FALSE"}, {"Is_Stalled": "TRUE"}, {"Is_Stalled": None}, LOST)
    ).first()
    assert (row.total_created, row.active_open, row.stalled, row.lost) == (4, 1, 1, 1)
    assert (row.pct_decayed, row.total_waste_pct) == (25.0, 50.0)


def test_best_month_wins_over_worst(make):
    deals = make(
        {"Lead_Source": "one", "Created_Date": "2001-05-01"},
        *[{"Lead_Source": "two", "Created_Date": d} for d in ("2000-01-01", "2001-01-09")],
        {"Lead_Source": "two", "Created_Date": "2001-03-01"},
    )
    got = [(r["Lead_Source"], r["month_name"], r["label"]) for r in rows(S.best_worst_month(deals))]
    assert got == [
        ("one", "May", "BEST MONTH"),
        ("two", "January", "BEST MONTH"),
        ("two", "March", "WORST MONTH"),
    ]


def test_quarter_of_junk_date_is_null(make):
    deals = make({**WON, "Close_Date": "2001-07-01"}, {**WON, "Close_Date": "junk"},
                 {**WON, "Close_Date": ""})
    assert [r["close_quarter"] for r in rows(S.quarterly_win_rate(deals))] == [None, "2001-Q3"]


def test_competitors_and_empty_reasons(make):
    deals = make(
        {**LOST, "Competitor_Name": "Globex", "Reason_Lost": ""},
        {**LOST, "Competitor_Name": "Globex", "Reason_Lost": "Price"},
        {**LOST, "Competitor_Name": "Globex", "Reason_Lost": None},
        {**LOST, "Competitor_Name": ""},
        {**WON, "Competitor_Name": "Acme"},
        {"Lead_Source": "Event"},
    )
    got = {r["Lead_Source"]: r for r in rows(S.competitive_loss_rate(deals))}
    assert got["Web"]["competitors_faced"] == "Globex"
    assert got["Web"]["competitive_loss_rate_pct"] == 75.0
    assert got["Event"]["competitors_faced"] is None
    assert got["Event"]["competitive_loss_rate_pct"] is None
    row = S.source_competitor_matrix(deals).first()
    assert (row.losses_to_competitor, row.loss_reasons) == (3, ", Price")


def test_top_campaigns_take_a_limit(make):
    deals = make(*[{**WON, "Campaign_Name": f"C{i:02d}", "Deal_Size": i} for i in range(12)])
    assert S.top_campaigns(deals).count() == 10
    top = rows(S.top_campaigns(deals, cfg=Thresholds(top_n=2)))
    assert [r["Campaign_Name"] for r in top] == ["C11", "C10"]


def test_health_score_penalties_and_missing_benchmark(make):
    deals = make(
        # Benchmarks of Proposal: lost cycle 30, won stage age 10
        {**LOST, "Stage": "Proposal", "Sales_Cycle_Days": 30},
        {**WON, "Stage": "Proposal", "Days_in_Stage": 10},
        {
            "Opportunity_ID": "worst",
            "Is_Stalled": "TRUE",
            "Expected_Close_Date": close_in(-1),
            "Sales_Cycle_Days": 31,
            "Days_in_Stage": 21,
            "Last_Activity_Date": close_in(-15),
            "Win_Probability": 29,
        },
        {"Opportunity_ID": "idle", "Last_Activity_Date": close_in(-14), "Sales_Cycle_Days": 30,
         "Days_in_Stage": 20, "Win_Probability": 30},
        {"Opportunity_ID": "alone", "Stage": "Closing", "Sales_Cycle_Days": 999},
        {"Opportunity_ID": "beyond", "Stage": "Closing", "Sales_Cycle_Days": 1000,
         "Last_Activity_Date": "", "Is_Stalled": None},
    )
    got = {r["Opportunity_ID"]: r for r in rows(A.deal_health_scores(deals, DAY))}
    assert got["worst"]["health_score"] == 0
    assert got["worst"]["risk_flags"] == (
        "STALLED, OVERDUE, EXCEEDS LOST CYCLE AVG, STUCK IN STAGE, NO RECENT ACTIVITY, "
        "LOW PROBABILITY"
    )
    assert got["worst"]["action_category"] == "INTERVENE NOW"
    assert (got["idle"]["health_score"], got["idle"]["risk_flags"]) == (95, "")
    assert (got["alone"]["health_score"], got["alone"]["action_category"]) == (100, "MONITOR")
    assert got["beyond"]["health_score"] == 80
    assert got["beyond"]["days_since_activity"] is None


def test_reduced_score_never_goes_below_35_by_itself(make):
    deals = make({
        "Is_Stalled": "TRUE", "Expected_Close_Date": close_in(-1), "Win_Probability": 0,
        "Last_Activity_Date": close_in(-30), "Deal_Size": 7,
    })
    row = A.health_by_rep(deals, DAY).first()
    assert (row.avg_health_score, row.critical_deals, row.critical_value) == (35.0, 1, 7)
    assert row.pct_pipeline_critical == 100.0


def test_queue_rank_ignores_tier_and_size(make):
    deals = make(
        {"Opportunity_ID": "b", "Account_Tier": "Enterprise", "Deal_Size": 90_000},
        {"Opportunity_ID": "a", "Deal_Size": 12_345},
        {"Opportunity_ID": "c", "Forecast_Category": "Commit", "Deal_Size": None},
        {"Opportunity_ID": "d", "Deal_Size": 5_000_000},
    )
    got = [(r["Opportunity_ID"], r["priority_score"], r["daily_rank"])
           for r in rows(A.priority_queue(deals, DAY))]
    assert got == [("c", None, 1), ("a", 1.2345, 2), ("b", 19.0, 3), ("d", 10.0, 4)]


def test_queue_actions(make):
    stalled, late, soon = (
        {"Is_Stalled": "TRUE"},
        {"Expected_Close_Date": close_in(-1)},
        {"Expected_Close_Date": close_in(7)},
    )
    deals = make(
        {**stalled, **late},
        late,
        {**soon, **stalled},
        {**stalled, "Stage": "Contract"},
        {**stalled, "Stage": "Closing"},
        {"Last_Activity_Date": close_in(-15)},
        {"Last_Activity_Date": close_in(-8)},
        {"Last_Activity_Date": close_in(-7), "Expected_Close_Date": close_in(8)},
    )
    got = rows(A.priority_queue(deals, DAY).orderBy("Opportunity_ID"))
    assert [r["suggested_action"] for r in got] == [
        L.ESCALATE, L.URGENT, L.FINAL_PUSH, L.RE_ENGAGE, L.REVIVE, L.FOLLOW_UP, L.CHECK_IN,
        L.ON_TRACK,
    ]


def test_forecast_rules_and_flags(make):
    history = [{**WON, "Stage": "Closing"}] * 3 + [{**LOST, "Stage": "Closing"}]
    poor = [{**LOST, "Stage": "Discovery"}] * 3 + [{**WON, "Stage": "Discovery"}]
    close, disc = {"Stage": "Closing"}, {"Stage": "Discovery"}
    deals = make(
        *history,
        *poor,
        {"Opportunity_ID": "1", **close, "Is_Stalled": "TRUE", "Days_in_Stage": 15},
        {"Opportunity_ID": "2", **close, "Is_Stalled": "TRUE", "Expected_Close_Date": close_in(-1),
         "Forecast_Category": "Commit"},
        {"Opportunity_ID": "3", **close, "Forecast_Category": "Upside"},
        {"Opportunity_ID": "4", **close, "Is_Stalled": None},
        {"Opportunity_ID": "5", **disc, "Forecast_Category": "Commit"},
        {"Opportunity_ID": "6", "Stage": "Nowhere", "Forecast_Category": "Commit"},
        {"Opportunity_ID": "7", **close, "Deal_Size": 5},
    )
    got = {r["Opportunity_ID"]: (r["historical_win_rate"], r["suggested_forecast"],
                                 r["forecast_flag"])
           for r in rows(A.forecast_suggestions(deals, DAY))}
    assert got == {
        "1": (75.0, "Omit", L.UNDER_CALLED),
        "2": (75.0, "Omit", L.COMMITTED_STALLED),
        "3": (75.0, "Commit", L.UNDER_CALLED),
        "4": (75.0, "Upside", L.UNDER_CALLED),
        "5": (25.0, "Pipeline", L.COMMITTED_LOW_RATE),
        "6": (None, "Pipeline", ""),
        "7": (None, "Pipeline", ""),  # no closed deal of this size
    }


def test_gap_alerts_repeat_the_rep_total_and_follow_the_list(make):
    def deal(rep, region, near, mid, quota=1000.0):
        both = {"Sales_Rep": rep, "Region": region, "Quota_Contribution": quota / 2}
        return [
            {**both, "Expected_Close_Date": close_in(5), "Deal_Size": near},
            {**both, "Expected_Close_Date": close_in(50), "Deal_Size": mid},
        ]

    deals = make(
        {**WON, "Sales_Rep": "A", "Region": "North", "Deal_Size": 70},
        {**WON, "Sales_Rep": "A", "Region": "South", "Deal_Size": 30},
        {**WON, "Sales_Rep": "Z", "Deal_Size": 30},
        {**WON, "Sales_Rep": None, "Deal_Size": 30},
        *deal("A", "North", 300, 500),
        *deal("A", "South", 0, 0),
        *deal("B", "North", 10, 0),
        *deal("C", "North", 900, 499),
        *deal("D", "North", 299, 500),
        *deal(None, "North", 300, 500),
    )
    got = [(r["Sales_Rep"], r["ytd_won"], r["pipeline_alert"], r["recommended_action"])
           for r in rows(A.pipeline_gap_alerts(deals, DAY))]
    assert got == [
        ("A", 100, L.ALERT_NONE_90, L.DO_PROSPECT),
        ("B", 0, L.ALERT_NONE_MID, L.DO_PROSPECT),
        ("C", 0, L.ALERT_LOW_MID, L.DO_OUTBOUND),
        ("D", 0, L.ALERT_LOW_NEAR, L.DO_ACCELERATE),
        (None, 0, L.ALERT_OK, L.DO_MAINTAIN),
        ("A", 100, L.ALERT_OK, L.DO_MAINTAIN),
    ]


def test_reminders_by_stage_limit(make):
    deals = make(
        *[{"Stage": "Contract", "Last_Activity_Date": close_in(-d)} for d in (3, 4, 6, 7, 9, 10)],
        {"Stage": "Unknown", "Last_Activity_Date": close_in(-99)},
        {"Stage": "Closing", "Last_Activity_Date": "2001-7-1 late"},
    )
    got = rows(A.stale_deal_reminders(deals, DAY))
    assert [(r["reminder_level"], r["days_overdue"]) for r in got] == [
        (L.REMIND_DEAD, 7),
        (L.REMIND_DEAD, 14),
        (L.REMIND_URGENT, 4),
        (L.REMIND_URGENT, 6),
        (L.REMIND, 1),
        (L.REMIND, 3),
    ]
    assert got[1]["Last_Activity_Date"] == "2001-7-1 late"
    assert got[1]["suggested_outreach"] == L.OUTREACH["Closing"]


def test_patterns_need_three_deals_and_half_lost(make):
    deals = make(
        *[{**LOST, "Industry": "Retail", "Reason_Lost": r} for r in ("Price", "", None)],
        {**WON, "Industry": "Retail", "Reason_Lost": "ignored"},
        *[{**LOST, "Industry": "Energy"}] * 2,
        *[{**WON, "Industry": "Food"}] * 3,
        *[{**LOST, "Industry": None}] * 3,
        {"Opportunity_ID": "hit", "Industry": "Retail"},
        {"Opportunity_ID": "miss", "Industry": "Energy"},
        {"Opportunity_ID": "null", "Industry": None},
    )
    assert [(r["Industry"], r["total_closed"], r["loss_rate_pct"], r["common_loss_reasons"])
            for r in rows(A.loss_patterns(deals))] == [
        (None, 3, 100.0, None), ("Retail", 4, 75.0, "Price"),
    ]
    got = rows(A.coaching_prompts(deals))
    assert [r["Opportunity_ID"] for r in got] == ["hit"]
    assert got[0]["coaching_prompt"] == (
        "WARNING: Deals from Web in Retail (Mid tier) historically lose 75.0% of the time. "
        "Common reasons: Price. Consider adjusting strategy early."
    )


def test_week_lists_keep_duplicates_in_order(make):
    new = {"Created_Date": "2001-07-16"}
    deals = make(
        {**new, "Opportunity_Name": "x", "Deal_Size": 1},
        {**new, "Opportunity_Name": "y", "Deal_Size": None},
        {**new, "Opportunity_Name": "x", "Deal_Size": 3},
        {**new, "Opportunity_Name": "a", "Deal_Size": 1, "Deal_Status": "Lost"},
        {**new, "Opportunity_Name": None, "Deal_Size": 9},
        {"Created_Date": "2001-07-15", "Opportunity_Name": "old"},
        {"Created_Date": "2001-12-01", "Opportunity_Name": "later", "Deal_Size": 2},
    )
    row = A.week_created(deals, DAY).first()
    assert row.new_deals == "x, later, a, x, y"
    assert (row.deals_created_this_week, row.new_pipeline_value) == (6, 16)
    assert row.avg_new_deal_size == 3.2


def test_freshly_stalled_are_idle_for_one_to_two_weeks(make):
    deals = make(
        *[{"Is_Stalled": "TRUE", "Last_Activity_Date": close_in(-d), "Opportunity_Name": f"d{d}",
           "Deal_Size": d} for d in (6, 7, 14, 15)],
        {"Is_Stalled": "TRUE", "Last_Activity_Date": close_in(-8), "Stage": None},
    )
    row = A.week_stalled(deals, DAY).first()
    assert (row.newly_stalled, row.stalled_deals) == (3, "d14 (Proposal); d7 (Proposal)")


def test_digest_repeats_by_region_and_drops_reps_without_open_deals(make):
    deals = make(
        {"Sales_Rep": "A", "Region": "North"},
        {"Sales_Rep": "A", "Region": "South", "Is_Stalled": "TRUE", "Deal_Size": 5},
        {**WON, "Sales_Rep": "A", "Region": "East", "Close_Date": "2001-07-17", "Deal_Size": 8,
         "Created_Date": "2001-07-16"},
        {**LOST, "Sales_Rep": "B", "Close_Date": "2001-07-17"},
        {"Sales_Rep": None, "Created_Date": "2001-07-16"},
    )
    got = {(r["Sales_Rep"], r["Region"]): r for r in rows(A.weekly_digest(deals, DAY))}
    assert set(got) == {("A", "North"), ("A", "South"), (None, "North")}
    for region in ("North", "South"):
        row = got["A", region]
        assert (row["deals_created"], row["deals_won"], row["won_value"]) == (1, 1, 8)
    assert (got["A", "South"]["stalled_deals"], got["A", "South"]["stalled_value"]) == (1, 5)
    # A missing rep matches no rep, not even another missing one.
    assert got[None, "North"]["deals_created"] == 0


def test_capability_splits_by_tenure_and_scores(make):
    base = {"Sales_Rep": "A"}
    deals = make(
        {**base, **WON, "Deal_Size": None, "Industry": "Food"},
        {**base, **WON, "Deal_Size": 100_000},
        {**base, **LOST, "Deal_Size": 9_999},
        base,
        base,
        {**base, "Rep_Tenure_Months": 15},
        {"Sales_Rep": "B", **WON},
    )
    got = {(r["Sales_Rep"], r["Rep_Tenure_Months"]): r for r in rows(A.rep_capability(deals))}
    row = got["A", 14]
    assert (row["current_open_deals"], row["current_pipeline"]) == (2, 40_000)
    assert (row["small_deal_win_rate"], row["mid_deal_win_rate"]) == (0.0, None)
    assert row["enterprise_deal_win_rate"] == 100.0
    assert row["industries_won"] == "Food, Retail"
    assert row["routing_score"] == 33.33
    assert got["A", 15]["routing_score"] == 0.0
    assert got["B", 14]["routing_score"] is None


def test_matches_need_senior_reps_for_large_deals(make):
    deals = make(
        {"Opportunity_ID": "p1", "Stage": "Prospecting", "Sales_Rep": "Jun",
         "Rep_Tenure_Months": 11},
        {"Opportunity_ID": "p2", "Stage": "Prospecting", "Sales_Rep": "Jun",
         "Rep_Tenure_Months": 11, "Deal_Size": None},
        {**WON, "Sales_Rep": "Sen", "Rep_Tenure_Months": 12},
        {"Sales_Rep": "Far", "Region": "South"},
        {"Opportunity_ID": "p3", "Stage": "Prospecting", "Region": None},
    )
    got = {(r["Opportunity_ID"], r["recommended_rep"]): r["fit_reasons"]
           for r in rows(A.deal_rep_matches(deals))}
    assert got == {
        ("p1", "Sen"): "Same region; Industry experience; Has capacity",
        ("p1", "Jun"): "Same region; Has capacity",
        ("p2", "Sen"): "Same region; Industry experience; Senior for enterprise; Has capacity",
    }


def test_commit_accuracy_profiles(make):
    def closed(rep, won, lost):
        deal = {"Sales_Rep": rep, "Forecast_Category": "Commit"}
        return [{**WON, **deal}] * won + [{**LOST, **deal}] * lost

    deals = make(*closed("A", 4, 1), *closed("B", 3, 2), *closed("C", 2, 3), *closed("D", 1, 4))
    got = [(r["accuracy_pct"], r["profile"]) for r in rows(N.commit_accuracy(deals))]
    assert got == [
        (80.0, "HIGH ACCURACY"), (60.0, "GOOD"), (40.0, "LOW"), (20.0, "UNRELIABLE"),
    ]


def test_month_over_month(make):
    days = ["2001-01-01", "2001-01-02", "2001-03-01", ""]
    got = rows(N.mom_creation(make(*[{"Created_Date": d} for d in days])))
    assert [(r["created_month"], r["previous_month"], r["change"], r["pct_of_max"])
            for r in got] == [("2001-01", None, None, 100.0), ("2001-03", 2, -1, 50.0)]


def test_run_by_name(make):
    deals = make({}, WON)
    assert run("source_by_stage", deals).count() == 2
    try:
        run("nothing", deals)
    except KeyError as error:
        assert "source_by_stage" in str(error)
    else:
        raise AssertionError


def test_all_reports_take_an_empty_table(make):
    empty = make({}).where(F.lit(False))
    for name, report in REPORTS.items():
        assert report(empty, DAY).count() == 0, name
