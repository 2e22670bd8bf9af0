"""Relations that hold for any deals."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from conftest import DAY, rows

from dealflow.operators import automation as A
from dealflow.operators import coverage as P
from dealflow.operators import lead_source as S
from dealflow.operators import trends as T

DATES = ["2001-07-18", "2001-08-17", "2001-10-30", "2001-02-03", "2000-12-31", "", None, "junk"]


@pytest.fixture(scope="module", params=[1, 2, 3])
def deals(request, make):
    pick = random.Random(request.param)
    return make(
        *[
            {
                "Sales_Rep": pick.choice(["A", "B", "C", None]),
                "Region": pick.choice(["North", "South"]),
                "Stage": pick.choice(["Prospecting", "Proposal", "Closing", "Closed Won", None]),
                "Deal_Size": pick.choice([None, 0, 9_999, 10_000, 50_000, 2_000_000_000]),
                "Win_Probability": pick.choice([None, 0, 29, 30, 100]),
                "Created_Date": pick.choice(DATES),
                "Last_Activity_Date": pick.choice(DATES),
                "Expected_Close_Date": pick.choice(DATES),
                "Close_Date": pick.choice(DATES),
                "Days_in_Stage": pick.choice([None, 0, 8, 500]),
                "Account_Tier": pick.choice(["Enterprise", "SMB", None]),
                "Lead_Source": pick.choice(["Web", "Event", None]),
                "Quota_Contribution": pick.choice([0.0, 10.0, None]),
                "Is_Stalled": pick.choice(["TRUE", "FALSE", None]),
                "Deal_Status": pick.choice(["Open", "Won", "Lost", None]),
                "Sales_Cycle_Days": pick.choice([None, 0, 15, 91]),
            }
            for _ in range(120)
        ]
    ).cache()


def test_windows_and_undated_add_up(deals):
    undated = defaultdict(int)
    for r in rows(deals.where("Deal_Status = 'Open' AND Expected_Close_Date IS NULL")):
        undated[r["Sales_Rep"], r["Region"]] += r["Deal_Size"] or 0
    for r in rows(P.pipeline_by_close_window(deals, DAY)):
        parts = ("pipeline_0_30_days", "pipeline_31_90_days", "pipeline_90_plus_days",
                 "pipeline_overdue")
        total = sum(r[p] or 0 for p in parts) + undated[r["Sales_Rep"], r["Region"]]
        assert total == (r["total_pipeline"] or 0)


def test_region_is_the_sum_of_its_reps(deals):
    by_region = defaultdict(int)
    for r in rows(P.coverage_by_rep(deals, DAY)):
        by_region[r["Region"]] += r["total_pipeline"] or 0
    assert by_region == {
        r["Region"]: r["total_pipeline"] or 0 for r in rows(P.coverage_by_region(deals, DAY))
    }


def test_stages_are_nested(deals):
    for r in rows(S.stage_conversion(deals)):
        assert (
            r["total_deals"] >= r["past_qualification"] >= r["past_proposal"]
            >= r["past_negotiation"]
        )


@pytest.mark.parametrize(
    ("report", "share"),
    [(S.deal_type_fit, "pct_of_source_total"), (S.tier_distribution, "pct_of_source")],
)
def test_shares_add_up(deals, report, share):
    total = defaultdict(float)
    for r in rows(report(deals)):
        total[r["Lead_Source"]] += r[share]
    assert all(abs(t - 100) < 0.5 for t in total.values())


def test_scores_stay_in_range_and_keep_every_open_deal(deals):
    open_deals = deals.where("Deal_Status = 'Open'").count()
    scored = rows(A.deal_health_scores(deals, DAY))
    assert len(scored) == open_deals
    assert all(0 <= r["health_score"] <= 100 for r in scored)
    assert A.priority_queue(deals, DAY).count() == open_deals
    assert A.forecast_suggestions(deals, DAY).count() == open_deals


def test_ranks_count_from_one_per_rep(deals):
    ranks = defaultdict(list)
    for r in rows(A.priority_queue(deals, DAY)):
        ranks[r["Sales_Rep"]].append(r["daily_rank"])
    assert all(v == list(range(1, len(v) + 1)) for v in ranks.values())


def test_months_add_up_to_the_year(deals):
    by_month, by_region = defaultdict(int), defaultdict(int)
    for r in rows(T.ytd_monthly_progression(deals, DAY)):
        by_month[r["Sales_Rep"]] += r["won_value"] or 0
    for r in rows(T.ytd_won_lost_by_rep(deals, DAY)):
        by_region[r["Sales_Rep"]] += r["ytd_won_value"] or 0
    assert by_month == by_region


def test_health_bands_cover_open_deals(deals):
    for r in rows(A.health_by_rep(deals, DAY)):
        assert r["open_deals"] == r["critical_deals"] + r["at_risk_deals"] + r["healthy_deals"]
