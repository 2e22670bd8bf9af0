"""What reaches the scan, what is shuffled, and that no row passes through Python."""

from __future__ import annotations

import re

import pytest
from conftest import DAY, plan

from dealflow.operators import automation as A
from dealflow.operators import coverage as P
from dealflow.operators import lead_source as S
from dealflow.operators import trends as T
from dealflow.reports import REPORTS


@pytest.mark.parametrize("name", REPORTS)
def test_no_python_and_no_cross_join(stored, name):
    text = plan(REPORTS[name](stored, DAY))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "report",
    [
        P.pipeline_by_close_window,
        P.coverage_by_rep,
        P.coverage_by_forecast_category,
        P.coverage_by_region,
        P.coverage_health,
        A.rep_capability,
        S.source_scorecard,
        T.peak_and_lowest_months,
    ],
)
def test_one_scan(stored, report):
    assert plan(report(stored, DAY)).count("FileScan") == 1


@pytest.mark.parametrize("report", [A.pipeline_gap_alerts, A.weekly_digest])
def test_every_scan_is_pruned(stored, report):
    """Each part reads a status folder or a range of dates, and they are added up once."""
    text = plan(report(stored, DAY))
    scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\], ReadSchema", text)
    assert len(scans) > 1
    for folders, pushed in scans:
        dated = re.search(r"GreaterThanOrEqual\((Close|Created)_Date", pushed)
        assert re.search(r"Open|Won|Lost", folders) or dated
    assert text.count("HashAggregate") == 2


def test_idle_time_reaches_the_parquet_scan(stored):
    text = plan(A.week_stalled(stored, DAY))
    assert "GreaterThanOrEqual(Last_Activity_Date,2001-07-04)" in text
    assert "LessThanOrEqual(Last_Activity_Date,2001-07-11)" in text
    assert "LessThan(Last_Activity_Date,2001-07-15)" in plan(A.stale_deal_reminders(stored, DAY))


def test_lists_are_reduced_one_by_one(stored):
    """No aggregate holds combinations of reasons and competitors."""
    for line in plan(A.loss_patterns(stored, DAY)).splitlines():
        keys = re.search(r"HashAggregate\(keys=\[(.*?)\], functions", line)
        assert not keys or not ("common_loss_reasons" in keys[1] and "competitors" in keys[1])


def test_status_prunes_folders(stored):
    text = plan(P.coverage_health(stored, DAY))
    assert re.search(r"PartitionFilters: \[[^]]*Deal_Status[^]]*Open", text)


def test_year_reaches_the_parquet_scan(stored):
    text = plan(T.ytd_won_lost_by_rep(stored, DAY))
    pushed = re.search(r"PushedFilters: \[([^]]*)\]", text).group(1)
    assert "GreaterThanOrEqual(Close_Date,2001-01-01)" in pushed
    assert "LessThan(Close_Date,2002-01-01)" in pushed


def test_week_reaches_the_parquet_scan(stored):
    assert "GreaterThanOrEqual(Close_Date,2001-07-16)" in plan(A.week_closed(stored, DAY))


@pytest.mark.parametrize(
    ("report", "columns"),
    [
        (T.stuck_deals_by_rep, {"Sales_Rep", "Region", "Stage", "Deal_Size", "Days_in_Stage"}),
        (S.stage_conversion, {"Lead_Source", "Stage"}),
        (P.coverage_by_region,
         {"Region", "Sales_Rep", "Deal_Size", "Win_Probability", "Quota_Contribution",
          "Expected_Close_Date"}),
    ],
)
def test_only_needed_columns_are_read(stored, report, columns):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(report(stored, DAY))).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == columns


@pytest.mark.parametrize(
    "report",
    [A.deal_health_scores, A.forecast_suggestions, A.coaching_prompts, A.deal_rep_matches],
)
def test_deals_are_not_shuffled_for_lookups(stored, report):
    text = plan(report(stored, DAY))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "hashpartitioning" not in text


def test_top_campaigns_sort_no_more_than_they_keep(stored):
    assert "TakeOrderedAndProject" in plan(S.top_campaigns(stored))


def test_global_windows_come_after_aggregation(stored):
    for report in (T.peak_and_lowest_months, S.velocity_scorecard):
        text = plan(report(stored, DAY))
        below = text[text.index("SinglePartition") :]
        assert "HashAggregate" in below
