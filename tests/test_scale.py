"""The ways taken beyond one task's or a broadcast's size give the same rows."""

from __future__ import annotations

import dataclasses
import random
import re

import pytest
from conftest import DAY, TESTDATA, plan, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.deals_view import deals as view
from dealflow.config import DEFAULTS
from dealflow.operators import automation as A
from dealflow.operators import lead_source as S
from dealflow.operators import trends as T
from dealflow.plans import (
    count_pairs,
    down,
    join_lookup,
    listed,
    numbered,
    pair_partitions,
    paired_in_order,
    ranked,
)

SPLIT = dataclasses.replace(DEFAULTS, task_rows=20)
MERGED = dataclasses.replace(DEFAULTS, broadcast_rows=0, task_rows=100)


@pytest.fixture(scope="module")
def skewed(spark):
    """Deals of which one rep and region have most, and some have none."""
    hot = F.pmod(F.xxhash64("Opportunity_ID"), F.lit(10))
    deals = view(spark, str(TESTDATA / "sf0.001"))
    rep = F.when(hot < 6, "Rep-7").when(hot == 6, None).otherwise(F.col("Sales_Rep"))
    region = F.when(hot < 6, "ASIA").otherwise(F.col("Region"))
    return deals.withColumns({"Sales_Rep": rep, "Region": region}).cache()


LOOKUPS = [A.deal_health_scores, A.forecast_suggestions, A.coaching_prompts]


@pytest.mark.parametrize("report", LOOKUPS)
def test_salted_lookup_equals_broadcast(skewed, report):
    salted, small = report(skewed, DAY, MERGED), report(skewed, DAY)
    assert "BroadcastHashJoin" in plan(small)
    assert salted.collect() == small.collect()
    text = plan(salted)
    assert re.search(r"SortMergeJoin \[.*_salt", text)
    assert not re.search(r"BroadcastHashJoin \[.*(Stage|Region|Lead_Source)", text)


def test_salts_follow_the_largest_key(spark):
    deals = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', 'cold') k")
    lookup = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    joined = join_lookup(deals, lookup, ["k"], F.col("id"), MERGED)
    assert "pmod(xxhash64(id" in plan(joined) and ", 9)" in plan(joined)
    assert sorted(r.v for r in joined.collect()) == [1] * 900 + [2] * 100


def test_lookup_limit_on_text(spark):
    deals = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, id string")
    lookup = spark.createDataFrame([("a", "x" * 100)], "k string, v string")
    tight = dataclasses.replace(DEFAULTS, broadcast_chars=50)
    joined = join_lookup(deals, lookup, ["k"], F.col("id"), tight, "left")
    assert "_salt" in plan(joined)
    assert {r["k"]: r["v"] for r in rows(joined)} == {"a": "x" * 100, "b": None}


def test_product_keeps_the_order_without_moving_pairs(stored, skewed):
    """Profiles beyond a broadcast: pairs stay in the partition of their prospect."""
    for deals in (skewed, stored):
        want = A.deal_rep_matches(deals, DAY).collect()
        for task_rows in (1, 50, 10**6):
            cfg = dataclasses.replace(MERGED, task_rows=task_rows)
            assert A.deal_rep_matches(deals, DAY, cfg).collect() == want
    made = A.deal_rep_matches(stored, DAY, dataclasses.replace(MERGED, task_rows=1))
    above = plan(made).split("SortMergeJoin")[0]
    assert "Exchange" not in above and "_slice" in plan(made)
    below = plan(made).split("SortMergeJoin")[1]
    assert [re.search(r"\w+", x)[0] for x in below.split("Exchange ")[1:]] == ["shufflepartitionidpassthrough"] * 2


def test_product_of_odd_rows(spark):
    left = spark.createDataFrame(
        [(None, "x"), ("b", "x"), ("a", "y"), ("a", None), ("c", "z"), ("d", "x"), ("d", "x")], "o string, k string"
    )
    right = spark.createDataFrame([("x", i) for i in range(30)] + [("y", 1), (None, 2), ("w", 3)], "k string, v int")
    want = left.join(right, "k").orderBy("o", "v").collect()
    for task_rows in (1, 20, 1000):
        cfg = dataclasses.replace(DEFAULTS, task_rows=task_rows)
        got = paired_in_order(left, right, "k", ["o"], 150, cfg).sortWithinPartitions("o", "v")
        assert [tuple(r[c] for c in ("k", "o", "v")) for r in got.collect()] == [tuple(r) for r in want]
    nothing = paired_in_order(left.where("false"), right, "k", ["o"], 0, DEFAULTS)
    assert nothing.collect() == []


@pytest.mark.parametrize(
    "report",
    [S.competitive_loss_rate, S.source_competitor_matrix, A.loss_patterns, A.coaching_prompts, A.rep_capability,
     T.stuck_deals_by_rep, S.top_campaigns],
)
def test_distinct_lists_in_slices(skewed, report):
    for size in (1, 7, 30):
        cfg = dataclasses.replace(DEFAULTS, list_slice_bytes=size)
        assert rows(report(skewed, DAY, cfg)) == rows(report(skewed, DAY))


def test_a_distinct_list_that_no_cell_holds_is_named(make):
    deals = make(
        *[{"Deal_Status": "Lost", "Reason_Lost": c * 30, "Lead_Source": "Fair", "Competitor_Name": "A"} for c in "abc"],
        *[{"Deal_Status": "Lost", "Reason_Lost": "d" * 30, "Competitor_Name": "A"}] * 9,
    )
    tight = dataclasses.replace(DEFAULTS, cell_bytes=95)
    with pytest.raises(Exception, match=r"list loss_reasons of .*Fair.* has more than 95 bytes"):
        S.source_competitor_matrix(deals, DAY, tight).collect()
    wide = dataclasses.replace(DEFAULTS, cell_bytes=96)
    got = {r["Lead_Source"]: r["loss_reasons"] for r in rows(S.source_competitor_matrix(deals, DAY, wide))}
    assert got == {"Fair": ", ".join(c * 30 for c in "abc"), "Web": "d" * 30}


def test_partitions_follow_the_number_of_pairs(spark):
    left = spark.createDataFrame([("a",)] * 30 + [("b",)] * 5 + [(None,)], "k string")
    right = spark.createDataFrame([("a",)] * 10 + [("b",), ("c",), (None,)], "k string")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = count_pairs(left, right, "k")
    assert pairs == 305
    assert pair_partitions(pairs, left, DEFAULTS) == usual
    assert pair_partitions(pairs, left, SPLIT) == 16  # 20 to a task


def test_split_ranking_equals_window(skewed):
    assert rows(A.priority_queue(skewed, DAY, SPLIT)) == rows(A.priority_queue(skewed, DAY))


def test_split_ranking_cuts_the_hot_group(spark):
    df = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") < 900, "hot").alias("k"), (F.col("id") % 7).alias("v")
    )
    order = [*down(F.col("v")), F.col("id")]
    got = numbered(df, ["k"], order, "n", SPLIT, ordered=True)
    window = Window.partitionBy("k").orderBy(F.desc("v"), F.col("id"))
    expected = df.withColumn("n", F.row_number().over(window).cast("bigint"))
    assert got.columns == expected.columns
    assert got.collect() == expected.orderBy("k", *order).collect()


@pytest.mark.parametrize("seed", range(6))
def test_slices_cut_any_order(spark, seed):
    """NULLs in keys and order, texts, doubles, groups of one to many rows, sizes of slices."""
    rng = random.Random(seed)
    rows_ = [
        (rng.choice([None, "a", "b'\"\\", "é"]) if rng.random() < 0.6 else f"g{i % 40}", rng.choice([None, 1, 2, 2**40]),
         rng.choice([None, "x", "y\n", ""]), i / 7)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows_, "k string, v bigint, t string, u double").repartition(5)
    order = [*down(F.col("v")), F.col("t"), F.col("u")]
    for keys in (["k"], ["k", "t"], []):
        cfg = dataclasses.replace(DEFAULTS, task_rows=rng.choice([1, 3, 20, 150]))
        got = numbered(df, keys, order, "n", cfg, ordered=True)
        window = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("v"), "t", "u")
        expected = df.withColumn("n", F.row_number().over(window).cast("bigint"))
        assert got.collect() == expected.orderBy(*keys, "n").collect()


def test_a_sliced_queue_is_one_exchange_and_nothing_stored(stored, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "checkpoint", None)
    text = plan(A.priority_queue(stored, DAY, dataclasses.replace(DEFAULTS, task_rows=5)))
    assert "_slice" in text and len(re.findall(r"Exchange (?!SinglePartition)", text)) == 1
    assert "from_json" not in text  # the cuts are a literal, not parsed for every row


@pytest.mark.parametrize("task_rows", [1, 7, 200, 10_000])
def test_ranks_with_ties_across_cuts(spark, task_rows):
    """A third of the values are equal, some are NULL, and cuts fall on repeated values."""
    cfg = dataclasses.replace(DEFAULTS, task_rows=task_rows)
    df = spark.range(600).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 50)
        .when(F.col("id") % 97 == 1, None)
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(120)) - 20)
        .alias("v"),
    )
    for some in (df, df.where("v = 50"), df.where("v is null"), df.where("id < 2"), df.where("false")):
        got = ranked(some, "v", ["id"], "r", cfg)
        expected = some.withColumn("r", F.rank().over(Window.orderBy(F.desc("v")))).orderBy("r", "id")
        assert got.columns == expected.columns
        assert got.collect() == expected.collect()


def test_leaderboard_of_many_reps_ranks_in_no_single_task(skewed):
    for cfg in (SPLIT, dataclasses.replace(DEFAULTS, task_rows=3)):
        board = T.rep_leaderboard(skewed, DAY, cfg)
        assert "SinglePartition" not in plan(board)
        assert plan(board).count("rangepartitioning") == plan(board).count("Exchange ") == 1
        assert board.collect() == T.rep_leaderboard(skewed, DAY).collect()


@pytest.mark.parametrize("report", [A.week_created, A.week_stalled])
@pytest.mark.parametrize("task_rows", [1, 2, 7])
def test_long_lists_stay_in_one_row(skewed, report, task_rows):
    cfg = dataclasses.replace(DEFAULTS, task_rows=task_rows)
    assert rows(report(skewed, DAY, cfg)) == rows(report(skewed, DAY))


@pytest.mark.parametrize("task_rows", [3, 100])
def test_other_groups_do_not_change_a_row(make, task_rows):
    cfg = dataclasses.replace(DEFAULTS, task_rows=task_rows)
    bob = [{"Sales_Rep": "Bob", "Opportunity_Name": f"B{i}", "Deal_Size": i} for i in range(5)]
    ann = [{"Sales_Rep": "Ann", "Opportunity_Name": "x" * 500} for _ in range(50)]

    def of_bob(*deals):
        made = listed(make(*deals), ["Sales_Rep"], {"n": F.count("*")}, "l", F.col("Opportunity_Name"), ", ", cfg)
        return [tuple(r) for r in made.where("Sales_Rep = 'Bob'").collect()]

    assert of_bob(*bob) == of_bob(*bob, *ann) == [("Bob", 5, "B4, B3, B2, B1, B0")]


def test_a_list_that_no_cell_holds_is_named(make):
    deals = make(*[{"Opportunity_Name": "c" * 30, "Region": "North"}] * 3)
    with pytest.raises(ValueError, match="North"):
        listed(deals, ["Region"], {"n": F.count("*")}, "l", F.col("Opportunity_Name"), ", ",
               DEFAULTS, cell_bytes=90)


def test_list_of_nulls_stays_null_in_both_ways(make):
    deals = make(*[{"Opportunity_Name": None}] * 3)
    for cfg in (DEFAULTS, dataclasses.replace(DEFAULTS, task_rows=2)):
        result = listed(
            deals, ["Region"], {"n": F.count("*")}, "l", F.col("Opportunity_Name"), ",", cfg
        )
        (only,) = result.collect()
        assert (only.n, only.l) == (3, None)


def test_long_form_has_every_deal_of_the_lists(skewed):
    for lists, deals, n in (
        (A.week_created, A.week_created_deals, "deals_created_this_week"),
        (A.week_stalled, A.week_stalled_deals, "newly_stalled"),
    ):
        counts = {(r["Sales_Rep"], r["Region"]): r[n] for r in rows(lists(skewed, DAY))}
        places: dict = {}
        for r in rows(deals(skewed, DAY)):
            places.setdefault((r["Sales_Rep"], r["Region"]), []).append(r["position"])
        assert {k: len(v) for k, v in places.items()} == counts
        assert all(v == list(range(1, len(v) + 1)) for v in places.values())


@pytest.mark.parametrize("partitions", [1, 3, 7, 16])
def test_quota_sums_do_not_hang_on_the_order(spark, make, partitions):
    from dealflow.functions import exprs as X

    quotas = spark.range(12_000).select((F.xxhash64("id") % 100_000_000 / 1e5).alias("q"))
    shuffled = quotas.repartition(partitions, F.rand(partitions))
    exact = sum(int(round(r.q * 10**10)) for r in quotas.collect())
    assert shuffled.agg(X.quota_total(F.col("q"))).first()[0] == exact / 10**10


def test_candidates_can_be_limited(skewed):
    every = rows(A.deal_rep_matches(skewed, DAY))
    seen: dict = {}
    best = []
    for r in every:
        seen[r["Opportunity_ID"]] = seen.get(r["Opportunity_ID"], 0) + 1
        if seen[r["Opportunity_ID"]] <= 2:
            best.append(r)
    cfg = dataclasses.replace(DEFAULTS, match_candidates=2)
    assert rows(A.deal_rep_matches(skewed, DAY, cfg)) == best
    assert rows(A.deal_rep_matches(skewed, DAY, dataclasses.replace(MERGED, match_candidates=2))) == best
