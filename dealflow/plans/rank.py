"""Ranks and row numbers over tables and groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow.config import Thresholds
from dealflow.plans.checkpoint import settled

#: Rows sampled per slice to find where slices begin.
SAMPLED = 16


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: one number, from counts taken before the shuffle."""
    return group_sizes(df, keys)[0]


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups."""
    most, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return most or 0, total or 0


def down(c: Column) -> list[Column]:
    """A number in descending order, NULL last, as terms of an ascending order."""
    return [c.isNull(), -c]


def slice_of(key: Column, cuts: Column, most: int) -> Column:
    """How many of the sorted ``cuts``, ``most`` at most, are not above ``key``; 0 for NULL.

    A binary search, so the slice of a row hangs on the row alone.
    """
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length()))])

    def search(at: Column, step: Column) -> Column:
        reached = F.get(cuts, at + step - 1) <= key
        return F.when(F.coalesce(reached, F.lit(False)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), search)


def cut_points(df: DataFrame, key: Column, slices: int, total: int) -> tuple[Column, int]:
    """Values of the struct ``key`` that cut ``df`` into about equal ``slices``, and their number.

    They come from a sample of SAMPLED rows per slice, put in order by Spark, and are one
    literal array. Which rows are drawn only decides how even the slices are.
    """
    sample = df.sample(min(1.0, SAMPLED * slices / max(total, 1)), seed=7)
    found = sample.select(key.alias("key")).orderBy("key").select(F.to_json("key")).collect()
    picked = [found[len(found) * i // slices][0] for i in range(1, slices)] if found else []
    picked = list(dict.fromkeys(picked))
    kind = df.select(key.alias("key")).schema["key"].dataType
    cuts = F.from_json(F.lit(f"[{','.join(picked)}]"), f"array<{kind.simpleString()}>")
    return cuts, len(picked)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    cfg: Thresholds,
    ordered: bool = False,
) -> DataFrame:
    """Add ``name``, the position (from 1) of a row among those with equal ``keys``.

    ``order`` holds ascending terms (``down`` makes them of descending ones) and should end in
    a unique column. Rows are partitioned by range, which also serves the final order by keys
    and position (``ordered``). While every group is small enough for one task, groups stay
    whole and a window counts; otherwise they are cut into slices.
    """
    most, total = group_sizes(df, keys)
    if most > cfg.task_rows:
        return _numbered_in_slices(df, keys, order, name, total, cfg, ordered)
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.repartitionByRange(*keys).withColumn(name, F.row_number().over(window).cast("bigint"))
    return out.orderBy(*keys, *order) if ordered else out


def _numbered_in_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    total: int,
    cfg: Thresholds,
    ordered: bool,
) -> DataFrame:
    """The same with the table cut into slices, across groups, at literal rows.

    The slice of a row hangs on the row alone, so nothing is stored: one pass counts, another
    one numbers. A slice is a range of the order, so of all its groups only the one that holds
    the cut at its start can have rows before it; how many is one number per slice. A single
    exchange by keys and slice serves the window and the order.
    """
    of_keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    place = F.struct(*of_keys, *[o.alias(f"o{i}") for i, o in enumerate(order)])
    cuts, n = cut_points(df, place, -(-total // cfg.task_rows), total)
    sliced = df.withColumn("_slice", slice_of(place, cuts, n))

    def in_group_of(cut: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(cut[f"k{i}"]) for i, k in enumerate(keys)], F.lit(True))

    before_next = F.count_if(in_group_of(F.get(cuts, F.col("_slice"))))
    same = F.lit(True)
    if keys:
        here, after = F.get(cuts, F.col("_slice") - 1), F.get(cuts, F.col("_slice"))
        same = reduce(lambda a, b: a & b, [here[f"k{i}"].eqNullSafe(after[f"k{i}"]) for i in range(len(keys))])
    counted = sliced.groupBy("_slice").agg(before_next.alias("rows"), F.any_value(same).alias("same"))
    # A slice without rows begins in no group that is cut: the cuts are rows of the table.
    found = {r["_slice"]: r for r in counted.collect()}
    shift = [0]
    for s in range(n):
        row = found.get(s)
        shift.append(row["rows"] + (shift[s] if s and row["same"] else 0) if row else 0)
    shifts = F.from_json(F.lit(str(shift)), "array<bigint>")
    crossing = (F.col("_slice") > 0) & in_group_of(F.get(cuts, F.col("_slice") - 1))
    earlier = F.when(crossing, F.get(shifts, F.col("_slice"))).otherwise(F.lit(0))
    window = Window.partitionBy(*keys, "_slice").orderBy(*order)
    out = sliced.repartitionByRange(*keys, "_slice").withColumn(
        name, F.row_number().over(window).cast("bigint") + earlier
    )
    # Slices follow the order, so they may stand in it before its own terms.
    return (out.orderBy(*keys, "_slice", *order) if ordered else out).drop("_slice")


def ranked(
    df: DataFrame, by: str, ties: Sequence[str], name: str, cfg: Thresholds
) -> DataFrame:
    """Add ``name``, the rank of all rows by ``by`` descending (NULL last), in that order.

    ``df``, an aggregate, is computed once and stored. Equal values share a rank and are put in
    order by ``ties``. Up to ``cfg.task_rows`` rows are ranked by one task. More are cut into
    slices at literal values. A rank is then 1, plus the rows in earlier slices, plus the rows
    ahead in the slice. Rows that equal a cut are a slice of their own without any ranking in
    it: they are spread by ``ties``, however many they are. One exchange serves the window and
    the order.
    """
    stored = settled(df)
    total = stored.count()
    if total <= cfg.task_rows:
        window = Window.orderBy(F.desc(by))
        return stored.withColumn(name, F.rank().over(window)).orderBy(F.desc(by), *ties)
    value = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(down(F.col(by)))])
    cuts, n = cut_points(stored, value, -(-total // cfg.task_rows), total)
    # Slices of ties have odd numbers, the values between two cuts even ones.
    below = stored.withColumn("_below", slice_of(value, cuts, n))
    tied = F.coalesce(F.get(cuts, F.col("_below") - 1) == value, F.lit(False))
    placed = below.withColumn("_tied", tied).withColumn(
        "_slot", 2 * F.col("_below") - F.col("_tied").cast("int")
    )
    rows = {r["_slot"]: r["count"] for r in placed.groupBy("_slot").count().collect()}
    earlier = [0]
    for slot in range(2 * n):
        earlier.append(earlier[-1] + rows.get(slot, 0))
    offsets = F.from_json(F.lit(str(earlier)), "array<bigint>")

    spread = {f"_tie{i}": F.when(F.col("_tied"), F.col(t)) for i, t in enumerate(ties)}
    window = Window.partitionBy("_slot", *spread).orderBy(F.desc(by))
    within = F.when(F.col("_tied"), F.lit(1)).otherwise(F.rank().over(window))
    out = placed.withColumns(spread).repartitionByRange("_slot", *spread)
    out = out.withColumn(name, (within + F.get(offsets, F.col("_slot"))).cast("int"))
    out = out.orderBy("_slot", *spread, F.desc(by), *ties)
    return out.drop("_below", "_slot", "_tied", *spread)
