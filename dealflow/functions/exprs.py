"""Deal conditions, exact rates, size tiers and text lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealflow import labels as L
from dealflow.config import Thresholds
from dealflow.functions import dates

# --- conditions -----------------------------------------------------------


def is_open() -> Column:
    return F.col("Deal_Status") == L.OPEN


def is_won() -> Column:
    return F.col("Deal_Status") == L.WON


def is_lost() -> Column:
    return F.col("Deal_Status") == L.LOST


def is_closed() -> Column:
    return F.col("Deal_Status").isin(L.WON, L.LOST)


def is_stalled() -> Column:
    return F.col("Is_Stalled") == L.STALLED


def present(c: Column) -> Column:
    """Neither NULL nor the empty text."""
    return c.isNotNull() & (c != "")


# --- aggregates -----------------------------------------------------------


def sum_if(condition: Column, value: Column) -> Column:
    """Sum of ``value`` where the condition holds, other rows counting as 0."""
    return F.sum(F.when(condition, value).otherwise(0))


def size() -> Column:
    return F.col("Deal_Size")


def weighted_size() -> Column:
    """Sum of size times probability, in hundredths of the weighted value.

    The product is taken as bigint: two ints would overflow.
    """
    return F.sum(size().cast("bigint") * F.col("Win_Probability"))


# --- exact division -------------------------------------------------------


def divide(n: Column, d: Column, digits: int) -> Column:
    """``n / d`` of whole numbers, rounded half up; NULL when ``d`` is 0.

    Computed in decimals, so the result does not hang on binary fractions.
    """
    denominator = F.nullif(d.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.round(n / denominator, digits).cast("double")


def per(n: Column, d: Column, digits: int) -> Column:
    return divide(n.cast("decimal(20,0)"), d, digits)


def pct(n: Column, d: Column, digits: int = 1) -> Column:
    """Share of ``n`` in ``d`` in percent."""
    return divide(n.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)"), d, digits)


def average(c: Column) -> Column:
    """Mean of an integer column, to four decimals."""
    return mean(F.sum(c), F.count(c))


def mean(total: Column, count: Column) -> Column:
    """The same from a sum and a count."""
    return per(total, count, 4)


def quota_ratio(n: Column, quota: Column, digits: int = 2, factor: int = 1) -> Column:
    """``factor * n / quota`` for a DOUBLE quota, rounded half to even."""
    denominator = F.nullif(quota.cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
    scaled = n * F.lit(factor).cast("decimal(3,0)") if factor != 1 else n
    return F.bround(scaled / denominator, digits).cast("double")


def quota_sum(quota: Column) -> Column:
    """Sum of a DOUBLE quota as a decimal, which does not hang on the order of the rows."""
    return F.sum(quota.try_cast("decimal(28,10)"))


def quota_double(total: Column) -> Column:
    """Such a sum as DOUBLE, by way of a text: the cast may miss the nearest one."""
    return total.cast("string").cast("double")


def quota_total(quota: Column) -> Column:
    return quota_double(quota_sum(quota))


def whole(n: Column) -> Column:
    """A whole number as decimal, the form ``quota_ratio`` takes."""
    return n.cast("decimal(20,0)")


def hundredths(n: Column) -> Column:
    """``n / 100`` without rounding."""
    return (n.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(22,2)")


def win_rate(won: Column, lost: Column, digits: int = 1) -> Column:
    return pct(won, won + lost, digits)


# --- buckets --------------------------------------------------------------


def size_tier(cfg: Thresholds) -> Column:
    """Small, Mid, Large or Enterprise; a deal without a size counts as Enterprise."""
    small, mid, large = cfg.size_cuts
    return (
        F.when(size() < small, L.SMALL)
        .when(size() < mid, L.MID)
        .when(size() < large, L.LARGE)
        .otherwise(L.ENTERPRISE)
    )


def cycle_bucket(cfg: Thresholds) -> Column:
    """Numbered label such as ``02. 16-30 days``; NULL and negative cycles are in the last."""
    days = F.col("Sales_Cycle_Days")
    last = f"{len(cfg.cycle_cuts) + 1:02d}. {cfg.cycle_cuts[-1]}+ days"
    label = F.lit(last)
    lows = [0] + [c + 1 for c in cfg.cycle_cuts[:-1]]
    for i in reversed(range(len(lows))):
        low, high = lows[i], cfg.cycle_cuts[i]
        label = F.when(days.between(low, high), f"{i + 1:02d}. {low}-{high} days").otherwise(label)
    return label


def closes_near(as_of: dt.date | None, cfg: Thresholds) -> Column:
    return dates.days_to_close(as_of).between(0, cfg.near_days)


def closes_mid(as_of: dt.date | None, cfg: Thresholds) -> Column:
    return dates.days_to_close(as_of).between(cfg.near_days + 1, cfg.mid_days)


def closes_late(as_of: dt.date | None, cfg: Thresholds) -> Column:
    return dates.days_to_close(as_of) > cfg.mid_days


# --- texts ----------------------------------------------------------------


def label_order(c: Column, listed: Sequence[str]) -> Column:
    """Position of a label in a list, from 1; 0 when it is not listed."""
    position = F.array_position(F.array(*[F.lit(x) for x in listed]), c)
    return F.coalesce(position, F.lit(0).cast("bigint"))


def by_label(c: Column, values: Mapping[str, object], otherwise: object = None) -> Column:
    """The value that a small fixed table has for a label."""
    chosen = F.lit(otherwise)
    for label, value in reversed(values.items()):
        chosen = F.when(c == label, value).otherwise(chosen)
    return chosen
