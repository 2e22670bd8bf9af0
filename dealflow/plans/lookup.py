"""Join of the deals with a small derived table, whatever the keys look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.config import Thresholds
from dealflow.plans.checkpoint import settled
from dealflow.plans.rank import largest_group


def fits_broadcast(stored: DataFrame, cfg: Thresholds) -> bool:
    """Whether a stored table is within the broadcast limits, by rows and by text size."""
    chars = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    rows, length = stored.agg(F.count("*"), chars).first()
    return rows <= cfg.broadcast_rows and length <= cfg.broadcast_chars


def join_lookup(
    deals: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Column,
    cfg: Thresholds,
    how: str = "inner",
    order: Sequence[str] = (),
) -> DataFrame:
    """Equi-join ``deals`` (``how`` is inner or left) with ``lookup``.

    The keys (a stage, a region) have few values, so a shuffle of the deals by them
    would put a large part of all deals into one task. The lookup is an aggregate: it
    is stored, measured, and broadcast while small, which leaves the deals where they
    are. A larger one is repeated once per salt and merged by key and salt, the salt of
    a deal coming from ``spread_by``; every deal still meets each of its partners once.
    There are as many salts as it takes to keep the largest key below ``cfg.task_rows``.

    ``order`` names the order of the result: before a broadcast the deals are put into it,
    which makes the final sort a local one. Before a merge, whose shuffle would undo it, they
    are not. The measuring jobs run at once.
    """
    stored = settled(lookup)
    if fits_broadcast(stored, cfg):
        if order:
            deals = deals.repartitionByRange(*order)
        return deals.join(F.broadcast(stored), list(on), how)
    salts = -(-largest_group(deals, on) // cfg.task_rows) or 1
    salted = deals.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
