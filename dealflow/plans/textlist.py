"""Ordered text lists per group, one cell per group at any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.config import Thresholds
from dealflow.plans.rank import down, numbered

#: Bytes that a text can have in a JVM, less some room.
CELL_BYTES = 2_000_000_000


def _most_items(rows: DataFrame, keys: Sequence[str], separator: str, cell_bytes: int) -> int:
    """Items of the largest group; a list that no cell can hold is an error that names it."""
    length = F.octet_length("_item") + len(separator.encode())
    groups = rows.groupBy(*keys).agg(F.count("*").alias("items"), F.sum(length).alias("bytes"))
    key = F.to_json(F.struct(*keys))
    most, longest = groups.agg(F.max("items"), F.max(F.struct("bytes", key.alias("key")))).first()
    if longest is not None and longest["bytes"] is not None and longest["bytes"] > cell_bytes:
        raise ValueError(f"the list of {longest['key']} has {longest['bytes']} bytes, too many for a cell")
    return most or 0


def listed(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    name: str,
    item: Column,
    separator: str,
    cfg: Thresholds,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """Group by ``keys`` with ``measures`` and the joined ``item`` texts as ``name``.

    Items come by Deal_Size descending, then by text; duplicates stay, NULL items are
    skipped. There is one row per group, whatever the other groups are. Groups beyond
    ``cfg.task_rows`` items are put in order and joined in slices by several tasks; the
    slice texts are then joined in their order. One measuring job runs at once.
    """
    rows = df.withColumn("_item", item)
    aggregates = [m.alias(n) for n, m in measures.items()]
    if _most_items(rows, keys, separator, cell_bytes) <= cfg.task_rows:
        cell = F.expr(
            f"listagg(_item, '{separator}') WITHIN GROUP (ORDER BY Deal_Size DESC, _item)"
        )
        return rows.groupBy(*keys).agg(*aggregates, cell.alias(name))

    order = [*down(F.col("Deal_Size")), F.col("_item"), F.col("Opportunity_ID")]
    placed = numbered(
        rows.select(*keys, "Deal_Size", "_item", "Opportunity_ID"), keys, order, "_pos", cfg
    ).withColumn("_slice", F.floor((F.col("_pos") - 1) / cfg.task_rows))
    texts = placed.groupBy(*keys, "_slice").agg(
        F.expr(f"listagg(_item, '{separator}') WITHIN GROUP (ORDER BY _pos)").alias("_text")
    )
    cells = texts.groupBy(*keys).agg(
        F.expr(f"listagg(_text, '{separator}') WITHIN GROUP (ORDER BY _slice)").alias(name)
    )
    totals = rows.groupBy(*keys).agg(*aggregates)
    # Totals and cells meet without a join, so that NULL keys find each other.
    return (
        totals.unionByName(cells, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(*[F.first(n, ignorenulls=True).alias(n) for n in (*measures, name)])
    )
