"""Aggregates that carry lists of distinct texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow.config import Thresholds


def _cells(
    reduced: DataFrame,
    keys: Sequence[str],
    totals: Sequence[str],
    name: str,
    separator: str,
    as_arrays: bool,
    cfg: Thresholds,
) -> DataFrame:
    """One row per group: sums of ``totals`` and the sorted, joined values of ``name``.

    The values of a group are put in order by a sort that spills, and measured as they pass: a
    list that outgrows ``cfg.cell_bytes`` is an error that names its group, raised before any of
    it is joined. They are joined in slices of ``cfg.list_slice_bytes``, and the texts of the
    slices then. One shuffle serves all of that. NULL is no value.
    """
    length = F.coalesce(F.octet_length(name) + len(separator.encode()), F.lit(0)).cast("bigint")
    until = F.sum(length).over(Window.partitionBy(*keys).orderBy(name))
    message = F.concat(
        F.lit(f"the list {name} of "),
        F.to_json(F.struct(*keys)),
        F.lit(f" has more than {cfg.cell_bytes} bytes, too many for a cell"),
    )
    too_long = F.raise_error(message).cast("bigint")
    sized = reduced.withColumn("_until", until).withColumn(
        "_slice",
        F.when(F.col("_until") > cfg.cell_bytes, too_long).otherwise(
            F.floor((F.col("_until") - length) / cfg.list_slice_bytes)
        ),
    )
    sums = [F.sum(t).alias(t) for t in totals]
    if as_arrays:
        values = F.collect_set(F.when(F.col("_slice").isNotNull(), F.col(name)))
        return sized.groupBy(*keys).agg(*sums, F.array_sort(values).alias(name))
    joined = "listagg({}, '%s') WITHIN GROUP (ORDER BY {})" % separator
    slices = sized.groupBy(*keys, "_slice").agg(
        *sums, F.expr(joined.format(f"`{name}`", f"`{name}`")).alias("_text")
    )
    return slices.groupBy(*keys).agg(*sums, F.expr(joined.format("_text", "_slice")).alias(name))


def with_lists(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    lists: Mapping[str, tuple[Column, str]],
    cfg: Thresholds,
    as_arrays: bool = False,
) -> DataFrame:
    """Group by ``keys`` with additive ``measures`` and distinct sorted ``lists``.

    ``measures`` must be sums or counts. ``lists`` gives per output column the value
    and the separator. The deals are first reduced to one row per key and list value
    by a plain hash aggregate, which runs before the shuffle and never falls back to
    sorting; only those few rows make the lists. The first list carries the measures along;
    each further one is reduced by itself, so that no aggregate holds combinations of two
    lists. Every list is measured; one with more than ``cfg.cell_bytes`` is an error that
    names its group. With ``as_arrays`` the lists stay arrays.
    """
    (first, (value, separator)), *others = lists.items()
    reduced = df.groupBy(*keys, value.alias(first)).agg(
        *[m.alias(n) for n, m in measures.items()]
    )
    out = _cells(reduced, keys, [*measures], first, separator, as_arrays, cfg)
    if not others:
        return out
    for name, (value, separator) in others:
        distinct = df.select(*keys, value.alias(name)).where(F.col(name).isNotNull()).distinct()
        texts = _cells(distinct, keys, [], name, separator, as_arrays, cfg)
        out = out.unionByName(texts, allowMissingColumns=True)
    # Parts of a group meet without a join, so that NULL keys find each other.
    names = [*measures, *lists]
    return out.groupBy(*keys).agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
