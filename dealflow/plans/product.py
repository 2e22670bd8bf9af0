"""All pairs of two tables with an equal key, in the order of one of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.config import Thresholds
from dealflow.plans.rank import cut_points, slice_of

#: Pairs per copied row of the right table, at least.
PAIRS_PER_COPY = 8


def count_pairs(left: DataFrame, right: DataFrame, key: str) -> int:
    """Pairs with an equal key: exact, from the rows per key on both sides."""
    counts = left.groupBy(key).agg(F.count("*").alias("l")).join(
        right.groupBy(key).agg(F.count("*").alias("r")), key
    )
    product = F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    return int(counts.agg(F.sum(product.cast("decimal(38,0)"))).first()[0] or 0)


def pair_partitions(pairs: int, df: DataFrame, cfg: Thresholds) -> int:
    """Partitions for so many pairs: the usual number, or more for many pairs."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-pairs // cfg.task_rows))


def paired_in_order(
    left: DataFrame, right: DataFrame, key: str, order: Sequence[str], pairs: int, cfg: Thresholds
) -> DataFrame:
    """Inner join by ``key`` in partitions that are consecutive ranges of ``order`` of ``left``.

    For a ``right`` that is too large for a broadcast and a result that must come in order. The
    pairs are many and wide, so they are never shuffled: ``left`` is cut into slices at literal
    rows, partition i gets slice i, and every slice gets a copy of ``right``. Pairs are made in
    their partition; ``sortWithinPartitions`` then puts the whole result in order. Slices are so
    large that there are PAIRS_PER_COPY pairs for each copied row. A hot key is spread over the
    slices like the rows of ``left``.
    """
    # Rows without a key have no pairs, so they do not count for the cuts.
    left = left.where(F.col(key).isNotNull())
    rows = right.count()
    slices = max(1, pairs // max(cfg.task_rows, PAIRS_PER_COPY * rows))
    place = F.struct(*order)
    cuts, n = cut_points(left, place, slices, left.count())
    if n == 0:
        return left.coalesce(1).join(right.coalesce(1).hint("merge"), key)
    by_slice = left.withColumn("_slice", slice_of(place, cuts, n))
    copies = right.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(n))))
    by_slice, copies = (t.repartitionById(n + 1, F.col("_slice")) for t in (by_slice, copies))
    return by_slice.join(copies.hint("merge"), ["_slice", key]).drop("_slice")
