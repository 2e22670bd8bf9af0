"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow.llm.common import columns, stored

#: Words: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """Sources in order weigh ``weights``, repeating, and share ``share`` of all words; no
    source gives more than ``most`` times its words. About ``slice_rows`` rows, or fewer where
    there are more partitions than such slices, are summed in a task."""

    weights: Sequence[int] = (3, 1, 2)
    share: tuple[int, int] = (3, 2)
    most: int = 2
    seed: int = 7
    slice_rows: int = 100_000


def words(text: Column) -> Column:
    """Number of words of a text, 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1 that depends on ``key`` only."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0**52)


def targets(sizes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Targets of the sources in ``sizes`` (no_source, source, source_size).

    Sources are capped in order of size per weight. The first that stays below its cap, and all
    after it, share by weight what the capped ones leave, which is what resharing ends in. All
    comparisons are between integers. One row per source passes through one window.
    """
    up, down = settings.share
    most, n = settings.most, len(settings.weights)
    place = F.row_number().over(Window.orderBy("no_source", "source")) - 1
    listed = F.array(*[F.lit(int(w)) for w in settings.weights])
    weighed = sizes.withColumn("w", F.element_at(listed, (place % n + 1).cast("int")).cast("bigint"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "no_source", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # Budget left for this and later sources, times `down`; their weights; the cap.
    left = F.sum("source_size").over(whole) * up - F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    ) * (most * down)
    filled = weighed.select("*", left.alias("left"), F.sum("w").over(after).alias("later")).withColumn(
        "open", F.col("source_size") * (most * down) * F.col("later") > F.col("left") * F.col("w")
    )
    first = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("w"), "no_source",
                  "source", "left", "later"))).over(whole)
    level = filled.withColumn("first", first)
    capped = ~F.col("open") | F.col("first").isNull()
    share = (F.col("w") * F.col("first.left")).cast("double") / (F.col("first.later") * down)
    return level.select(
        "no_source",
        "source",
        "source_size",
        F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"),
    )


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    settings: Settings = Settings(),
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, picked, taken: one row per input row.

    ``quality`` (doc_id, weight) gives weights above 0; documents without one weigh 1. Each
    document draws an exponential key with its weight as rate. A source is taken whole as often
    as its target allows; the rest goes to documents by ascending key, up to the one that
    crosses it, which is taken if at least half of it fits. Rows are cut into slices of the key,
    so that a source of any size is summed by many tasks; only slice totals are summed per
    source. Null texts have size 0, null sources are a source of their own, rows with equal or
    null doc_id are drawn with equal keys and ordered by size. No rows in, no rows out.
    """
    rows = columns(docs, doc_id=doc_id, source=source, text=text).select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        words(F.col("text")).alias("size"),
    )
    if quality is not None:
        best = quality.groupBy("doc_id").agg(F.max("weight").alias("weight"))
        rows = rows.join(best, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    key = -F.log(uniform(F.col("doc_id"), settings.seed)) / F.coalesce("weight", F.lit(1.0))
    drawn = stored(rows.withColumn("key", key).drop("weight"), "drawn")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(partitions, drawn.count() // settings.slice_rows)
    drawn = drawn.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * slices))

    of = ["no_source", "source"]
    sums = stored(drawn.groupBy(*of, "slice").agg(F.sum("size").alias("words")), "sums")
    aims = targets(sums.groupBy(*of).agg(F.sum("words").alias("source_size")), settings)
    earlier = Window.partitionBy(*of).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *of, "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    ).join(aims, of)
    within = (
        Window.partitionBy(*of, "slice")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    size, whole = F.col("size"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(F.col("target") / whole)).otherwise(0).cast("bigint")
    rest = F.col("target") - F.col("epochs") * whole
    return (
        drawn.join(offsets, [*of, "slice"])
        .withColumn("until", F.col("offset") + F.sum("size").over(within))
        .withColumn("epochs", epochs)
        .withColumn("picked", (F.col("until") * 2 - size <= rest * 2) & (rest > 0))
        .select(
            "doc_id",
            F.when(~F.col("no_source"), F.col("source")).alias("source"),
            "size",
            "source_size",
            "target",
            "epochs",
            "picked",
            (size * (F.col("epochs") + F.col("picked").cast("bigint"))).alias("taken"),
        )
    )
