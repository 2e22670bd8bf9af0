"""Typed deals and finished reports to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.plans.rank import slice_of
from dealflow.sources.readers import BLANK_STATUS


#: Dates that files are clustered by, and bits of each in the order.
CLUSTERED = ("Close_Date", "Created_Date", "Last_Activity_Date")
BITS = 8


def date_cuts(deals: DataFrame) -> dict[str, list[int]]:
    """Days that cut each clustered date into up to 2 ** BITS parts of about equal size."""
    shares = [(i + 1) / (1 << BITS) for i in range((1 << BITS) - 1)]
    days = [F.percentile_approx(F.unix_date(c), shares).alias(c) for c in CLUSTERED]
    found = deals.agg(*days).first()
    return {c: sorted(set(found[c] or [])) for c in CLUSTERED}


def interleaved(cuts: dict[str, list[int]]) -> Column:
    """One number from the bits of all dates' parts in turn, the leading ones first.

    Rows that are near in this order are near in every date, so a run of it spans a short time
    in each. A missing date is in the first part.
    """
    place = F.lit(0)
    for k, (column, days) in enumerate(cuts.items()):
        literal = F.array(*[F.lit(d) for d in days]).cast("array<int>")
        part = slice_of(F.unix_date(column), literal, len(days))
        for bit in range(BITS):
            to = len(cuts) * bit + len(cuts) - 1 - k
            place = place + F.shiftleft(F.shiftright(part, bit).bitwiseAND(F.lit(1)), to)
    return place


def write_deals(deals: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store typed deals as Parquet, one folder per status, clustered by dates across files.

    Most reports want one status only and then read its folder alone. Rows are spread by ranges
    of status and of the interleaved bits of closing, creation and activity dates, so a file
    holds a short span of time in each of the three, and a filter on any of them skips files: the
    more files there are, the larger a part of them. Open deals have no closing date, so the
    other two share their order. Ranges end in the id, so a day with most deals is cut as well.
    The days to cut at are measured first, from the three columns alone. A folder cannot be named
    after the empty text; that status has a name of its own on disk.
    """
    order = ["Deal_Status", "_place", "Opportunity_ID"]
    status = F.when(F.col("Deal_Status") == "", BLANK_STATUS).otherwise(F.col("Deal_Status"))
    (
        deals.withColumns({"Deal_Status": status, "_place": interleaved(date_cuts(deals))})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_place")
        .write.partitionBy("Deal_Status")
        .mode(mode)
        .parquet(path)
    )


def write_report(
    report: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", **options: str
) -> None:
    """Write a report; CSV gets a header. File names follow the order of the rows."""
    if format == "csv":
        options = {"header": "true", **options}
    report.write.format(format).mode(mode).options(**options).save(path)
