"""Raw and typed deal tables from files, catalog tables and databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.schema import DEALS_SCHEMA, RAW_SCHEMA, conform


KEY = "Opportunity_ID"
#: Folder name of deals whose status is the empty text.
BLANK_STATUS = "__blank__"


def read_raw(
    spark: SparkSession, source: str, format: str = "parquet", **options: str
) -> DataFrame:
    """Raw deals from files of a Spark format, or from a catalog table (``format="table"``).

    The schema is given, never inferred. CSV files are expected with a header.
    """
    if format == "table":
        return conform(spark.read.options(**options).table(source), RAW_SCHEMA)
    if format == "csv":
        options = {"header": "true", **options}
    if format in ("csv", "json"):
        return spark.read.format(format).schema(RAW_SCHEMA).options(**options).load(source)
    return conform(spark.read.format(format).options(**options).load(source), RAW_SCHEMA)


def range_slices(column: str, bounds: Sequence[str]) -> list[str]:
    """WHERE conditions that cut a table into disjoint ranges of a key, for its index.

    Together they cover every row; a NULL key belongs to the first part.
    """
    marks = ["'" + b.replace("\\", "\\\\").replace("'", "''") + "'" for b in bounds]
    if not marks:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(marks, marks[1:])]
    return [f"({column} < {marks[0]} OR {column} IS NULL)", *inner, f"{column} >= {marks[-1]}"]


def read_raw_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    slices: int = 32,
    bounds: Sequence[str] | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Raw deals from a MySQL table, read in parallel; the driver jar must be on the class path.

    Each slice is a range of ``Opportunity_ID``, which an index on it serves. The ``bounds``
    between slices are given, or measured by one query that reads the key alone. Status
    filters and column selection of a report go down to the database.
    """
    if bounds is None:
        ranked = f"SELECT {KEY}, NTILE({slices}) OVER (ORDER BY {KEY}) AS part FROM {table}"
        starts = f"(SELECT part, MIN({KEY}) AS start FROM ({ranked}) r GROUP BY part) s"
        found = spark.read.jdbc(url, starts, properties=properties or {}).orderBy("part").collect()
        bounds = [r["start"] for r in found[1:] if r["start"] is not None]
    parts = range_slices(KEY, sorted(set(bounds)))
    return conform(
        spark.read.jdbc(url, table, predicates=parts, properties=properties or {}), RAW_SCHEMA
    )


def read_deals(spark: SparkSession, path: str) -> DataFrame:
    """Typed deals as ``write_deals`` stores them."""
    stored = spark.read.schema(DEALS_SCHEMA).parquet(path)
    status = F.when(F.col("Deal_Status") == BLANK_STATUS, "").otherwise(F.col("Deal_Status"))
    return stored.withColumn("Deal_Status", status).select(*DEALS_SCHEMA.names)
