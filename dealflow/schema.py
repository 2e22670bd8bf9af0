"""The deal table: 28 nullable columns, dates as text in the raw layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the raw deal table.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("Opportunity_ID", T.StringType()),
        T.StructField("Opportunity_Name", T.StringType()),
        T.StructField("Sales_Rep", T.StringType()),
        T.StructField("Region", T.StringType()),
        T.StructField("Product_Line", T.StringType()),
        T.StructField("Industry", T.StringType()),
        T.StructField("Stage", T.StringType()),
        T.StructField("Deal_Size", T.IntegerType()),
        T.StructField("Win_Probability", T.IntegerType()),
        T.StructField("Created_Date", T.StringType()),
        T.StructField("Last_Activity_Date", T.StringType()),
        T.StructField("Expected_Close_Date", T.StringType()),
        T.StructField("Close_Date", T.StringType()),
        T.StructField("Days_in_Stage", T.IntegerType()),
        T.StructField("Account_Name", T.StringType()),
        T.StructField("Account_Tier", T.StringType()),
        T.StructField("Lead_Source", T.StringType()),
        T.StructField("Forecast_Category", T.StringType()),
        T.StructField("Deal_Type", T.StringType()),
        T.StructField("Quota_Contribution", T.DoubleType()),
        T.StructField("Reason_Lost", T.StringType()),
        T.StructField("Competitor_Name", T.StringType()),
        T.StructField("Campaign_Name", T.StringType()),
        T.StructField("Currency", T.StringType()),
        T.StructField("Is_Stalled", T.StringType()),
        T.StructField("Deal_Status", T.StringType()),
        T.StructField("Rep_Tenure_Months", T.IntegerType()),
        T.StructField("Sales_Cycle_Days", T.IntegerType()),
    ]
)

DATE_COLUMNS = ("Created_Date", "Last_Activity_Date", "Expected_Close_Date", "Close_Date")


def raw_name(column: str) -> str:
    """Name under which the typed table keeps the text of a date column."""
    return f"{column}_raw"


DEALS_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.DateType() if f.name in DATE_COLUMNS else f.dataType)
        for f in RAW_SCHEMA
    ]
    + [T.StructField(raw_name(c), T.StringType()) for c in DATE_COLUMNS]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` from ``df``, cast where the type differs.

    A missing column is an error; further columns are dropped.
    """
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema if f.name not in have]
    if missing:
        raise ValueError(f"deal table lacks columns: {', '.join(missing)}")
    return df.select(
        *[
            f.name if have[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
