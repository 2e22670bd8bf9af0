"""From the raw deal table (dates as text) to the typed one that reports take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow import labels as L
from dealflow.functions.dates import ISO_FORMAT, parse_date
from dealflow.functions.exprs import by_label
from dealflow.schema import DATE_COLUMNS, RAW_SCHEMA, conform, raw_name

# Columns whose values reports compare with fixed labels.
VOCABULARY = {
    "Stage": L.STAGES,
    "Deal_Status": (L.OPEN, L.WON, L.LOST),
    "Is_Stalled": (L.STALLED, L.NOT_STALLED),
    "Account_Tier": (L.ENTERPRISE, L.MID_MARKET, L.SMB),
    "Forecast_Category": (L.COMMIT, L.BEST_CASE, L.UPSIDE, L.PIPELINE, L.OMIT),
}


def _normalised(name: str) -> Column:
    """Trimmed text, with known labels in their usual case."""
    text = F.trim(F.col(name))
    if name not in VOCABULARY:
        return text
    known = {label.lower(): label for label in VOCABULARY[name]}
    return F.coalesce(by_label(F.lower(text), known), text)


def ingest(raw: DataFrame, date_format: str = ISO_FORMAT, normalize: bool = False) -> DataFrame:
    """Typed deals: the four dates as DATE, their texts kept as ``<column>_raw``.

    A text that does not start with a valid date gives NULL. Texts are compared as they
    are; with ``normalize`` they are trimmed and known labels brought into their usual case.
    """
    deals = conform(raw, RAW_SCHEMA)
    if normalize:
        texts = [f.name for f in RAW_SCHEMA if isinstance(f.dataType, T.StringType)]
        deals = deals.withColumns({c: _normalised(c) for c in texts})
    return deals.select(
        *[
            parse_date(F.col(f.name), date_format).alias(f.name)
            if f.name in DATE_COLUMNS
            else f.name
            for f in RAW_SCHEMA
        ],
        *[F.col(c).alias(raw_name(c)) for c in DATE_COLUMNS],
    )
