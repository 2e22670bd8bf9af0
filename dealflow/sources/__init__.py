"""Reading deal tables and writing reports."""

from dealflow.sources.ingest import ingest
from dealflow.sources.readers import read_deals, read_raw, read_raw_jdbc
from dealflow.sources.writers import write_deals, write_report

__all__ = [
    "ingest",
    "read_deals",
    "read_raw",
    "read_raw_jdbc",
    "write_deals",
    "write_report",
]
