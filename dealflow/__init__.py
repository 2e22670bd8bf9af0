"""Sales-pipeline analytics on Spark DataFrames.

Read a deal table with ``dealflow.sources``, then call any report of
``dealflow.operators`` on it, or look one up by name in ``dealflow.reports``.
"""

from dealflow.config import DEFAULTS, Thresholds

__all__ = ["DEFAULTS", "Thresholds"]
