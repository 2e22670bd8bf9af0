"""The reports: functions from a typed deal table to a result DataFrame.

Every report is called as ``report(deals, as_of=None, cfg=DEFAULTS)``. ``as_of`` is the
report day (default: the current date) and only matters where a report looks at dates.
Rows come in the order that the report defines, with its key columns as last criterion.
"""
