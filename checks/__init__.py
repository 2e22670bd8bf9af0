"""Deals made from the given order tables, and the SQL that the reports are checked with."""
