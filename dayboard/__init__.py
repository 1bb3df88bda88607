"""Dayboard: event-listing analytics on PySpark DataFrames."""
