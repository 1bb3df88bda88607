"""Registered queries: each module holds Spark queries and, under the same names, their SQL."""

from . import columns, days, extracts, landed, listings, quality, service, sets

MODULES = (days, sets, columns, extracts, quality, listings, landed, service)

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
