"""Registered queries: every operator over the given tables, with a SQL twin where one exists."""

from plantlake.plans import documents, events, timeseries

MODULES = [timeseries, events, documents]
ALL_QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ALL_ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
