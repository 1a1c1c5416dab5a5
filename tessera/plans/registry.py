"""Registered queries and the SQL that gives the same rows."""

from . import comparison, coverage, evidence, gating, names, ruling

MODULES = (names, evidence, comparison, gating, coverage, ruling)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
