"""Registered queries by name and the SQL that gives the same rows."""

from acervo.plans import catalogue_queries, engine_queries, profile_queries, rule_queries, stock_queries, text_queries

_MODULES = (stock_queries, rule_queries, profile_queries, text_queries, catalogue_queries, engine_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
