"""All queries outside the llm subpackage, with their SQL twins."""

from reviewloom.plans import analytics_queries, drift_queries, profile_queries, rule_queries, table_queries

_PARTS = (analytics_queries, rule_queries, table_queries, profile_queries, drift_queries)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}
