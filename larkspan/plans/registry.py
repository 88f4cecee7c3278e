"""All queries of the library, and their SQL."""

from larkspan.plans import feature_oracles, feature_queries, model_oracles, model_queries, oracles, queries

QUERIES = queries.QUERIES | feature_queries.QUERIES | model_queries.QUERIES
SQL = oracles.SQL | feature_oracles.SQL | model_oracles.SQL
