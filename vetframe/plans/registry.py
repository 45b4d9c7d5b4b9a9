"""All registered queries, and the SQL they are checked against."""

from . import check_queries, group_queries, model_queries, profile_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for module in (group_queries, profile_queries, text_queries, model_queries, check_queries):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
