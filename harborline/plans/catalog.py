"""All registered queries."""

from harborline.plans import data_queries, job_queries, seller_queries, stock_queries  # noqa: F401
from harborline.plans import job_results, views  # noqa: F401  (these take the SQL of queries above)
from harborline.plans.registry import QUERIES

__all__ = ["QUERIES"]
