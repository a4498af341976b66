"""Every registered usage query. Importing the modules registers their queries."""

from meterlake.plans import answer_queries, ledger_queries, mechanism_queries, metric_queries, report_queries  # noqa: F401
from meterlake.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
