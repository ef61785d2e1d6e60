"""All registered queries of the engine and their SQL counterparts."""

from ledgerline.plans import change_queries, document_queries, grid_queries, log_queries, payroll_queries, scalar_queries  # noqa: F401
from ledgerline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
