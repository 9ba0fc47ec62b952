"""Query registry; importing the query modules fills it."""

from labeltrail.plans import trace_queries, metric_queries, selection_queries, resample_queries  # noqa: F401
from labeltrail.plans import sampling_queries, ranking_queries, check_queries, expression_queries, join_queries, learning_queries, source_queries  # noqa: F401
from labeltrail.plans.registry import BUILDERS, ORACLES
from labeltrail.plans.tables import Tables

__all__ = ["BUILDERS", "ORACLES", "Tables"]
