"""All queries over the library's own operators."""

from quire.plans import corpus_queries, document_queries, job_queries, layout_queries, metric_queries, report_queries, review_queries, source_queries  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
