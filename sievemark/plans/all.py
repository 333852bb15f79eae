"""All registered queries of the library's own operators."""

from . import advice_queries, analytics_queries, claim_queries, crash_queries, detector_queries, family_queries, feature_queries, http_queries, reference_queries, relational_queries, rubric_queries, rule_queries, style_queries, text_queries, triage_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
