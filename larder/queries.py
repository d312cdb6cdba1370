"""All queries of the core, and their SQL."""

from __future__ import annotations

from larder.plans import lexical_queries, match_queries, report_queries, text_queries  # noqa: F401 isort: skip
from larder.plans import extra_queries  # noqa: F401
from larder.plans.registry import ORACLES, QUERIES  # noqa: F401
