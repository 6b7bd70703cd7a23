"""Queries over the driver tables, each with its SQL oracle."""

from shoebox.plans import canonical_queries, local_queries, merge_queries, queue_queries, rendition_queries, scalar_queries, search_queries, source_queries, status_queries, timeline_queries, upload_queries  # noqa: F401
from shoebox.plans.registry import ORACLE, QUERIES  # noqa: F401
