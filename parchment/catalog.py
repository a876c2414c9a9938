"""Every registered query with its SQL."""

from __future__ import annotations

from parchment.queries.reference import QUERIES, SQL

FLAGSHIP = "knn_topk"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
