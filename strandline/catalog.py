"""All registered shoreline queries."""

from __future__ import annotations

from strandline.plans import barriers, derived, edges, files, geometry, images, learning, lines, live, pixels, series, shore, spatial, stats, waves  # noqa: F401
from strandline.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
