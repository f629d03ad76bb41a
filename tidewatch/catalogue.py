"""Every registered query and the SQL that states its result."""

from __future__ import annotations

from tidewatch.queries import QUERIES, SQL
from tidewatch.queries import lasting, ordered, stored, summaries, upkeep  # noqa: F401  they register their queries

__all__ = ["QUERIES", "SQL"]
