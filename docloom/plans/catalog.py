"""All queries of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from docloom.plans import assembled, audited, composed, folders, models, stored, streams  # noqa: F401  (register their queries)
from docloom.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "hybrid_rrf"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
