"""Every query of the deduplication engine, with the SQL that checks it."""

from __future__ import annotations

from .plans import catalog, folds, roundtrips, sequences  # noqa: F401  (the others add their queries)

QUERIES = catalog.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL
