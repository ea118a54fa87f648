"""Every registered query and, where SQL can express it, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from millrace.plans import incidents, joining, learned, ranking, texts

MODULES = (texts, joining, ranking, incidents, learned)
FLAGSHIP = "incident_alerts"
QUERIES: dict[str, Callable] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
