"""All queries of the library proper and their DuckDB counterparts."""

from __future__ import annotations

from tallyforge.plans import evidence, jobs, ledger, logs, more, statistics

_MODULES = (statistics, ledger, logs, more, jobs, evidence)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
FLAGSHIP = "rate_by_condition"
