"""All queries of the engine by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from tallyworks.plans import cases, decisions, ledger, linking, picks, streams, texts

MODULES = (ledger, decisions, texts, linking, streams, cases, picks)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
