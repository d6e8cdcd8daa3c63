"""Names of the engine's queries over the harness tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from scriptoria.harness import reading, rules, search, state, tables


def queries() -> dict:
    return search.QUERIES | tables.QUERIES | rules.QUERIES | state.QUERIES | reading.QUERIES


def oracle_sql() -> dict:
    return search.SQL | tables.SQL | rules.SQL | state.SQL | reading.SQL
