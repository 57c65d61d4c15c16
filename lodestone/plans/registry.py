"""All registered queries and their SQL, by name."""

from __future__ import annotations

from . import editorial, files, gates, publishing, quality, retrieval

_ALL = retrieval.QUERIES | quality.QUERIES | publishing.QUERIES | editorial.QUERIES | gates.QUERIES | files.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
