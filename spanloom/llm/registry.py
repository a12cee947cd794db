"""All queries of this subpackage, and their SQL."""

from __future__ import annotations

from spanloom.llm import queries_groups, queries_pii, queries_text, queries_tokens

MODULES = (queries_text, queries_groups, queries_tokens, queries_pii)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
