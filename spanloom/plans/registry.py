"""All queries of the core, and their SQL."""

from __future__ import annotations

from spanloom.plans import files, folds, loading, scores, spans, subwords, words

MODULES = (loading, spans, scores, folds, words, subwords, files)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
