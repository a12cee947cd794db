"""Queries over personal information in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.pii import find_personal, redact
from spanloom.util import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct piece of personal information of each document."""
    return find_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon")).select("doc_id", "kind", "found").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with placeholders instead."""
    return redact(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {}
