"""Queries over tied texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.groups import assign_groups, text_groups
from spanloom.util import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts tied by author or work, with their group."""
    return text_groups(table(spark, sf_dir, "text_meta"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split and fold of every text under each configuration."""
    return assign_groups(table(spark, sf_dir, "text_meta"), table(spark, sf_dir, "fold_config"))


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits}
SQL = {
    "p4_found": """
WITH RECURSIVE ties AS (
  SELECT DISTINCT text_id, 'a' || lower(regexp_replace(author_id, '[\\s-]', '', 'g')) AS key FROM text_meta WHERE regexp_matches(author_id, '[1-9]')
  UNION SELECT DISTINCT text_id, 'w' || work_id FROM text_meta WHERE work_id IS NOT NULL),
links AS (SELECT DISTINCT a.text_id AS x, b.text_id AS y FROM ties a JOIN ties b USING (key)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
groups AS (SELECT x AS text_id, min(y) AS group_id, count(*) AS n FROM reach GROUP BY 1)
SELECT text_id, group_id FROM groups WHERE n > 1""",
}
