"""Queries that load dirty fields and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.packed_values import split_packed
from spanloom.sources.raw_lines import parse_lines, readable, unreadable
from spanloom.util import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of raw_line that can't be loaded, with the reason."""
    return unreadable(parse_lines(table(spark, sf_dir, "raw_line"))).distinct()


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of raw_line that can."""
    return readable(parse_lines(table(spark, sf_dir, "raw_line")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of the annotation rows whose labels hold more than one."""
    return split_packed(table(spark, sf_dir, "annotation"), "anno_id", "labels", table(spark, sf_dir, "tag_set"), least=2)


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of all annotation rows."""
    return split_packed(table(spark, sf_dir, "annotation"), "anno_id", "labels", table(spark, sf_dir, "tag_set"))


#: Regular expressions of a column that quoting allows, and of a quoted piece of a field; in SQL literals a quote is doubled.
_FIELD = '(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|)'
_QUOTED = """"(?:[^"]|"")*"|''(?:[^'']|'''')*''"""
_BRACKET = r"\[[^\]]*\]"


def _plain(c: str) -> str:
    return f"""CASE WHEN starts_with({c}, '"') THEN replace(substr({c}, 2, length({c}) - 2), '""', '"') ELSE {c} END"""


def _at(c: str, i: int) -> str:
    return f"try_cast('0' || ltrim(split_part({c}, '-', {i}), '0') AS BIGINT)"


def _pair(c: str, least: int) -> str:
    sized = " AND ".join(f"length(ltrim(split_part({c}, '-', {i}), '0')) <= 10 AND {_at(c, i)} BETWEEN {least} AND 2147483647" for i in (1, 2))
    return f"(regexp_full_match({c}, '[0-9]+-[0-9]+') AND {sized})"


_FIVE = "\\t".join([f"({_FIELD})"] * 5)
_RECORDS = f"""WITH records AS (SELECT line_id, line FROM raw_line WHERE NOT starts_with(line, '#') AND regexp_matches(line, '[^\\s]')),
cut AS (SELECT line_id, regexp_full_match(line, '(?:{_FIELD}\\t)*{_FIELD}') AS quoted, regexp_full_match(line, '{_FIVE}') AS five, regexp_extract(line, '^{_FIVE}$', ['a', 'b', 'c', 'd', 'e']) AS p FROM records),
plain AS (SELECT line_id, quoted, five, {", ".join(f"{_plain('p.' + x)} AS {x}" for x in "abcde")} FROM cut),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT five THEN 'columns' WHEN NOT {_pair("a", 1)} THEN 'sent_token' WHEN NOT {_pair("b", 0)} THEN 'char_range'
  WHEN {_at("b", 1)} >= {_at("b", 2)} OR {_at("b", 2)} - {_at("b", 1)} <> length(c) THEN 'char_range' END AS reason FROM plain)"""
_BARE = r"""(?:\\.|[^|;,/&+¦\s\[\]"''\\])+"""
#: CTEs that end with ``packed``: the values of all labels. Pieces are a tag, quoted or not, with its bracket.
VALUES = f"""
pieces AS (SELECT anno_id, text_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT anno_id, text_id, regexp_extract_all(labels, '(?:{_QUOTED}|{_BARE})\\s*(?:{_BRACKET})?') AS l FROM annotation WHERE labels <> '_')),
parts AS (SELECT *, trim(regexp_replace(piece, '{_BRACKET}', ''), ' ' || chr(9)) AS raw, regexp_extract_all(regexp_extract(piece, '{_BRACKET}'), '[0-9]+') AS ns FROM pieces),
bare AS (SELECT *, replace(CASE WHEN raw[1] IN ('"', '''') THEN trim(replace(raw[2:-2], raw[1] || raw[1], raw[1])) ELSE raw END, '\\', '') AS tag FROM parts),
vals AS (SELECT anno_id, text_id, i, generate_subscripts(ms, 1) AS j, unnest(ms) AS n, tag FROM (SELECT *, CASE WHEN len(ns) = 0 THEN ['0'] ELSE ns END AS ms FROM bare WHERE tag NOT IN ('', '_'))),
packed AS (SELECT anno_id, v.text_id, CAST(row_number() OVER (PARTITION BY anno_id ORDER BY i, j) AS INT) AS pos, count(*) OVER (PARTITION BY anno_id) AS many, coalesce(t.tag, v.tag) AS tag, CAST(n AS INT) AS disambiguation_id FROM vals v LEFT JOIN tag_set t ON lower(t.tag) = lower(v.tag))"""
QUERIES = {"p2_found": p2_found, "p2_rows": p2_rows, "p3_found": p3_found, "p3_values": p3_values}
SQL = {
    "p2_found": f"{_RECORDS} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_rows": f"{_RECORDS} SELECT line_id, {', '.join(f'CAST({_at(c, i)} AS INT) AS {n}' for c, i, n in (('a', 1, 'sent_idx'), ('a', 2, 'token_idx'), ('b', 1, 'char_start'), ('b', 2, 'char_end')))}, c AS token, d AS labels, e AS rest FROM judged WHERE reason IS NULL",
    "p3_found": f"WITH {VALUES.strip()} SELECT anno_id, pos, tag, disambiguation_id FROM packed WHERE many > 1",
    "p3_values": f"WITH {VALUES.strip()} SELECT anno_id, pos, tag, disambiguation_id FROM packed",
}
