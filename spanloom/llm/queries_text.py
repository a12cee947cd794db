"""Queries over the annotated texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.overlap import class_members, class_overlap, overlap_counts, pair_columns, split_overlap
from spanloom.llm.pieces import cut_places, oversized, placed_letters, split_oversized
from spanloom.llm.term_counts import judged_terms
from spanloom.plans.loading import VALUES
from spanloom.util import table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as pieces within the limits of chunk_limit."""
    return split_oversized(table(spark, sf_dir, "annotation"), table(spark, sf_dir, "chunk_limit"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts and sentences that are larger than their limit: those that the operator cuts. Their tokens aren't looked up."""
    return oversized(cut_places(placed_letters(table(spark, sf_dir, "annotation"), table(spark, sf_dir, "chunk_limit"))))


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its counts and verdict."""
    return judged_terms(table(spark, sf_dir, "annotation"), table(spark, sf_dir, "tag_set"), table(spark, sf_dir, "term_limit"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are too rare or too common."""
    return p5_terms(spark, sf_dir).where("verdict is not null").select("field", "term", "verdict")


def p5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of tokens, with their counts; SQL can say this part."""
    return p5_terms(spark, sf_dir).where("field = 'token'").select("term", "occurrences", "texts", "verdict")


def _overlap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return class_overlap(table(spark, sf_dir, "annotation"), table(spark, sf_dir, "split_assign"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a training and an evaluation sentence that are equal or almost."""
    return pair_columns(split_overlap(*_overlap(spark, sf_dir)))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their counts per split and source."""
    return overlap_counts(*_overlap(spark, sf_dir), table(spark, sf_dir, "text_meta"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence with its class and its number of links to the other side."""
    return class_members(*_overlap(spark, sf_dir))


POSITIONS = """
positions AS (
  SELECT text_id, sent_idx, token_idx, arg_max(token, (edited_at, anno_id)) AS token, min(lang) AS lang
  FROM annotation WHERE text_id IS NOT NULL AND sent_idx IS NOT NULL AND token_idx IS NOT NULL GROUP BY ALL)"""

QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p5_found": p5_found, "p5_terms": p5_terms, "p5_tokens": p5_tokens, "p6_found": p6_found, "p6_counts": p6_counts, "p6_classes": p6_classes}
TERMS = f"""
WITH {POSITIONS.strip()}, {VALUES.strip()},
uses AS (
  SELECT 'token' AS field, trim(lower(nfc_normalize(token)), ' ') AS term, text_id FROM positions WHERE token IS NOT NULL
  UNION ALL SELECT 'tag', tag, text_id FROM packed),
counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT text_id) AS texts FROM uses GROUP BY ALL),
judged AS (SELECT field, term, occurrences, texts,
  CASE WHEN texts < min_texts THEN 'rare' WHEN texts > max_text_share * (SELECT count(DISTINCT text_id) FROM annotation) THEN 'common' END AS verdict
  FROM counts JOIN term_limit USING (field))"""
#: CTEs that end with ``pairs`` of classes: candidates share enough words, counted with their repeats; the edit distance is one row of its table after another.
PAIRS = """
WITH positions AS (
  SELECT text_id, sent_idx, token_idx, arg_max(token, (edited_at, anno_id)) AS token
  FROM annotation WHERE text_id IS NOT NULL AND sent_idx IS NOT NULL AND token_idx IS NOT NULL GROUP BY ALL),
sides AS (SELECT text_id, lower(trim(arg_max(split, (assigned_at, split)))) AS split FROM split_assign WHERE text_id IS NOT NULL GROUP BY 1),
sents AS (SELECT text_id, sent_idx, split, list(trim(lower(strip_accents(token))) ORDER BY token_idx) AS w
  FROM positions JOIN sides USING (text_id) WHERE split IN ('train', 'dev', 'test') AND regexp_matches(token, '[\\p{L}\\p{N}]') GROUP BY ALL HAVING count(*) >= 10),
classes AS (SELECT w, row_number() OVER () AS c, len(w) AS n, bool_or(split = 'train') AS tr, bool_or(split <> 'train') AS ev FROM sents GROUP BY w),
units AS (SELECT c, n, tr, ev, u, row_number() OVER (PARTITION BY c, u) AS k FROM (SELECT c, n, tr, ev, unnest(w) AS u FROM classes)),
near AS (SELECT a.c AS t, b.c AS e FROM units a JOIN units b ON a.u = b.u AND a.k = b.k WHERE a.tr AND b.ev AND abs(a.n - b.n) <= 3 * greatest(a.n, b.n) // 20
  GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= greatest(a.n, b.n) - 3 * greatest(a.n, b.n) // 20),
lists AS (SELECT t, e, x.w AS a, y.w AS b, greatest(x.n, y.n) AS m FROM near JOIN classes x ON x.c = t JOIN classes y ON y.c = e),
steps AS (SELECT *, list_reduce(list_prepend(range(len(b) + 1)::VARCHAR[], list_transform(a, lambda x: [x])), lambda r, x: list_transform(range(len(b) + 1), lambda j: (j + list_min(list_transform(range(j + 1), lambda q: CASE WHEN q = 0 THEN r[1]::INT + 1 ELSE least(r[q + 1]::INT + 1, r[q]::INT + (b[q] <> x[1])::INT) END - q)))::VARCHAR)) AS last FROM lists),
pairs AS (SELECT t, e, CAST(list_last(last) AS INT) AS edits FROM steps WHERE CAST(list_last(last) AS INT) <= 3 * m // 20)"""
SQL = {
    "p1_found": """
WITH places AS (SELECT DISTINCT text_id, sent_idx, token_idx FROM annotation),
langs AS (SELECT text_id, min(lang) AS lang FROM annotation GROUP BY 1),
sizes AS (
  SELECT text_id, sent_idx, count(*) AS n FROM places GROUP BY ALL
  UNION ALL SELECT text_id, 0, count(*) FROM places GROUP BY ALL)
SELECT text_id, CAST(sent_idx AS INT) AS sent_idx FROM sizes JOIN langs USING (text_id) JOIN chunk_limit USING (lang) WHERE n > max_tokens""",
    "p5_found": f"{TERMS} SELECT field, term, verdict FROM judged WHERE verdict IS NOT NULL",
    "p5_terms": f"{TERMS} SELECT * FROM judged",
    "p5_tokens": f"{TERMS} SELECT term, occurrences, texts, verdict FROM judged WHERE field = 'token'",
    "p6_found": f"""{PAIRS}
SELECT least(x.text_id, y.text_id) AS text_id_a, CASE WHEN x.text_id < y.text_id THEN x.sent_idx ELSE y.sent_idx END AS sent_idx_a, greatest(x.text_id, y.text_id) AS text_id_b, CASE WHEN x.text_id < y.text_id THEN y.sent_idx ELSE x.sent_idx END AS sent_idx_b
FROM pairs JOIN classes c ON c.c = t JOIN classes d ON d.c = e JOIN sents x ON x.w = c.w AND x.split = 'train' JOIN sents y ON y.w = d.w AND y.split <> 'train'""",
    "p6_counts": f"""{PAIRS},
sources AS (SELECT text_id, arg_max(source, (catalogued_at, source)) AS source FROM text_meta WHERE text_id IS NOT NULL GROUP BY 1),
met AS (SELECT y.split, y.text_id, y.sent_idx, edits FROM pairs JOIN classes c ON c.c = t JOIN classes d ON d.c = e JOIN sents x ON x.w = c.w AND x.split = 'train' JOIN sents y ON y.w = d.w AND y.split <> 'train')
SELECT split, source, count(*) AS pairs, count(*) FILTER (edits = 0) AS exact_pairs, count(DISTINCT (text_id, sent_idx)) AS eval_sentences FROM met LEFT JOIN sources USING (text_id) GROUP BY 1, 2""",
    "p6_classes": f"""{PAIRS},
numbered AS (SELECT text_id, sent_idx, split, w, c FROM sents JOIN classes USING (w)),
sizes AS (SELECT c, min((text_id, sent_idx)) AS least, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split <> 'train') AS ev FROM numbered GROUP BY 1),
links AS (SELECT t AS c, true AS side, sum(ev) AS n FROM pairs JOIN sizes ON c = e GROUP BY t UNION ALL SELECT e, false, sum(tr) FROM pairs JOIN sizes ON c = t GROUP BY e)
SELECT text_id, sent_idx, split, least[1] || '/' || least[2] AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS links FROM numbered x JOIN sizes s ON s.c = x.c LEFT JOIN links l ON l.c = x.c AND l.side = (split = 'train')""",
}
