"""Queries that read labels as spans and hold them against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import match, spans
from spanloom.operators.labels import parse_labels, tag_inventory, vocabulary
from spanloom.plans.adapters import SEQUENCES, labelled, side_spans, sequences, spans_of, spans_sql, with_
from spanloom.util import table

SPAN = '"start", "end", text, label'


def iob2_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("text_id", "sent_idx", "token_idx", "gold_bio", "a_bio", "b_bio")


def token_spans_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(spark, sf_dir, "gold")


def token_spans_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(spark, sf_dir, "a")


def token_spans_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(spark, sf_dir, "gold", "faithful")


def span_f1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.begin_spans(labelled(spark, sf_dir), "a_bio")


def span_f1_spans_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.begin_spans(labelled(spark, sf_dir), "a_bio", "faithful")


def inclusive_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.inclusive_spans(labelled(spark, sf_dir), "a_bio", ("R",))


def span_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = spans_of(spark, sf_dir).select(spans.span_key().alias("key"))
    return keyed.select("key", spans.parse_span(F.col("key")).alias("s")).select("key", "s.text_id", "s.start", "s.text")


def chained_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.chained_spans(spans_of(spark, sf_dir), "R").withColumn("labels", F.array_join("labels", ","))


#: Numbers of an absent side are -1 in these two results.
ABSENT = [f"{side}_{c}" for side in ("test", "pred") for c in ("sent_idx", "start", "end")]


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.overlap_join(*side_spans(spark, sf_dir, "gold", "a"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).na.fill(-1, ABSENT)


def overlap_pairs_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.overlap_join(*side_spans(spark, sf_dir, "gold", "a"), "faithful").na.fill(-1, ABSENT)


def matching_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.matching(*side_spans(spark, sf_dir, "gold", "a"))[0]


def gold_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.matching(*side_spans(spark, sf_dir, "gold", "a"))[1]


def pred_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.matching(*side_spans(spark, sf_dir, "gold", "a"))[2]


def partial_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, pred = match.matching(*side_spans(spark, sf_dir, "gold", "a"))
    shown = F.array_join(F.transform("gold", lambda g: F.concat(g["test_start"].cast("string"), F.lit(":"), g["test_end"].cast("string"), F.lit(":"), g["test_label"])), " ")
    return match.partial_lists(pred, gold).select(*(f"pred_{c}" for c in match.FIELDS), shown.alias("gold"))


def match_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).select(match.either("label"), "match_type").groupBy("label", "match_type").agg(F.count(F.lit(1)).alias("n"))


KINDS = ["exact", "late", "early", "missed", "wrong"]


def boundary_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _overlap(spark, sf_dir).select(match.either("label"), "overlap_start", "overlap_end")
    return rows.groupBy("label", "overlap_start").pivot("overlap_end", KINDS).agg(F.count(F.lit(1))).na.fill(0, KINDS)


def boundary_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = sum((F.col(k) for k in KINDS), F.lit(0))
    return boundary_errors(spark, sf_dir).select("label", "overlap_start", *(F.round(F.try_divide(F.col(k), whole), 10).alias(k) for k in KINDS))


def label_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "@@unkORpad@@").withColumn("id", F.col("id").cast("int"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_suppkey") % 7 == 0, "_").otherwise(F.concat(F.col("l_linestatus"), F.lit("["), (F.col("l_suppkey") % 9).cast("string"), F.lit("]|"), F.col("l_returnflag")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("labels"))


def priority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _packed(spark, sf_dir).withColumn("p", parse_labels(F.col("labels"), ["R", "A", "F", "O"]))
    shown = F.array_join(F.transform("p", lambda x: F.concat(x["tag"], F.coalesce(F.concat(F.lit(":"), x["disambiguation_id"].cast("string")), F.lit("")))), " ")
    return parsed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("shown"), F.coalesce(F.get("p", F.lit(0))["tag"], F.lit("O")).alias("first"))


def tags_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_inventory(table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_shipdate").cast("string").substr(1, 4), F.lit("[1]|"), F.col("l_linestatus"), F.lit("|x"), F.col("l_returnflag")).alias("labels")), "labels")


def type_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir)


GOLD, PRED = spans_sql("gold"), spans_sql("a")
BOTH = with_(SEQUENCES, GOLD, PRED)


def pairs_sql(touching: bool = False) -> str:
    """CTE ``pairs`` of gold and predicted spans, after BOTH."""
    on = 'g."start" <= p."end" AND p."start" <= g."end"' if touching else 'g."start" < p."end" AND p."start" < g."end"'
    fields = ", ".join(f'g."{c}" AS test_{c}, p."{c}" AS pred_{c}' for c in match.FIELDS)
    edge = lambda w: f"""CASE WHEN p."{w}" IS NULL THEN 'missed' WHEN g."{w}" IS NULL THEN 'wrong' WHEN g."{w}" = p."{w}" THEN 'exact' WHEN g."{w}" < p."{w}" THEN 'late' ELSE 'early' END AS overlap_{w}"""
    return f"""pairs AS (SELECT {fields}, CASE WHEN p."start" IS NULL THEN 'miss_pred' WHEN g."start" IS NULL THEN 'miss_test' WHEN g."start" = p."start" AND g."end" = p."end" AND g.text = p.text THEN 'exact' ELSE 'partial' END AS match_type, {edge("start")}, {edge("end")}
  FROM gold_spans g FULL JOIN a_spans p ON g.text_id = p.text_id AND g.sent_idx = p.sent_idx AND g.label = p.label AND {on})"""


PAIRS = f"{BOTH}, {pairs_sql()}"
_KEY = 'x.text_id = y.text_id AND x.sent_idx = y.sent_idx AND x."start" = y."start" AND x."end" = y."end" AND x.text = y.text'
_COLUMNS = f"text_id, sent_idx, {SPAN}"
_BEGIN = """, places AS (SELECT text_id, sent_idx, a_bio AS l, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY text_id, sent_idx) AS n FROM bio WINDOW w AS (PARTITION BY text_id, sent_idx ORDER BY token_idx)),
stops AS (SELECT *, min(CASE WHEN l NOT LIKE 'I%' THEN p END) OVER (PARTITION BY text_id, sent_idx ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM places)
SELECT text_id, sent_idx, CAST(p AS INT) AS "start", CAST(coalesce(s, n{}) AS INT) AS "end", substr(l, 3) AS label FROM stops WHERE l LIKE 'B%'"""
_FILLED = ", ".join(f"coalesce({c}, -1) AS {c}" for c in ABSENT)
_ERRORS = ", ".join(f"count(*) FILTER (overlap_end = '{k}') AS {k}" for k in KINDS)
SQL = {
    "type_sequence": f"{with_(SEQUENCES)} SELECT * FROM seq",
    "iob2_encode": f"{with_(SEQUENCES)} SELECT text_id, sent_idx, token_idx, gold_bio, a_bio, b_bio FROM bio",
    "token_spans_gold": f"{with_(SEQUENCES, GOLD)} SELECT {_COLUMNS} FROM gold_spans",
    "token_spans_pred": f"{with_(SEQUENCES, PRED)} SELECT {_COLUMNS} FROM a_spans",
    "token_spans_faithful": f"""{with_(SEQUENCES, GOLD)}, lasts AS (SELECT text_id, sent_idx, max(token_idx) + 1 AS m FROM bio GROUP BY 1, 2), final AS (SELECT text_id, sent_idx FROM lasts ORDER BY text_id DESC, sent_idx DESC LIMIT 1)
SELECT s.text_id, s.sent_idx, "start", "end", text, label FROM gold_spans s JOIN lasts l ON s.text_id = l.text_id AND s.sent_idx = l.sent_idx WHERE "end" <> m OR (s.text_id, s.sent_idx) IN (SELECT (text_id, sent_idx) FROM final)""",
    "span_f1_spans": with_(SEQUENCES) + _BEGIN.format(""),
    "span_f1_spans_faithful": with_(SEQUENCES) + _BEGIN.format(" - 1"),
    "inclusive_spans": f"""{with_(SEQUENCES, PRED)} SELECT text_id, sent_idx, "start", "end" - 1 AS "end", label FROM a_spans WHERE label <> 'R'""",
    "span_keys": f"""{with_(SEQUENCES, GOLD)} SELECT text_id || ' ' || sent_idx || ': Span[' || "start" || ':' || "end" || ']: "' || text || '"' AS key, text_id, "start", text FROM gold_spans""",
    "chained_spans": f"""{with_(SEQUENCES, GOLD)}, c AS (SELECT *, CASE WHEN label = 'R' OR coalesce(lag("end") OVER w <> "start", true) THEN 1 ELSE 0 END AS b FROM gold_spans WINDOW w AS (PARTITION BY text_id, sent_idx ORDER BY "start", "end", label)),
d AS (SELECT *, sum(b) OVER (PARTITION BY text_id, sent_idx ORDER BY "start", "end", label) AS i FROM c)
SELECT text_id, sent_idx, min("start") AS "start", max("end") AS "end", string_agg(text, ' ' ORDER BY "start") AS text, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM d GROUP BY text_id, sent_idx, i HAVING max(CASE WHEN b = 1 THEN label END) = 'R'""",
    "overlap_pairs": f"{PAIRS} SELECT * REPLACE ({_FILLED}) FROM pairs",
    "overlap_pairs_touching": f"{BOTH}, {pairs_sql(True)} SELECT * REPLACE ({_FILLED}) FROM pairs",
    "matching_both": f"{BOTH} SELECT {_COLUMNS} FROM a_spans x WHERE EXISTS (SELECT 1 FROM gold_spans y WHERE {_KEY})",
    "gold_only": f"{BOTH} SELECT {_COLUMNS} FROM gold_spans x WHERE NOT EXISTS (SELECT 1 FROM a_spans y WHERE {_KEY})",
    "pred_only": f"{BOTH} SELECT {_COLUMNS} FROM a_spans x WHERE NOT EXISTS (SELECT 1 FROM gold_spans y WHERE {_KEY})",
    "partial_lists": f"""{BOTH}, g AS (SELECT * FROM gold_spans x WHERE NOT EXISTS (SELECT 1 FROM a_spans y WHERE {_KEY})), p AS (SELECT * FROM a_spans x WHERE NOT EXISTS (SELECT 1 FROM gold_spans y WHERE {_KEY}))
SELECT p.text_id AS pred_text_id, p.sent_idx AS pred_sent_idx, p."start" AS pred_start, p."end" AS pred_end, p.text AS pred_text, p.label AS pred_label, string_agg(g."start" || ':' || g."end" || ':' || g.label, ' ' ORDER BY g."start", g."end", g.label) AS gold
FROM p JOIN g ON p.text_id = g.text_id AND p.sent_idx = g.sent_idx AND p."end" >= g."start" AND g."end" >= p."start" GROUP BY ALL""",
    "match_type_counts": f"{PAIRS} SELECT coalesce(test_label, pred_label) AS label, match_type, count(*) AS n FROM pairs GROUP BY 1, 2",
    "boundary_errors": f"{PAIRS} SELECT coalesce(test_label, pred_label) AS label, overlap_start, {_ERRORS} FROM pairs GROUP BY 1, 2",
    "boundary_fractions": f"{PAIRS}, e AS (SELECT coalesce(test_label, pred_label) AS label, overlap_start, count(*) AS w, {_ERRORS} FROM pairs GROUP BY 1, 2) SELECT label, overlap_start, {', '.join(f'round({k} / w, 10) AS {k}' for k in KINDS)} FROM e",
    "label_vocab": "WITH f AS (SELECT event_type AS label, min((ts, event_id)) AS met FROM events GROUP BY 1) SELECT label, CAST(row_number() OVER (ORDER BY met) AS INT) AS id FROM f UNION ALL SELECT '@@unkORpad@@', 0",
    "priority_labels": """WITH s AS (SELECT *, l_suppkey % 7 = 0 AS none, l_linestatus || ':' || (l_suppkey % 9) AS a, l_returnflag AS b, list_position(['R', 'A', 'F', 'O'], l_linestatus) AS pa, list_position(['R', 'A', 'F', 'O'], l_returnflag) AS pb FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN none THEN '' WHEN pb IS NULL OR pb = 0 THEN a WHEN pb < pa THEN b || ' ' || a ELSE a || ' ' || b END AS shown,
CASE WHEN none THEN 'O' WHEN pb IS NULL OR pb = 0 THEN l_linestatus WHEN pb < pa THEN b ELSE l_linestatus END AS first FROM s""",
    "tags_met": "SELECT DISTINCT CAST(year(l_shipdate) AS VARCHAR) AS tag FROM lineitem UNION SELECT DISTINCT 'x' || l_returnflag FROM lineitem",
}
QUERIES = {f.__name__: f for f in (type_sequence, iob2_encode, token_spans_gold, token_spans_pred, token_spans_faithful, span_f1_spans, span_f1_spans_faithful, inclusive_spans, span_keys, chained_spans, overlap_pairs, overlap_pairs_touching, matching_both, gold_only, pred_only, partial_lists, match_type_counts, boundary_errors, boundary_fractions, label_vocab, priority_labels, tags_met)}
