"""Labelled sequences made of the driver's tables, each as a DataFrame and as SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.labels import iob2
from spanloom.operators.positions import current_tokens
from spanloom.operators.spans import spans_of_sides, token_spans
from spanloom.util import checkpointed, table

#: All columns of lineitem: rows are unique on them, so this is a total order.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts, items as tokens, four to a sentence, with gold and two predicted types: (text_id, lang, fold, sent_idx, token_idx, token, number, gold, pred_a, pred_b)."""
    rows = table(spark, sf_dir, "lineitem").withColumn("text_id", F.col("l_orderkey").cast("string"))
    # partitioned by text_id, so that later windows and groups by text and sentence need no other shuffle
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("text_id").orderBy(*ORDER)) - 1)
    gold = F.when(F.col("l_returnflag") == "N", "O").otherwise(F.col("l_returnflag"))
    off = F.round(F.col("l_discount") * 100)
    a = F.when((F.col("l_linestatus") == "F") & (off >= 8), "O").when((F.col("l_linestatus") == "O") & (off <= 1), "A").otherwise(gold)
    b = F.when(off >= 7, "O").when((F.col("l_linestatus") == "O") & (off <= 2), "R").otherwise(gold)
    return rows.select(
        "text_id",
        F.element_at(F.array(F.lit("de"), F.lit("en"), F.lit("fr")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("lang"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        F.expr("int(rn div 4) + 1").alias("sent_idx"),
        F.expr("int(rn % 4) + 1").alias("token_idx"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("token"),
        (F.col("l_suppkey") % 2).cast("int").alias("number"),
        gold.alias("gold"),
        a.alias("pred_a"),
        b.alias("pred_b"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences with their BIO labels gold_bio, a_bio and b_bio."""
    out = sequences(spark, sf_dir)
    for tag, name in (("gold", "gold_bio"), ("pred_a", "a_bio"), ("pred_b", "b_bio")):
        out = iob2(out, tag, "number", name)
    return out


def spans_of(spark: SparkSession, sf_dir: str, side: str = "gold", mode: str = "corrected") -> DataFrame:
    """The spans of one side: gold, a or b."""
    return token_spans(labelled(spark, sf_dir), f"{side}_bio", mode)


def side_spans(spark: SparkSession, sf_dir: str, *sides: str) -> list[DataFrame]:
    """The spans of several sides, made in one pass over the labelled sequences and written once, as scores read them several times."""
    spans = checkpointed(spans_of_sides(labelled(spark, sf_dir), {s: f"{s}_bio" for s in sides}))
    return [spans.where(F.col("side") == s).drop("side") for s in sides]


def keyed_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold spans for both models and predicted spans, with lang, fold and model."""
    keys = lambda df: df.withColumn("lang", F.element_at(F.array(F.lit("de"), F.lit("en"), F.lit("fr")), (F.col("text_id").cast("long") % 3 + 1).cast("int"))).withColumn("fold", (F.col("text_id").cast("long") % 5).cast("int"))
    gold, a, b = (keys(df) for df in side_spans(spark, sf_dir, "gold", "a", "b"))
    pred = a.withColumn("model", F.lit("a")).unionByName(b.withColumn("model", F.lit("b")))
    return gold.withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b")))), pred


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current non-null tokens of annotation: (text_id, sent_idx, token_idx, token, lang)."""
    return current_tokens(table(spark, sf_dir, "annotation"), "lang").where("token is not null")


def sentence_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, sent_idx, n) of those."""
    return text_tokens(spark, sf_dir).groupBy("text_id", "sent_idx").agg(F.count(F.lit(1)).alias("n"))


def _bio(tag: str, name: str) -> str:
    same = f"{tag} = lag({tag}) OVER w AND number = lag(number) OVER w"
    return f"CASE WHEN {tag} = 'O' THEN 'O' WHEN {same} THEN 'I-' || {tag} ELSE 'B-' || {tag} END AS {name}"


SEQUENCES = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS rn, round(l_discount * 100) AS off,
  CASE WHEN l_returnflag = 'N' THEN 'O' ELSE l_returnflag END AS g FROM lineitem),
seq AS (SELECT CAST(l_orderkey AS VARCHAR) AS text_id, ['de', 'en', 'fr'][CAST(l_orderkey % 3 + 1 AS INT)] AS lang, CAST(l_orderkey % 5 AS INT) AS fold,
  CAST(rn // 4 + 1 AS INT) AS sent_idx, CAST(rn % 4 + 1 AS INT) AS token_idx, 'p' || l_partkey AS token, CAST(l_suppkey % 2 AS INT) AS number, g AS gold,
  CASE WHEN l_linestatus = 'F' AND off >= 8 THEN 'O' WHEN l_linestatus = 'O' AND off <= 1 THEN 'A' ELSE g END AS pred_a,
  CASE WHEN off >= 7 THEN 'O' WHEN l_linestatus = 'O' AND off <= 2 THEN 'R' ELSE g END AS pred_b FROM ranked),
bio AS (SELECT *, {_bio("gold", "gold_bio")}, {_bio("pred_a", "a_bio")}, {_bio("pred_b", "b_bio")} FROM seq
  WINDOW w AS (PARTITION BY text_id, sent_idx ORDER BY token_idx))"""


def spans_sql(side: str) -> str:
    """CTEs that end with ``side``_spans, after SEQUENCES."""
    label = f"{side}_bio"
    return f"""
{side}_marked AS (SELECT text_id, lang, fold, sent_idx, token_idx, token, {label} AS l, substr({label}, 3) AS label,
  CASE WHEN {label} <> 'O' AND ({label} LIKE 'B-%' OR coalesce(lag({label}) OVER w, 'O') = 'O' OR substr(lag({label}) OVER w, 3) <> substr({label}, 3)) THEN 1 ELSE 0 END AS b
  FROM bio WINDOW w AS (PARTITION BY text_id, sent_idx ORDER BY token_idx)),
{side}_islands AS (SELECT *, sum(b) OVER (PARTITION BY text_id, sent_idx ORDER BY token_idx) AS i FROM {side}_marked),
{side}_spans AS (SELECT text_id, lang, fold, sent_idx, CAST(min(token_idx) AS INT) AS "start", CAST(max(token_idx) + 1 AS INT) AS "end", string_agg(token, ' ' ORDER BY token_idx) AS text, min(label) AS label
  FROM {side}_islands WHERE l <> 'O' GROUP BY text_id, lang, fold, sent_idx, i)"""


def with_(*parts: str) -> str:
    """A WITH clause of some CTEs."""
    return "WITH " + ", ".join(p.strip() for p in parts)


TOKENS = """
tokens AS (SELECT * FROM (
  SELECT text_id, sent_idx, token_idx, arg_max(struct_pack(t := token, l := lang), (edited_at, anno_id)) AS x FROM annotation GROUP BY 1, 2, 3)
  WHERE x.t IS NOT NULL),
toks AS (SELECT text_id, sent_idx, token_idx, x.t AS token, x.l AS lang FROM tokens),
sizes AS (SELECT text_id, sent_idx, count(*) AS n FROM toks GROUP BY 1, 2)"""
