"""Queries over words, subwords, scores of labels and prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.scripts import SCRIPTS, script_table
from spanloom.functions.strings import apply_rule_to, best_path_of, edit_script_of, lemma_rule_of, with_heads
from spanloom.operators import arrays
from spanloom.operators.score import describe
from spanloom.plans.adapters import SEQUENCES, TOKENS, labelled, sequences, text_tokens, with_
from spanloom.plans.scores import rounded
from spanloom.sources.prose import paragraphs, prose_of
from spanloom.util import table

CODES = {"O": 0, "A": 1, "R": 2}


def _code(c: str) -> F.Column:
    return F.when(F.col(c) == "A", 1).when(F.col(c) == "R", 2).otherwise(0)


def fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_tokens(spark, sf_dir).withColumn("pieces", arrays.word_pieces(F.col("token")))
    return rounded(arrays.fertility(rows, "pieces", "lang"))


def fertility_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).withColumn("n", F.size(arrays.word_pieces(F.col("token"), 2)))
    return rounded(describe(rows, "n", "gold"))


def _subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with word_ids (null at both ends), codes of the words' labels and numbers of pieces."""
    rows = sequences(spark, sf_dir).select("text_id", "sent_idx", F.struct("token_idx", _code("gold").alias("code"), F.size(arrays.word_pieces(F.col("token"), 2)).alias("n")).alias("x"))
    per = rows.groupBy("text_id", "sent_idx").agg(F.sort_array(F.collect_list("x")).alias("x"))
    ids = F.concat(F.array(F.lit(None).cast("int")), F.flatten(F.transform("x", lambda x, i: F.array_repeat(i, x["n"]))), F.array(F.lit(None).cast("int")))
    return per.select("text_id", "sent_idx", ids.alias("word_ids"), F.col("x.code").alias("codes"))


def subword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _subwords(spark, sf_dir)
    shown = lambda every: F.array_join(arrays.align_labels(F.col("word_ids"), F.col("codes"), every).cast("array<string>"), ",")
    return rows.select("text_id", "sent_idx", shown(False).alias("first_only"), shown(True).alias("every"))


def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _subwords(spark, sf_dir).withColumn("subword", arrays.align_labels(F.col("word_ids"), F.col("codes"), True))
    back = arrays.first_subwords(F.col("word_ids"), F.col("subword"))
    return rows.select("text_id", "sent_idx", F.array_join(back.cast("array<string>"), ",").alias("labels"), F.size(arrays.masked_pairs(F.col("subword"), F.col("subword"))).alias("n"))


def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t: F.count_if(F.col("gold") == t).cast("double")
    rows = sequences(spark, sf_dir).groupBy("text_id").agg(F.array(n("A"), n("O"), n("R")).alias("odds"))
    labels = F.array(F.lit("A"), F.lit("O"), F.lit("R"))
    top = arrays.render_top(arrays.top_n(labels, F.col("odds"), 2, excluded="O"))
    return rows.select("text_id", top.alias("top"), arrays.best_label(F.col("odds")).alias("best"), arrays.above(labels, F.col("odds"), 1.5).alias("above"))


def sequence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "token_idx", "token"))).alias("x"))
    parts = rows.select("text_id", F.posexplode(arrays.parts_of(F.col("x.token"), 5)).alias("part", "tokens"))
    return parts.select("text_id", "part", F.array_join(arrays.padded(F.transform("tokens", lambda t: F.length(t)), 3).cast("array<string>"), ",").alias("lengths"))


def rejoined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "token_idx", "token"))).alias("x"))
    parts = rows.select("text_id", F.posexplode(arrays.parts_of(F.col("x.token"), 5)).alias("part", "tokens"))
    return arrays.joined_parts(parts, ["text_id"], "part", "tokens").select("text_id", F.array_join("tokens", " ").alias("tokens"))


def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.script_ranges(table(spark, sf_dir, "documents"), "text", script_table(spark), "doc_id")


def majority_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = script_counts(spark, sf_dir)
    return arrays.majority_script(counts, "doc_id")


def edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = text_tokens(spark, sf_dir).select("token").distinct().withColumn("target", F.lower(F.reverse("token")))
    return pairs.select("token", "target", edit_script_of("token", "target").alias("script"))


def lemma_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text_tokens(spark, sf_dir).select("token").distinct().withColumn("lemma", F.concat(F.substring("token", 1, 3), F.lit("en")))
    ruled = words.withColumn("rule", lemma_rule_of("token", "lemma"))
    return ruled.select("token", "lemma", "rule", apply_rule_to("token", "rule").alias("made"))


def viterbi_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["O", "B-A", "I-A", "B-R", "I-R"]
    rows = labelled(spark, sf_dir).withColumn("odds", F.array(*(F.when(F.col("a_bio") == x, 2.0).otherwise(0.0) + F.when(F.col("b_bio") == x, 1.5).otherwise(0.0) for x in labels)))
    per = rows.groupBy("text_id", "sent_idx").agg(F.sort_array(F.collect_list(F.struct("token_idx", "odds"))).alias("x"))
    return per.select("text_id", "sent_idx", F.array_join(best_path_of(labels)(F.col("x.odds")), " ").alias("path"))


def mst_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.sort_array(F.collect_list(F.struct("token_idx", F.length("token").alias("n"), "number"))), lambda x: x["n"] * 2 + x["number"])
    n = F.count(F.lit(1)).cast("int")
    score = F.transform(F.sequence(F.lit(0), n), lambda h: F.transform(F.sequence(F.lit(0), n), lambda d: ((h * 7 + d * 3 + F.coalesce(F.get(v, h - 1), F.lit(0))) % 11).cast("double")))
    rows = sequences(spark, sf_dir).groupBy("text_id", "sent_idx").agg(score.alias("score"))
    return with_heads(rows, ["text_id", "sent_idx"], "score").withColumn("heads", F.array_join(F.col("heads").cast("array<string>"), ","))


def prose_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace("text", r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " "), r"[&<>]", " ")
    lines = F.transform(F.split(clean, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    mark = F.when(F.col("domain") == "liturgy", ' ebook-type="hymn"').otherwise("")
    xml = F.concat(F.lit("<body><div"), mark, F.when(F.col("lang").isNotNull(), F.concat(F.lit(' lang="'), F.col("lang"), F.lit('"'))).otherwise(""), F.lit(">"), F.array_join(lines, ""), F.lit("</div></body>"))
    return prose_of(paragraphs(table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")), "doc_id", "xml"), "doc_id")


_CASES = " ".join(f"WHEN u BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in SCRIPTS)
_PIECES = "CAST(greatest(1, ceil(length(token) / {}.0)) AS INT)"
_SCRIPT = f"""chars AS (SELECT doc_id, unicode(c) AS u FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '')), counted AS (SELECT doc_id, CASE {_CASES} ELSE 'Common' END AS script, count(*) AS n FROM chars GROUP BY ALL)"""
SQL = {
    "fertility": f"{with_(TOKENS)}, p AS (SELECT lang, {_PIECES.format(4)} AS n FROM toks) SELECT lang, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS subtokens, round(sum(n) / count(*), 9) AS fertility FROM p GROUP BY 1",
    "fertility_by_label": f"""{with_(SEQUENCES)}, p AS (SELECT gold, {_PIECES.format(2)} AS v FROM seq) SELECT gold, count(v) AS "count", round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, CAST(min(v) AS DOUBLE) AS min, {", ".join(f"round(quantile_cont(v, {q}), 9) AS q{n}" for q, n in ((0.25, 25), (0.5, 50), (0.75, 75)))}, CAST(max(v) AS DOUBLE) AS max FROM p GROUP BY 1""",
    "subword_labels": f"""{with_(SEQUENCES)}, p AS (SELECT text_id, sent_idx, token_idx, CASE gold WHEN 'A' THEN '1' WHEN 'R' THEN '2' ELSE '0' END AS c, {_PIECES.format(2)} AS n FROM seq)
SELECT text_id, sent_idx, '-100,' || string_agg(c || repeat(',-100', n - 1), ',' ORDER BY token_idx) || ',-100' AS first_only, '-100,' || string_agg(c || repeat(',' || c, n - 1), ',' ORDER BY token_idx) || ',-100' AS every FROM p GROUP BY 1, 2""",
    "word_labels": f"""{with_(SEQUENCES)}, p AS (SELECT text_id, sent_idx, token_idx, CASE gold WHEN 'A' THEN '1' WHEN 'R' THEN '2' ELSE '0' END AS c, {_PIECES.format(2)} AS n FROM seq) SELECT text_id, sent_idx, string_agg(c, ',' ORDER BY token_idx) AS labels, CAST(sum(n) AS INT) AS n FROM p GROUP BY 1, 2""",
    "top_labels": f"""{with_(SEQUENCES)}, n AS (SELECT text_id, count(*) FILTER (gold = 'A') AS a, count(*) FILTER (gold = 'O') AS o, count(*) FILTER (gold = 'R') AS r FROM seq GROUP BY 1)
SELECT text_id, CASE WHEN r > a THEN 'R=' || r || '.0|A=' || a || '.0' ELSE 'A=' || a || '.0|R=' || r || '.0' END AS top, CASE WHEN r > o THEN 2 ELSE 1 END AS best, concat_ws('|', CASE WHEN a > 1.5 THEN 'A' END, CASE WHEN o > 1.5 THEN 'O' END, CASE WHEN r > 1.5 THEN 'R' END) AS above FROM n""",
    "sequence_parts": f"""{with_(SEQUENCES)}, p AS (SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY sent_idx, token_idx) - 1 AS i, length(token) AS n FROM seq), g AS (SELECT text_id, CAST(i // 3 AS INT) AS part, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS l, count(*) AS c FROM p GROUP BY 1, 2) SELECT text_id, part, l || repeat(',0', 3 - c) AS lengths FROM g""",
    "rejoined_parts": f"{with_(SEQUENCES)} SELECT text_id, string_agg(token, ' ' ORDER BY sent_idx, token_idx) AS tokens FROM seq GROUP BY 1",
    "script_counts": f"WITH {_SCRIPT} SELECT * FROM counted",
    "majority_scripts": f"WITH {_SCRIPT} SELECT doc_id, first(script ORDER BY script = 'Common', n DESC, script) AS script FROM counted GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (fertility, fertility_by_label, subword_labels, word_labels, top_labels, sequence_parts, rejoined_parts, script_counts, majority_scripts, edit_scripts, lemma_rules, viterbi_bio, mst_heads, prose_paragraphs)}
