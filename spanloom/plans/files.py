"""Queries that write the sequences as files and read them back: sources and sinks, checked against the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.folds import fold_roles
from spanloom.plans.adapters import SEQUENCES, labelled, with_
from spanloom.plans.scores import rounded
from spanloom.sources import readers, writers
from spanloom.util import shared_folder


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled sequences, with places of characters."""
    return labelled(spark, sf_dir).withColumn("char_start", F.col("token_idx") * 10).withColumn("char_end", F.col("token_idx") * 10 + F.length("token"))


def web_anno_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lines of folders, among comments and blank lines."""
    path, rows = _folder(spark), _tokens(spark, sf_dir)
    field = F.when(F.col("gold") == "O", "_").otherwise(F.concat("gold", F.lit("["), "number", F.lit("]|"), "pred_a"))
    at = F.concat(F.col("text_id"), F.lit("-"), F.concat_ws("-", "sent_idx", "token_idx"))
    line = F.concat_ws("\t", F.concat_ws("-", F.col("text_id"), "token_idx"), F.concat_ws("-", "char_start", "char_end"), F.concat("token", F.lit("x"), "sent_idx"), field, F.lit(""))
    both = F.array(F.concat(F.lit("#Text="), at), line, F.lit(""))
    rows.select(F.concat(F.lit("Köln."), "fold", F.lit(".txt")).alias("text"), F.explode(both).alias("value")).write.partitionBy("text").text(path)
    read = readers.read_web_anno(spark, path, files="*.txt")
    shown = F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["tag"], x["disambiguation_id"].cast("string"))), " ")
    return read.select("text_id", "sent_idx", "token_idx", "char_start", "char_end", "token", shown.alias("labels"))


def fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold files of one role, read as rows."""
    path = _folder(spark)
    folds = fold_roles(_tokens(spark, sf_dir).withColumn("fold_id", F.col("fold"))).where("split = 'test'")
    writers.write_folds(folds, path, ["gold_bio"])
    return readers.read_folds(spark, path).select("text_id", "sent_idx", "token_idx", "char_start", "char_end", "token", "tag")


def fold_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table of named columns, with the fold that its folder names."""
    path = _folder(spark)
    writers.write_folds(fold_roles(_tokens(spark, sf_dir).withColumn("fold_id", F.col("fold"))).where("split = 'dev'"), path, ["a_bio"])
    return readers.read_fold_table(spark, path).groupBy("fold_num", "Tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("Document").alias("documents"))


def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two tasks, read and melted."""
    path = _folder(spark)
    writers.write_predictions(_tokens(spark, sf_dir).withColumn("labels", F.array("a_bio", "b_bio")), path)
    return readers.melt_labels(readers.read_predictions(spark, path), ["text_id", "sent_idx", "token_idx"])


def tag_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns and blank lines between sentences, counted by length of sentence and place."""
    path = _folder(spark)
    blocks = writers.sentence_blocks(_tokens(spark, sf_dir), F.concat_ws("\t", "token", "gold_bio"))
    blocks.select("value").write.text(path)
    rows = readers.read_tags(spark, path)
    return rows.groupBy("row", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).alias("letters"))


def sentence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with comments that name their text and label."""
    path = _folder(spark)
    blocks = writers.sentence_blocks(_tokens(spark, sf_dir), F.concat_ws("\t", "token_idx", "token", "gold_bio"))
    blocks.select(F.concat(F.lit("# text = "), F.concat_ws("/", "text_id", "sent_idx"), F.lit("\n# mood: M"), F.col("text_id").cast("long") % 3, F.lit("\n"), "value").alias("value")).write.text(path)
    rows = readers.read_sentences(spark, path)
    return rows.select(F.substr(F.col("comments")[0], F.lit(10)).alias("sentence"), readers.sentence_label(F.col("comments"), "mood").alias("mood"), F.size("rows").alias("tokens"), F.array_join(F.transform("rows", lambda r: r[1]), " ").alias("text"))


def classification_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text and label a line."""
    path = _folder(spark)
    _tokens(spark, sf_dir).select(F.concat_ws("\t", "token", "gold", "lang").alias("value")).write.text(path)
    c = F.col("columns")
    return readers.read_rows(spark, path).groupBy(c[1].alias("gold"), c[2].alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(c[0])).alias("letters"))


def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sentences, the first three words of each."""
    path = _folder(spark)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_idx", "token"))), lambda x: x["token"]), " ")
    _tokens(spark, sf_dir).groupBy("text_id", "sent_idx").agg(text.alias("value")).select("value").write.text(path)
    return readers.read_plain(spark, path, 3).groupBy(F.array_join("words", " ").alias("words")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the order of their ids."""
    path = _folder(spark)
    rows = labelled(spark, sf_dir).select(F.concat_ws("/", "gold_bio", "lang").alias("label")).distinct()
    ids = rows.withColumn("id", F.conv(F.substr(F.md5("label"), F.lit(1), F.lit(6)), 16, 10).cast("long"))
    writers.write_vocabulary(ids, path)
    return readers.read_vocabulary(spark, path)


def _long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).groupBy(F.col("lang").alias("task")).agg(F.round(F.avg((F.col("gold_bio") == F.col("a_bio")).cast("double")), 6).alias("a"), F.round(F.avg((F.col("gold_bio") == F.col("b_bio")).cast("double")), 6).alias("b"))
    return rows.selectExpr("task", "'accuracy' as metric", "stack(2, 'a', a, 'b', b) as (name, value)")


def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as one tree, read as a long table."""
    path = _folder(spark)
    writers.score_tree(_long_scores(spark, sf_dir)).write.text(path)
    return rounded(readers.read_scores(spark, path).select("task", "metric", "name", "value"))


def named_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results under one name each, as a table with a header, read back, and as lines of a LaTeX table."""
    path = _folder(spark)
    long = _long_scores(spark, sf_dir)
    flat = writers.overall_and_rest(long.select(F.when(F.col("task") == "de", F.concat(F.lit("overall_"), "name")).otherwise(F.col("task")).alias("name"), F.col("name").alias("part"), "value"))
    writers.write_table(flat, path)
    back = spark.read.csv(path, sep="\t", header=True, schema="name string, value double")
    return back.withColumn("line", writers.latex_rows(back))


def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of one task put into the rows of the original file, and both views of them counted."""
    rows = _tokens(spark, sf_dir)
    key = ["text_id", "sent_idx", "token_idx"]
    original = rows.select(*key, F.array("token", "gold_bio", "b_bio").alias("row"))
    merged = writers.merged_rows(original, rows.where("lang <> 'en'").select(*key, "a_bio"), key, {2: "a_bio"})
    gold, pred = readers.two_views(merged.select(F.col("row")[1].alias("gold"), F.col("row")[2].alias("pred")))
    count = lambda df, view: df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("view", F.lit(view))
    return count(gold, "gold").unionByName(count(pred, "pred"))


_TOKENS = f"{with_(SEQUENCES)}, t AS (SELECT *, token_idx * 10 AS char_start, CAST(token_idx * 10 + length(token) AS INT) AS char_end FROM bio), roles AS (SELECT * FROM (VALUES (0, 4, 0), (1, 3, 4), (2, 2, 3), (3, 1, 2), (4, 0, 1)) r(fold_num, test, dev))"
_LONG = f"{with_(SEQUENCES)}, s AS (SELECT lang AS task, round(avg(CASE WHEN gold_bio = a_bio THEN 1.0 ELSE 0.0 END), 6) AS a, round(avg(CASE WHEN gold_bio = b_bio THEN 1.0 ELSE 0.0 END), 6) AS b FROM bio GROUP BY 1), l AS (SELECT task, 'accuracy' AS metric, 'a' AS name, a AS value FROM s UNION ALL SELECT task, 'accuracy', 'b', b FROM s)"
SQL = {
    "web_anno_files": f"""{_TOKENS} SELECT 'text_Köln_' || fold AS text_id, CAST(text_id AS INT) AS sent_idx, token_idx, char_start, char_end, token || 'x' || sent_idx AS token, CASE WHEN gold = 'O' THEN '' ELSE gold || ':' || number || ' ' || pred_a END AS labels FROM t""",
    "fold_files": f"{_TOKENS} SELECT text_id, sent_idx, token_idx, char_start, char_end, token, gold_bio AS tag FROM t JOIN roles ON fold = test",
    "fold_tables": f'{_TOKENS} SELECT fold_num, a_bio AS "Tag", count(*) AS n, count(DISTINCT text_id) AS documents FROM t JOIN roles ON fold = dev GROUP BY 1, 2',
    "prediction_files": f"{_TOKENS} SELECT text_id, sent_idx, token_idx, 4 AS layer, a_bio AS label FROM t UNION ALL SELECT text_id, sent_idx, token_idx, 5, b_bio FROM t",
    "tag_files": f'{_TOKENS} SELECT token_idx AS "row", gold_bio AS label, count(*) AS n, sum(length(token))::BIGINT AS letters FROM t GROUP BY 1, 2',
    "sentence_files": f"{_TOKENS} SELECT text_id || '/' || sent_idx AS sentence, 'M' || (CAST(text_id AS BIGINT) % 3) AS mood, CAST(count(*) AS INT) AS tokens, string_agg(token, ' ' ORDER BY token_idx) AS text FROM t GROUP BY text_id, sent_idx",
    "classification_files": f"{_TOKENS} SELECT gold, lang, count(*) AS n, sum(length(token))::BIGINT AS letters FROM t GROUP BY 1, 2",
    "plain_files": f"{_TOKENS}, w AS (SELECT string_agg(token, ' ' ORDER BY token_idx) FILTER (token_idx <= 3) AS words FROM t GROUP BY text_id, sent_idx) SELECT words, count(*) AS n FROM w GROUP BY 1",
    "vocabulary_files": f"{_TOKENS}, l AS (SELECT DISTINCT gold_bio || '/' || lang AS label FROM t) SELECT label, CAST(row_number() OVER (ORDER BY CAST('0x' || md5(label)[1:6] AS BIGINT)) - 1 AS INT) AS id FROM l",
    "score_files": f"{_LONG} SELECT * FROM l",
    "named_scores": rf"{_LONG}, n AS (SELECT CASE WHEN task = 'de' THEN 'overall_' || name ELSE task || '.' || name END AS name, value FROM l) SELECT name, value, name || ' & ' || printf('%.2f', value) || ' \\' AS line FROM n",
    "merged_files": f"{_TOKENS} SELECT gold_bio AS label, count(*) AS n, 'gold' AS view FROM t GROUP BY 1 UNION ALL SELECT CASE WHEN lang <> 'en' THEN a_bio ELSE b_bio END, count(*), 'pred' FROM t GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (web_anno_files, fold_files, fold_tables, prediction_files, tag_files, sentence_files, classification_files, plain_files, vocabulary_files, score_files, named_scores, merged_files)}
