"""Queries that need a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.mixing import mixture, reached
from spanloom.llm.tokens import document_tokens, document_totals, encode_texts, token_totals, train_tokens
from spanloom.util import table


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_tokens(*(table(spark, sf_dir, t) for t in ("annotation", "split_assign", "task_config", "text_meta")))


def p7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of each document and of each text behind a train_data_path."""
    documents = document_tokens(table(spark, sf_dir, "documents"))
    return documents.withColumn("train_data_path", F.lit(None).cast("string")).unionByName(_train(spark, sf_dir))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, lang and domain."""
    return document_totals(table(spark, sf_dir, "documents")).unionByName(token_totals(_train(spark, sf_dir)))


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each train_data_path of task_config, those without texts too."""
    totals = _train(spark, sf_dir).groupBy("train_data_path").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"))
    paths = table(spark, sf_dir, "task_config").select("train_data_path").distinct()
    return paths.join(totals, "train_data_path", "left").na.fill(0, ["texts", "tokens"])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document."""
    return encode_texts(table(spark, sf_dir, "documents"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with their repeats."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target")).drop("odds")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that it reaches."""
    return reached(mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target")), table(spark, sf_dir, "mix_target"))


QUERIES = {"p7_tokens": p7_tokens, "p7_totals": p7_totals, "p7_paths": p7_paths, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
