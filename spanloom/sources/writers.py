"""Fold, prediction, score and vocabulary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentence_blocks(tokens: DataFrame, line: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, text_id, sent_idx, value): one text per sentence, a line per token and an empty line behind."""
    rows = tokens.select(*by, "text_id", "sent_idx", "token_idx", line.alias("__l")).groupBy(*by, "text_id", "sent_idx").agg(F.sort_array(F.collect_list(F.struct("token_idx", "__l"))).alias("t"))
    return rows.select(*by, "text_id", "sent_idx", F.concat(F.expr("array_join(transform(t, x -> x.__l), '\n')"), F.lit("\n")).alias("value"))


def fold_line(labels: list[str]) -> Column:
    """text_id, s-t, a-b, token and the label columns, tabs between, and a last empty column."""
    where = [F.col("text_id"), F.concat(F.col("sent_idx").cast("string"), F.lit("-"), F.col("token_idx").cast("string")), F.concat(F.col("char_start").cast("string"), F.lit("-"), F.col("char_end").cast("string")), F.col("token")]
    return F.concat_ws("\t", *where, *(F.col(x) for x in labels), F.lit(""))


def write_folds(tokens: DataFrame, path: str, labels: list[str], by: tuple[str, ...] = ("fold_num", "split")) -> None:
    """Text files below ``path``, partitioned by ``by``, sentences of a text in order and whole.

    Rows are range-partitioned by partition and text, so a file holds whole texts, but one text larger than a partition is still streamed.
    """
    blocks = sentence_blocks(tokens, fold_line(labels), by).repartitionByRange(*by, "text_id").sortWithinPartitions(*by, "text_id", "sent_idx")
    blocks.select(*by, "value").write.mode("overwrite").partitionBy(*by).text(path)


def prediction_line(labels: str = "labels") -> Column:
    """text_id, s-t, a-b, token and the labels of an array: what read_predictions reads."""
    return F.concat_ws("\t", F.col("text_id"), F.concat(F.col("sent_idx").cast("string"), F.lit("-"), F.col("token_idx").cast("string")), F.concat(F.col("char_start").cast("string"), F.lit("-"), F.col("char_end").cast("string")), F.col("token"), F.array_join(labels, "\t"))


def write_predictions(tokens: DataFrame, path: str, labels: str = "labels") -> None:
    """One file per partition with the predictions, sentences parted by empty lines."""
    blocks = sentence_blocks(tokens, prediction_line(labels)).repartitionByRange("text_id").sortWithinPartitions("text_id", "sent_idx")
    blocks.select("value").write.mode("overwrite").text(path)


def merged_rows(original: DataFrame, predicted: DataFrame, key: list[str], columns: dict[int, str]) -> DataFrame:
    """``original`` (key, row as array<string>) with the columns at the given places replaced by those of ``predicted``, where it has the key."""
    joined = original.join(predicted.select(*key, *columns.values()), key, "left")
    new = F.create_map(*(c for at, name in columns.items() for c in (F.lit(at), F.col(name))))
    row = F.transform("row", lambda x, i: F.coalesce(F.element_at(new, i), x))
    return joined.select(*key, row.alias("row"))


def score_tree(scores: DataFrame) -> DataFrame:
    """(value): one JSON text of a long table (task, metric, name, value)."""
    metrics = scores.groupBy("task", "metric").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("v"))
    tasks = metrics.groupBy("task").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.to_json("v").alias("v"))))).alias("m"))
    bodies = tasks.select("task", F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}")).alias("b"))
    return bodies.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("task", "b"))), lambda x: F.concat(F.lit('"'), x["task"], F.lit('": '), x["b"])), ", "), F.lit("}")).alias("value"))


def overall_and_rest(results: DataFrame) -> DataFrame:
    """(name, value) of a long table (name, part, value): ``overall_*`` as they are, others as name.part; what is no number is left out."""
    whole = F.col("name").startswith("overall_")
    return results.where("value is not null").select(F.when(whole, F.col("name")).otherwise(F.concat_ws(".", "name", "part")).alias("name"), F.col("value").cast("double").alias("value"))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """One label a line in the order of their ids."""
    vocab.orderBy("id").select("label").coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated files with a header."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def latex_rows(df: DataFrame) -> Column:
    """A line of a LaTeX table of all columns, doubles at two places."""
    cells = [F.format_number(c, 2) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
    return F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\"))
