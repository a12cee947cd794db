"""Annotation, fold, prediction, sentence and vocabulary files as tables with explicit keys.

All are scans of text with native expressions: one row per line or per sentence, never a file in one task's memory but for files with
sentences parted by blank lines, which are split at those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.labels import parse_labels

#: Fixed value: what a token line looks like.
LINE = r"(?U)^\d+-\d+\t\d+-\d+\t\S+\t\S+\t"


def text_id_of(path: Column) -> Column:
    """The name of a file's folder without what follows its last dot, signs other than word characters as ``_``."""
    folder = F.url_decode(F.replace(F.element_at(F.split(path, "/"), -2), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(folder, r"(?<=.)\.[^.]*$", ""), r"(?U)\W", "_")


def read_web_anno(spark: SparkSession, path: str, tags: list[str] | None = None, mode: str = "corrected", files: str = "*.tsv") -> DataFrame:
    """(text_id, file, sent_idx, token_idx, char_start, char_end, token, labels) of all ``files`` below ``path``.

    Lines that aren't token lines are skipped: see raw_lines for their reasons. A folder is a text; with several files in it all count, or
    in "faithful" mode the last by name only. ``labels`` are parsed, those of ``tags`` only if given.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.where(F.col("value").rlike(LINE)).withColumn("p", F.split("value", "\t")).withColumn("text_id", text_id_of(F.col("file")))
    if mode == "faithful":
        rows = rows.withColumn("__last", F.max("file").over(W.partitionBy("text_id"))).where("file = __last")
    pair = lambda c, i: F.split(F.col("p")[c], "-")[i].cast("int")
    return rows.select("text_id", "file", pair(0, 0).alias("sent_idx"), pair(0, 1).alias("token_idx"), pair(1, 0).alias("char_start"), pair(1, 1).alias("char_end"), F.col("p")[2].alias("token"), parse_labels(F.col("p")[3], tags).alias("labels"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence, row, value): the lines of sentences parted by blank lines, both counted from 1 within their file."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"), "value", F.monotonically_increasing_id().alias("__i"))
    kept = blocks.withColumn("value", F.regexp_replace("value", r"^[\r\n]+|[\r\n]+$", "")).where("value <> ''")
    number = F.row_number().over(W.partitionBy("file").orderBy("__b", "__i"))
    return kept.select("file", "value", number.alias("sentence")).select("file", "sentence", F.posexplode(F.split("value", r"\r?\n")).alias("row", "value")).withColumn("row", F.col("row") + 1)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(file, text_id, sent_idx, token_idx, char_start, char_end, token, tag) of single-column fold files; raises on lines of other widths."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "").withColumn("p", p).where(F.size("p") > 1)
    rows = rows.withColumn("p", F.when(F.size("p").isin(5, 6), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("a fold line of another width: "), "value"))))
    pair = lambda c, i: F.split(F.col("p")[c], "-")[i].cast("int")
    return rows.select("file", F.col("p")[0].alias("text_id"), pair(1, 0).alias("sent_idx"), pair(1, 1).alias("token_idx"), pair(2, 0).alias("char_start"), pair(2, 1).alias("char_end"), F.col("p")[3].alias("token"), F.col("p")[4].alias("tag"))


def read_predictions(spark: SparkSession, path: str, sent_token: bool = True, mode: str = "corrected") -> DataFrame:
    """(file, text_id, sent_idx, token_idx, token, labels) with labels as array<string>, of either layout: ``s-t`` and char_range, or two whole numbers.

    Blank lines are skipped. "faithful" takes blanks and tabs off both ends of a line first, so that empty last columns vanish.
    """
    value = F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")) if mode == "faithful" else F.regexp_replace("value", r"[\r\n]+$", "")
    rows = spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "").withColumn("p", F.split("value", "\t"))
    if sent_token:
        s, t, first = F.split(F.col("p")[1], "-")[0], F.split(F.col("p")[1], "-")[1], 4
    else:
        s, t, first = F.col("p")[1], F.col("p")[2], 4
    labels = F.slice("p", first + 1, F.greatest(F.size("p") - first, F.lit(0)))
    return rows.select("file", F.col("p")[0].alias("text_id"), s.cast("int").alias("sent_idx"), t.cast("int").alias("token_idx"), F.col("p")[3].alias("token"), labels.alias("labels"))


def melt_labels(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, layer, label): one row per label column, layers counted from 4 as in the files."""
    return df.select(*key, F.posexplode("labels").alias("layer", "label")).withColumn("layer", F.col("layer") + 4)


def two_views(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gold and the predicted view of rows with columns gold and pred, each as ``label``."""
    rest = [c for c in df.columns if c not in ("gold", "pred")]
    return df.select(*rest, F.col("gold").alias("label")), df.select(*rest, F.col("pred").alias("label"))


def read_tags(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """(file, sentence, row, token, label) of two-column tag files, or with the six columns of tagged test files; sentences are parted by blank lines."""
    names = {2: ["token", "label"], 6: ["text_id", "sent_idx", "token_idx", "token", "true_label", "pred_label"]}[columns]
    rows = _numbered(spark, path).withColumn("p", F.split("value", "\t")).where(F.size("p") == columns)
    return rows.select("file", "sentence", "row", *(F.col("p")[i].cast("int" if n in ("sent_idx", "token_idx") else "string").alias(n) for i, n in enumerate(names)))


def read_sentences(spark: SparkSession, path: str, skip_first_line: bool = False) -> DataFrame:
    """(file, sentence, comments, rows) of CoNLL-like files: rows as array<array<string>>; lines with fewer or more columns than the sentence's last are comments."""
    lines = _numbered(spark, path)
    if skip_first_line:
        lines = lines.where(~((F.col("sentence") == 1) & (F.col("row") == 1)))
    packed = lines.groupBy("file", "sentence").agg(F.expr("transform(sort_array(collect_list(struct(row, value))), x -> split(x.value, '\t'))").alias("all"))
    same = F.filter("all", lambda x: F.size(x) == F.size(F.element_at("all", -1)))
    other = F.filter("all", lambda x: F.size(x) != F.size(F.element_at("all", -1)))
    return packed.select("file", "sentence", F.transform(other, lambda x: F.array_join(x, "\t")).alias("comments"), same.alias("rows"))


def sentence_label(comments: Column, task: str) -> Column:
    """The label of a comment ``# task: LABEL``; null if there is none."""
    mine = F.filter(comments, lambda c: c.startswith(f"# {task}: "))
    return F.when(F.size(mine) > 0, F.substr(mine[0], F.lit(len(task) + 5)))


def read_rows(spark: SparkSession, path: str, skip_first_line: bool = False) -> DataFrame:
    """(file, columns) of classification files, lines of fewer than two characters left out, and the first of each file if it is a header."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("__i"))
    if skip_first_line:
        rows = rows.withColumn("__n", F.row_number().over(W.partitionBy("file").orderBy("__i"))).where("__n > 1")
    return rows.where(F.length("value") >= 2).select("file", F.split("value", "\t").alias("columns"))


def read_plain(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(file, sentence, words) of one sentence a line, split at single blanks, empty lines left out, the first ``most`` words of each."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("__i"), "value").where(F.trim("value") != "")
    words = F.split("value", " ")
    return rows.select("file", F.row_number().over(W.partitionBy("file").orderBy("__i")).alias("sentence"), (F.slice(words, 1, most) if most else words).alias("words"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(label, id) of one label a line, its id the number of its line from 0."""
    rows = spark.read.text(path).withColumn("__i", F.monotonically_increasing_id())
    return rows.select(F.col("value").alias("label"), (F.row_number().over(W.orderBy("__i")) - 1).alias("id"))


def read_fold_table(spark: SparkSession, path: str) -> DataFrame:
    """The six named columns of a fold file, quotes taken as they are, without the empty last one."""
    names = ["Document", "Num", "Range", "Word", "Tag", "Empty"]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.read.csv(path, sep="\t", quote="", escape="", schema=schema).drop("Empty")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(file, task, metric, name, value): result trees as a long table; names that aren't numbers are left out."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string, string>").alias("tree"))
    tasks = raw.select("file", F.explode("tree").alias("task", "body")).where(F.col("body").startswith("{"))
    metrics = tasks.select("file", "task", F.explode(F.from_json("body", "map<string, string>")).alias("metric", "body")).where(F.col("body").startswith("{"))
    values = metrics.select("file", "task", "metric", F.explode(F.from_json("body", "map<string, string>")).alias("name", "v"))
    return values.withColumn("value", F.col("v").try_cast("double")).where("value is not null").drop("v")


def reader_for(task_types: list[str]) -> str:
    """Which reader a dataset needs, by the types of its tasks: raw, classification, mlm or sequence."""
    if not task_types:
        return "raw"
    sentence = {"classification", "regression", "multiclas"}
    if all(t in sentence for t in task_types):
        return "classification"
    return "mlm" if all(t == "mlm" for t in task_types) else "sequence"


def merged_config(*parts: dict) -> dict:
    """Configurations merged, later ones first in rank, nested ones merged too."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def task_layout(label_columns: list[str], word_idx: int, train: str, dev: str, test: str, metric: str = "span_f1") -> dict:
    """The configuration of a dataset with one sequence task per label column, columns counted from 4."""
    tasks = {name: {"task_type": "seq_bio", "column_idx": 4 + i, "metric": metric} for i, name in enumerate(label_columns)}
    return {"train_data_path": train, "validation_data_path": dev, "test_data_path": test, "word_idx": word_idx, "tasks": tasks}
