"""Labels of tokens: parsing, priority, BIO encoding and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SENTENCE = ("text_id", "sent_idx")


def parse_labels(labels: Column, tags: list[str] | None = None) -> Column:
    """array<struct<tag, disambiguation_id>> of a plain label string: tags parted by ``|``, each with ``[n]`` or without.

    ``_`` and null have none. With ``tags``, only those are kept, in their order, equal ones as written. Backslashes stay, as in
    the files. For fields packed by many hands see packed_values.
    """
    raw = F.filter(F.split(F.when(labels == "_", None).otherwise(labels), r"\|"), lambda x: x != "")
    made = F.transform(
        raw,
        lambda x: F.struct(
            F.when(x.rlike(r"\[\d+\]$"), F.regexp_extract(x, r"^(.*)\[(\d+)\]$", 1)).otherwise(x).alias("tag"),
            F.when(x.rlike(r"\[\d+\]$"), F.regexp_extract(x, r"\[(\d+)\]$", 1).try_cast("int")).alias("disambiguation_id"),
        ),
    )
    if tags is not None:
        order = F.array(*map(F.lit, tags))
        kept = F.filter(made, lambda x: F.array_contains(order, x["tag"]))
        placed = F.transform(kept, lambda x, i: F.struct(F.array_position(order, x["tag"]).alias("p"), i.alias("i"), x.alias("x")))
        made = F.transform(F.array_sort(placed), lambda x: x["x"])
    return F.coalesce(made, F.array().cast("array<struct<tag:string,disambiguation_id:int>>"))


def first_label(labels: Column, tags: list[str]) -> Column:
    """The tag of highest priority, ``O`` if none."""
    return F.coalesce(F.get(parse_labels(labels, tags), F.lit(0))["tag"], F.lit("O"))


def barred(parsed: Column) -> Column:
    """A parsed array as a plain label field again: tags with their numbers, joined by ``|``; ``_`` for none."""
    shown = F.transform(parsed, lambda x: F.concat(x["tag"], F.when(x["disambiguation_id"].isNull(), "").otherwise(F.concat(F.lit("["), x["disambiguation_id"].cast("string"), F.lit("]")))))
    return F.when(F.size(parsed) > 0, F.array_join(shown, "|")).otherwise("_")


def has_tag(parsed: Column, tag: str) -> Column:
    """Whether a parsed array has ``tag``."""
    return F.exists(parsed, lambda x: x["tag"] == tag)


def tag_columns(tags: list[str], task_type: str) -> list[list[str]]:
    """The layout of label columns: all tags in one, or one for each."""
    if task_type == "SINGLETASK":
        return [list(tags)]
    if task_type == "MULTITASK":
        return [[t] for t in tags]
    raise ValueError(f"task_type must be SINGLETASK or MULTITASK, not {task_type}")


def clean_label(label: Column) -> Column:
    """A label without backslashes, up to the first ``|``, with ``B-I-`` as ``B-``."""
    return F.replace(F.split(F.replace(label, F.lit("\\"), F.lit("")), r"\|")[0], F.lit("B-I-"), F.lit("B-"))


def plain_type(label: Column) -> Column:
    """The type of a BIO label."""
    return F.regexp_replace(label, "^[BI]-", "")


def bare_word(word: Column) -> Column:
    """A word of more than one character without anything but ASCII letters and digits; a blank for empty ones and ``nan``."""
    kept = F.when(F.length(word) > 1, F.regexp_replace(word, "[^a-zA-Z0-9]", "")).otherwise(word)
    return F.when(kept.isin("", "nan"), " ").otherwise(kept)


def iob2(df: DataFrame, tag: str, number: str | None, out: str) -> DataFrame:
    """``df`` with ``out``: O where ``tag`` is O or null; else B- if the token before it in the sentence has another tag or number, or there is none; else I-.

    Two missing numbers count as equal.
    """
    over = W.partitionBy(*SENTENCE).orderBy("token_idx")
    same = F.lag(tag).over(over).eqNullSafe(F.col(tag))
    if number:
        same = same & F.lag(number).over(over).eqNullSafe(F.col(number))
    name = F.replace(F.col(tag), F.lit("\\"), F.lit(""))
    label = F.when(F.col(tag).isNull() | (F.col(tag) == "O"), "O").when(same, F.concat(F.lit("I-"), name)).otherwise(F.concat(F.lit("B-"), name))
    return df.withColumn(out, label)


def iob2_stacked(df: DataFrame, parsed: str, columns: list[list[str]], mode: str = "corrected") -> DataFrame:
    """``df`` with ``label_0`` …: one BIO label for each list of ``columns``, from the array column ``parsed``.

    A column takes the token's first tag that is in its list. "faithful" looks only at the token's first tag of all, so that stacked tags
    of other columns are lost.
    """
    over = W.partitionBy(*SENTENCE).orderBy("token_idx")
    out = df.withColumn("__before", F.lag(parsed).over(over))
    for i, tags in enumerate(columns):
        order = F.array(*map(F.lit, tags))
        pool = F.slice(parsed, 1, 1) if mode == "faithful" else F.col(parsed)
        mine = F.get(F.filter(pool, lambda x: F.array_contains(order, x["tag"])), F.lit(0))
        goes_on = F.exists("__before", lambda x: (x["tag"] == mine["tag"]) & x["disambiguation_id"].eqNullSafe(mine["disambiguation_id"]))
        name = F.replace(mine["tag"], F.lit("\\"), F.lit(""))
        out = out.withColumn(f"label_{i}", F.when(mine.isNull(), "O").when(goes_on, F.concat(F.lit("I-"), name)).otherwise(F.concat(F.lit("B-"), name)))
    return out.drop("__before")


def vocabulary(df: DataFrame, label: str, order: list[str], unknown: str | None = None) -> DataFrame:
    """(label, id): labels by first appearance in the order of the columns ``order``, from 0, or from 1 after ``unknown``.

    The distinct labels are numbered in one task; labels are a small set by nature.
    """
    first = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.min(F.struct(*order)).alias("at"))
    ids = first.select("label", (F.row_number().over(W.orderBy("at")) - (0 if unknown else 1)).alias("id"))
    if unknown:
        ids = ids.unionByName(df.sparkSession.createDataFrame([(unknown, 0)], "label string, id int"))
    return ids


def label_ids(df: DataFrame, label: str, vocab: DataFrame, fallback: str | int = 0) -> DataFrame:
    """``df`` with ``label_id``: the id of its label, else that of the label ``fallback`` or the number itself."""
    joined = df.join(vocab.select(F.col("label").alias(label), F.col("id").alias("label_id")), label, "left")
    if isinstance(fallback, int):
        return joined.withColumn("label_id", F.coalesce("label_id", F.lit(fallback)))
    other = vocab.where(F.col("label") == fallback).agg(F.min("id").alias("i")).first().i
    return joined.withColumn("label_id", F.coalesce("label_id", F.lit(other)))


def tag_inventory(labels: DataFrame, column: str, least: int = 2) -> DataFrame:
    """(tag): the distinct tags of a plain label column without numbers, of ``least`` letters or more."""
    tags = labels.select(F.explode(F.split(column, r"\|")).alias("t")).select(F.regexp_replace("t", r"\[[0-9]+\]", "").alias("tag"))
    return tags.where(F.length("tag") >= least).distinct()
