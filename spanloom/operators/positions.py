"""The current token of each position, and running totals that don't gather a text in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITION = ("text_id", "sent_idx", "token_idx")


def current_tokens(annotation: DataFrame, *more: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per position: (text_id, sent_idx, token_idx, token, *more) of its row with the greatest edited_at, then anno_id.

    A position is (text_id, sent_idx, token_idx); rows that lack one of the three have no position and are left out. Null
    edited_at is older than any other. ``token`` may be null. ``by`` names columns derived from the position that the result
    shall be partitioned by, so that later windows over them need no other shuffle; by default rows spread by position, so a
    text of any size is no hot key.
    """
    rows = annotation.dropna(subset=[*POSITION])
    if by:
        rows = rows.repartition(*by)
    newest = F.max_by(F.struct("token", *more), F.struct("edited_at", "anno_id"))
    return rows.groupBy(*by, *(c for c in POSITION if c not in by)).agg(newest.alias("__row")).select(*by, *(c for c in POSITION if c not in by), "__row.*")


def text_sizes(annotation: DataFrame, rows: int = 50_000, most: int = 20_000) -> tuple[int, list[tuple[str, int]]]:
    """The number of distinct text_id, and (text_id, parts) of the large ones, to be split into so many parts.

    Large is a text of more than ``rows`` rows and of more than 1 / ``most`` of all rows, so there are ``most`` of them at most whatever
    the table's size; a part of it has about as many rows as the least large text.
    """
    sizes = annotation.where("text_id is not null").groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))
    limit = max(rows, annotation.count() // most)
    found = sizes.agg(F.count(F.lit(1)).alias("texts"), F.collect_list(F.when(F.col("n") > limit, F.struct("text_id", "n"))).alias("large")).first()
    return found.texts, sorted((r.text_id, r.n // limit + 1) for r in found.large)


def with_parts(annotation: DataFrame, large: list[tuple[str, int]]) -> DataFrame:
    """``annotation`` with ``__part``: 0, but in the texts of ``large`` (see text_sizes) one of their parts, the same for all rows of a position."""
    if not large:
        return annotation.withColumn("__part", F.lit(0))
    listed = F.broadcast(annotation.sparkSession.createDataFrame(large, "text_id string, __parts int"))
    part = F.pmod(F.xxhash64("sent_idx", "token_idx"), F.col("__parts"))
    return annotation.join(listed, "text_id", "left").withColumn("__part", F.coalesce(part.cast("int"), F.lit(0))).drop("__parts")


def running_totals(sizes: DataFrame, key: str, order: str, size: str, span: int = 8192) -> DataFrame:
    """``sizes`` with ``before``, the sum of ``size`` over the rows of the same key that come earlier, and ``total``, that over all.

    ``order`` is a whole number, unique per key. Totals run within spans of ``span`` numbers and over the spans' sums, so the most
    rows of a key in one task are ``span`` or the number of spans.
    """
    spans = sizes.withColumn("__span", F.expr(f"{order} div {span}"))
    sums = spans.groupBy(key, "__span").agg(F.sum(size).alias("__sum"))
    over = W.partitionBy(key)
    sums = sums.select(key, "__span", (F.sum("__sum").over(over.orderBy("__span")) - F.col("__sum")).alias("__earlier"), F.sum("__sum").over(over).alias("total"))
    inner = F.sum(size).over(W.partitionBy(key, "__span").orderBy(order)) - F.col(size)
    return spans.withColumn("__inner", inner).join(sums, [key, "__span"]).withColumn("before", F.col("__inner") + F.col("__earlier")).drop("__span", "__inner", "__earlier")
