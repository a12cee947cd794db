"""Folds, roles and samples that a seed decides, whatever the order of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.labels import SENTENCE
from spanloom.operators.positions import running_totals
from spanloom.util import checkpointed, lookup_rows

#: Fixed values: (fold_num, test_idx, dev_idx) of five folds.
ROLES = ((0, 4, 0), (1, 3, 4), (2, 2, 3), (3, 1, 2), (4, 0, 1))


def seeded(seed: int, *columns: str) -> Column:
    """A text that orders rows at random for a seed, alike in SQL: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def _struct(row: Row) -> Column:
    return F.struct(F.lit(row.through).cast("long"), F.lit(row.h), F.lit(row.text_id))


def greedy_folds(texts: DataFrame, k: int, seed: int, count: str = "n", digits: int = 3) -> DataFrame:
    """(text_id, fold_id): texts in seeded order, a fold closing once its ``count`` reaches total / k, then from 0 again.

    Running sums are made within 16 ** ``digits`` shares of the order and over those, so no task walks over all texts; the k - 1 closings are looked up one after
    another, each the first sum that is far enough beyond the one before. Texts after the k-th closing stay in the last fold.
    """
    rows = texts.select("text_id", seeded(seed, "text_id").alias("h"), F.coalesce(F.col(count), F.lit(0)).cast("long").alias("n"))
    rows = rows.withColumn("b", F.substr("h", F.lit(1), F.lit(digits)))
    sums = rows.groupBy("b").agg(F.sum("n").alias("s"))
    sums = sums.select("b", (F.sum("s").over(W.orderBy("b")) - F.col("s")).alias("earlier"))
    within = F.sum("n").over(W.partitionBy("b").orderBy("h", "text_id"))
    through = checkpointed(rows.withColumn("w", within).join(sums, "b").select("text_id", "h", "n", (F.col("earlier") + F.col("w")).alias("through")))
    share = (through.agg(F.max("through").alias("t")).first().t or 0) / k
    closings, base, after = [], 0, F.lit(True)
    for _ in range(k - 1):
        # the first text that reaches the share, after the text that closed the fold before: sums alone don't tell texts of size 0 apart
        closing = through.where(after & (F.col("through") - F.lit(base) >= F.lit(share))).agg(F.min(F.struct("through", "h", "text_id")).alias("c")).first().c
        if closing is None:
            break
        closings.append(closing)
        base = closing.through
        after = F.struct("through", "h", "text_id") > _struct(closing)
    fold = F.lit(0)
    for c in closings:
        fold = fold + (F.struct("through", "h", "text_id") > _struct(c)).cast("int")
    return through.select("text_id", fold.alias("fold_id"))


def running_folds(sentences: DataFrame, k: int, count: str = "n", order: str = "sent_idx", by: str = "text_id") -> DataFrame:
    """``sentences`` with fold_id: the sentences of a text by the running sum of ``count`` over round(total / k), the last fold taking the rest.

    ``order`` is a whole number, unique per text. Sums run in two levels, so no text is in one task.
    """
    sums = running_totals(sentences, by, order, count)
    size = F.bround(F.col("total") / F.lit(k), 0)
    fold = F.when(size == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("before") + F.col(count), size)), F.lit(k - 1))).cast("int")
    return sums.withColumn("fold_id", fold).select(*sentences.columns, "fold_id")


def fold_roles(folds: DataFrame) -> DataFrame:
    """``folds`` five times, once per fold_num, with split: test, dev or train."""
    roles = F.array(*(F.struct(F.lit(n).alias("fold_num"), F.lit(t).alias("t"), F.lit(d).alias("d")) for n, t, d in ROLES))
    rows = folds.withColumn("r", F.explode(roles))
    split = F.when(F.col("fold_id") == F.col("r.t"), "test").when(F.col("fold_id") == F.col("r.d"), "dev").otherwise("train")
    return rows.select(*folds.columns, F.col("r.fold_num").alias("fold_num"), split.alias("split"))


def downsample(sentences: DataFrame, fraction: float, seed: int, *by: str, digits: int = 3) -> DataFrame:
    """floor(fraction · n) of the n sentences of each ``by``, or of all, by seeded order; a smaller fraction's are among a greater one's.

    The bound is exact and per group. Ranks are counted within 16 ** ``digits`` shares of the order and over those, so no group is in one task. Null groups are groups.
    """
    rows = sentences.withColumn("__h", seeded(seed, *SENTENCE)).withColumn("__b", F.substr("__h", F.lit(1), F.lit(digits)))
    over = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__b").alias("__share"), (F.sum("c").over(over.orderBy("__b")) - F.col("c")).alias("__earlier"), F.sum("c").over(over).alias("__n"))
    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy(*by, "__b").orderBy("__h", *SENTENCE)))
    on = F.col("__b") == F.col("__share")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = ranked.join(counts, on).withColumn("sample_rank", (F.col("__rank") + F.col("__earlier")).cast("int"))
    return placed.where(F.col("sample_rank") <= F.floor(F.lit(fraction) * F.col("__n"))).select(*sentences.columns, "sample_rank")


def smoothed_shares(sizes: DataFrame, alpha: float, size: str = "n") -> DataFrame:
    """``sizes`` with share and smoothed, share ** alpha over the sum of those."""
    whole = W.partitionBy(F.lit(0))
    shared = sizes.withColumn("share", F.try_divide(F.col(size), F.sum(size).over(whole)))
    powered = shared.withColumn("__p", F.pow("share", F.lit(alpha)))
    return powered.withColumn("smoothed", F.try_divide(F.col("__p"), F.sum("__p").over(whole))).drop("__p")


def masked_tokens(tokens: DataFrame, share: float, seed: int, *key: str) -> DataFrame:
    """``tokens`` with masked: true for a seeded ``share`` of the keys."""
    draw = F.conv(F.substr(seeded(seed, *key), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return tokens.withColumn("masked", draw < F.lit(int(share * 2**32)))


def batch_draws(batches: DataFrame, by: str, batch: str, alpha: float, seed: int) -> DataFrame:
    """(draw, by, batch): as many draws as there are batches, each of a group with the chance of its smoothed size, and of that group the next of its batches, from the first again after the last.

    ``batches`` has one row per batch, ``batch`` counting from 0 within ``by``; the groups are few. The whole part of size · smoothed / share is a group's weight.
    The n-th draw of a group is counted in two levels, so no group is in one task.
    """
    sizes = smoothed_shares(batches.groupBy(by).agg(F.count(F.lit(1)).alias("n")), alpha)
    weights = sizes.select(by, "n", F.floor(F.col("n") * F.col("smoothed") / F.col("share") + F.lit(1e-9)).cast("long").alias("w"))
    rows, at, upper = sorted(lookup_rows(weights), key=lambda r: (r[by] is not None, r[by])), 0, []
    for r in rows:
        at += r.w
        upper.append((r[by], at, r.n))
    total, spark = sum(r.n for r in rows), batches.sparkSession
    place = F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long") % F.lit(max(1, at))
    group = F.lit(None).cast(batches.schema[by].dataType)
    size = F.lit(0).cast("long")
    for name, end, n in reversed(upper):
        group, size = F.when(F.col("place") < end, name).otherwise(group), F.when(F.col("place") < end, n).otherwise(size)
    draws = spark.range(total).withColumnRenamed("id", "draw").withColumn("place", place).withColumn(by, group).withColumn("size", size).withColumn("one", F.lit(1))
    turns = running_totals(draws, by, "draw", "one")
    return turns.select("draw", by, (F.col("before") % F.col("size")).cast("long").alias(batch))


def masked_ids(tokens: DataFrame, token_id: str, share: float, seed: int, mask: int, size: int, *key: str) -> DataFrame:
    """``tokens`` with input_id and label_id: for a seeded ``share`` of the keys the label is the id, and the input is ``mask`` for 80 % of them, a random id below ``size`` for 10 %, the id itself for the rest; for others the label is -100."""
    part = lambda n: F.conv(F.substr(seeded(seed, *key), F.lit(n), F.lit(8)), 16, 10).cast("long")
    chosen = part(1) < F.lit(int(share * 2**32))
    turn = part(9) % 10
    given = F.when(~chosen, F.col(token_id)).when(turn < 8, F.lit(mask)).when(turn == 8, (part(17) % size).cast("int")).otherwise(F.col(token_id))
    return tokens.withColumn("input_id", given.cast("int")).withColumn("label_id", F.when(chosen, F.col(token_id)).otherwise(-100).cast("int"))
