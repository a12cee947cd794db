"""Gold and predicted spans held against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.labels import SENTENCE

FIELDS = ("text_id", "sent_idx", "start", "end", "text", "label")


def _side(spans: DataFrame, side: str, *more: str) -> DataFrame:
    return spans.select(*more, *(F.col(c).alias(f"{side}_{c}") for c in FIELDS))


def _edge(which: str) -> Column:
    gold, pred = F.col(f"test_{which}"), F.col(f"pred_{which}")
    return F.when(pred.isNull(), "missed").when(gold.isNull(), "wrong").when(gold == pred, "exact").when(gold < pred, "late").otherwise("early")


def overlap_join(gold: DataFrame, pred: DataFrame, mode: str = "corrected", by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a gold and a predicted span of one sentence and label that overlap, and the spans of either side that meet none.

    Columns are test_* and pred_* of both, match_type (exact, partial, miss_pred, miss_test), overlap_start and overlap_end. "faithful"
    lets spans that only touch overlap. ``by`` names more columns that both sides must share. A hash join by sentence and label with
    the ranges as its condition: the pairs of one sentence are bounded by its length squared.
    """
    on = (F.col("test_start") <= F.col("pred_end")) & (F.col("pred_start") <= F.col("test_end")) if mode == "faithful" else (F.col("test_start") < F.col("pred_end")) & (F.col("pred_start") < F.col("test_end"))
    for c in ("text_id", "sent_idx", "label"):
        on = on & (F.col(f"test_{c}") == F.col(f"pred_{c}"))
    a, b = _side(gold, "test", *by), _side(pred, "pred", *by)
    if by:
        a = a.select(*(F.col(c).alias(f"__a_{c}") for c in by), *(c for c in a.columns if c not in by))
        b = b.select(*(F.col(c).alias(f"__b_{c}") for c in by), *(c for c in b.columns if c not in by))
        for c in by:
            on = on & (F.col(f"__a_{c}") == F.col(f"__b_{c}"))
    joined = a.join(b, on, "full_outer")
    same = (F.col("test_start") == F.col("pred_start")) & (F.col("test_end") == F.col("pred_end")) & F.col("test_text").eqNullSafe(F.col("pred_text"))
    kind = F.when(F.col("pred_start").isNull(), "miss_pred").when(F.col("test_start").isNull(), "miss_test").when(same, "exact").otherwise("partial")
    keys = [F.coalesce(f"__a_{c}", f"__b_{c}").alias(c) for c in by]
    return joined.withColumn("match_type", kind).select(*keys, *(f"test_{c}" for c in FIELDS), *(f"pred_{c}" for c in FIELDS), "match_type", _edge("start").alias("overlap_start"), _edge("end").alias("overlap_end"))


def either(column: str) -> Column:
    """A column of an overlap row from the side that has it."""
    return F.coalesce(f"test_{column}", f"pred_{column}").alias(column)


#: A span's printed key says these; its label takes no part.
PRINTED = [*SENTENCE, "start", "end", "text"]


def matching(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicted spans with a gold one of the same key, gold spans without a predicted one, and predicted spans without a gold one."""
    return pred.join(gold, PRINTED, "left_semi"), gold.join(pred, PRINTED, "left_anti"), pred.join(gold, PRINTED, "left_anti")


def partial_lists(pred_only: DataFrame, gold_only: DataFrame, mode: str = "corrected") -> DataFrame:
    """Each predicted span with the list of gold spans that it overlaps or touches; "faithful" compares sentence numbers of all texts."""
    on = (F.col("pred_sent_idx") == F.col("test_sent_idx")) & (F.col("pred_end") >= F.col("test_start")) & (F.col("test_end") >= F.col("pred_start"))
    if mode != "faithful":
        on = on & (F.col("pred_text_id") == F.col("test_text_id"))
    joined = _side(pred_only, "pred").join(_side(gold_only, "test"), on)
    return joined.groupBy(*(f"pred_{c}" for c in FIELDS)).agg(F.sort_array(F.collect_list(F.struct("test_text_id", "test_sent_idx", "test_start", "test_end", "test_label"))).alias("gold"))
