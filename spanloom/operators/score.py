"""Scores: of overlapping spans, of labels, and of result trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCORES = ("exact_prec", "exact_rec", "exact_f1", "lenient_prec", "lenient_rec", "lenient_f1")


def f_score(p: Column, r: Column) -> Column:
    """2PR / (P + R); 0 if both are 0, null if one is null."""
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def match_frame(overlap: DataFrame, gold: DataFrame, pred: DataFrame, by: tuple[str, ...] = (), count: str = "pairs") -> DataFrame:
    """Counts and ratios per label, and a row ``Overall`` of the sums with ratios of its own, for each group of ``by``.

    ``row_kind`` is label or overall. Counts of pairs follow the overlap join, where one span may have several partners; with count="spans"
    a gold span counts once, exact before partial. A ratio over nothing is null. One union of three
    counted tables is summed once, for labels and for all.
    """
    if count == "spans":
        rank = F.max(F.when(F.col("match_type") == "exact", 2).when(F.col("match_type") == "partial", 1).otherwise(0))
        one = overlap.where("test_start is not null").groupBy(*by, "test_text_id", "test_sent_idx", "test_start", "test_end", F.col("test_label").alias("label")).agg(rank.alias("r"))
        hits = one.groupBy(*by, "label").agg(F.sum((F.col("r") == 2).cast("long")).alias("e"), F.sum((F.col("r") == 1).cast("long")).alias("p"))
    else:
        hits = overlap.where("match_type in ('exact', 'partial')").groupBy(*by, F.col("test_label").alias("label")).agg(F.sum((F.col("match_type") == "exact").cast("long")).alias("e"), F.sum((F.col("match_type") == "partial").cast("long")).alias("p"))
    zero = F.lit(0).cast("long")
    rows = hits.select(*by, "label", zero.alias("t"), zero.alias("q"), "e", "p")
    rows = rows.unionByName(gold.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("t")).select(*by, "label", "t", zero.alias("q"), zero.alias("e"), zero.alias("p")))
    rows = rows.unionByName(pred.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("q")).select(*by, "label", zero.alias("t"), "q", zero.alias("e"), zero.alias("p")))
    sums = [F.sum(c).cast("double").alias(n) for c, n in (("t", "test_freq"), ("q", "pred_freq"), ("e", "exact_freq"), ("p", "partial_freq"))]
    # one aggregation makes the rows of labels and of all labels; a window over those few rows brings the sums to each
    level = F.grouping("label")
    per = rows.groupingSets([[*map(F.col, by), F.col("label")], [*map(F.col, by)]], *by, "label").agg(level.alias("__all"), *sums)
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    whole = lambda c: F.max(F.when(F.col("__all") == 1, F.col(c))).over(group)
    named = per.withColumn("__e", whole("exact_freq")).withColumn("__p", whole("partial_freq"))
    joined = named.withColumn("label", F.when(F.col("__all") == 1, "Overall").otherwise(F.col("label"))).withColumn("row_kind", F.when(F.col("__all") == 1, "overall").otherwise("label"))
    e, p, t, q = (F.col(c) for c in ("exact_freq", "partial_freq", "test_freq", "pred_freq"))
    n = e + p
    out = joined.select(
        *by, "label", "row_kind", t, q, e, p, (t - e - p).alias("missing"), n.alias("lenient_freq"),
        F.try_divide(e, "__e").alias("exact_prop"), F.try_divide(p, "__p").alias("partial_prop"), F.try_divide(n, F.col("__e") + F.col("__p")).alias("lenient_prop"),
        F.try_divide(e, t).alias("exact_frac"), F.try_divide(p, t).alias("partial_frac"),
        F.try_divide(e, q).alias("exact_prec"), F.try_divide(e, t).alias("exact_rec"), F.try_divide(n, q).alias("lenient_prec"), F.try_divide(n, t).alias("lenient_rec"),
    )
    return out.withColumn("exact_f1", f_score(F.col("exact_prec"), F.col("exact_rec"))).withColumn("lenient_f1", f_score(F.col("lenient_prec"), F.col("lenient_rec")))


def strict_lenient(frame: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The scores of a match frame per label and overall, with the rows macro_avg (mean that skips nulls) and weight_avg (by the labels' share of matches)."""
    targets = F.when(F.col("row_kind") == "label", F.array(F.col("label"), F.lit("macro_avg"), F.lit("weight_avg"))).otherwise(F.array("label"))
    rows = frame.select(*by, "row_kind", *SCORES, "exact_prop", "lenient_prop", F.posexplode(targets).alias("__i", "__to"))
    kind = F.when(F.col("__i") > 0, "average").otherwise(F.col("row_kind"))
    score = lambda c: F.when(F.col("label") == "macro_avg", F.avg(c)).when(F.col("label") == "weight_avg", F.coalesce(F.sum(F.col(c) * F.col(f"{c.split('_')[0]}_prop")), F.lit(0.0))).otherwise(F.max(c)).alias(c)
    return rows.groupBy(*by, F.col("__to").alias("label"), kind.alias("row_kind")).agg(*map(score, SCORES))


def legacy_score(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per label the thirteen figures of the older scorer: exact matches by printed key, partial ones among the rest.

    Without gold spans recall and F are null, and precision too if there is no prediction either; without predictions precision is 0.
    """
    key = ["text_id", "sent_idx", "start", "end", "text", "label"]
    sized = lambda df, name: df.groupBy("label").agg(F.count(F.lit(1)).alias(name))
    both = pred.join(gold, key, "left_semi")
    gold_only, pred_only = gold.join(pred, key, "left_anti"), pred.join(gold, key, "left_anti")
    g, p = gold_only.select("text_id", "sent_idx", "label", F.col("start").alias("gs"), F.col("end").alias("ge")), pred_only.select("text_id", "sent_idx", "label", "start", "end")
    met = p.join(g, ["text_id", "sent_idx", "label"]).where("end >= gs and ge >= start")
    part = met.groupBy("label").agg(F.count(F.lit(1)).alias("true_partial"), F.count_distinct("text_id", "sent_idx", "start", "end").alias("pred_partial"))
    counts = [(gold, "support"), (pred, "predicted"), (both, "true_pred"), (gold_only, "true_only"), (pred_only, "pred_only")]
    out = None
    for df, name in counts:
        out = sized(df, name) if out is None else out.join(sized(df, name), "label", "full_outer")
    out = out.join(part, "label", "left").na.fill(0)
    s, q, tp = F.col("support"), F.col("predicted"), F.col("true_pred")
    precision = lambda x: F.when((q == 0) & (s == 0), None).when(q == 0, 0.0).otherwise(F.try_divide(x, q))
    rows = out.select(
        "label", "support", "true_pred", "true_only", "pred_only", "true_partial", "pred_partial",
        precision(tp).alias("precision_strict"), precision(tp + F.col("pred_partial")).alias("precision_lenient"),
        F.try_divide(tp, s).alias("recall_strict"), F.try_divide(tp + F.col("true_partial"), s).alias("recall_lenient"),
    )
    f = lambda k: F.when(F.col("support") == 0, None).otherwise(f_score(F.col(f"precision_{k}"), F.col(f"recall_{k}"))).alias(f"f1_{k}")
    return rows.select("*", f("strict"), f("lenient"))


def error_typology(overlap: DataFrame, *by: str) -> DataFrame:
    """Per ``by`` and label: sentences with predictions only (hallucinated), with gold only (missed), with both unmet (misplaced), and the gold rows (total)."""
    label = F.coalesce("test_label", "pred_label").alias("label")
    sentence = [F.coalesce("test_text_id", "pred_text_id").alias("text_id"), F.coalesce("test_sent_idx", "pred_sent_idx").alias("sent_idx")]
    n = lambda kind: F.sum((F.col("match_type") == kind).cast("long"))
    per = overlap.groupBy(*by, label, *sentence).agg(n("miss_pred").alias("m"), n("miss_test").alias("h"), F.count("test_start").alias("gold"))
    add = lambda c: F.sum(c.cast("long"))
    return per.groupBy(*by, "label").agg(add((F.col("m") == 0) & (F.col("h") > 0)).alias("hallucinated"), add((F.col("m") > 0) & (F.col("h") == 0)).alias("missed"), add((F.col("m") > 0) & (F.col("h") > 0)).alias("misplaced"), F.sum("gold").alias("total"))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles (interpolated) and greatest of ``value`` per group."""
    q = lambda p, n: F.percentile(value, F.lit(p)).alias(n)
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.max(value).cast("double").alias("max"))


def token_counts(df: DataFrame, gold: str, pred: str, merge: bool = True) -> DataFrame:
    """(label, tp, fp, fn) of tokens; with ``merge``, I- counts as B-. Rows without either label are left out."""
    name = lambda c: F.regexp_replace(c, "^I-", "B-") if merge else F.col(c)
    rows = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).select(name(gold).alias("g"), name(pred).alias("p"))
    pairs = rows.groupBy("g", "p").count()  # all later steps are over pairs of labels
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("g") == F.col("p"), F.col("count")).otherwise(zero)
    miss = F.col("count") - hit
    sides = F.array(F.struct(F.col("g").alias("label"), hit.alias("tp"), zero.alias("fp"), miss.alias("fn")), F.struct(F.col("p").alias("label"), zero.alias("tp"), miss.alias("fp"), zero.alias("fn")))
    return pairs.select(F.inline(sides)).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def rates(df: DataFrame) -> DataFrame:
    """``df`` of tp, fp, fn with precision, recall and f1, 0 where undefined."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def f1_micro(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of all labels together."""
    return rates(counts.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("fn")))


def f1_macro(counts: DataFrame, vocab: DataFrame, mode: str = "corrected") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) per label of ``vocab`` but id 0, and their mean in the row ``macro``.

    "faithful" also has the slots of I- labels, empty after merging, below the greatest id that occurs.
    """
    known = vocab.join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"]).where("id > 0")
    met = F.col("tp") + F.col("fp") + F.col("fn") > 0
    if mode == "faithful":
        top = known.where(met).agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
        kept = known.where(F.col("id") <= top)
    else:
        kept = known.where(met)
    per = rates(kept.select("label", "tp", "fp", "fn"))
    mean = per.agg(F.lit("macro").alias("label"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return per.unionByName(mean)


def f1_binary(counts: DataFrame, positive: str) -> DataFrame:
    """Precision, recall and F1 of one label."""
    return rates(counts.where(F.col("label") == positive).select("tp", "fp", "fn"))


def span_counts(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """One row of tp, fp, fn of two sets of spans, with precision, recall and f1."""
    side = lambda df, name: df.select(*key, F.lit(name).alias("side"))
    return side_counts(side(gold, "gold").unionByName(side(pred, "pred")), key)


def side_counts(spans: DataFrame, key: list[str], gold: str = "gold") -> DataFrame:
    """span_counts of spans with ``side``, those of ``gold`` against all others."""
    per = spans.groupBy(*key).agg(F.max((F.col("side") == gold).cast("int")).alias("g"), F.max((F.col("side") != gold).cast("int")).alias("p"))
    add = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rates(per.agg(add(F.col("g") * F.col("p")).alias("tp"), add((1 - F.col("g")) * F.col("p")).alias("fp"), add(F.col("g") * (1 - F.col("p"))).alias("fn")))


#: Columns that score rows of (gold, pred, …), by name.
METRICS: dict[str, Callable[..., Column]] = {
    "accuracy": lambda gold="gold", pred="pred": F.avg((F.col(gold) == F.col(pred)).cast("double")),
    "multi_acc": lambda gold="gold", pred="pred": F.avg((F.sort_array(gold) == F.sort_array(pred)).cast("double")),
    "las": lambda gold_head="gold_head", pred_head="pred_head", gold_rel="gold_rel", pred_rel="pred_rel": F.avg(((F.col(gold_head) == F.col(pred_head)) & (F.col(gold_rel) == F.col(pred_rel))).cast("double")),
    "avg_dist": lambda gold="gold", pred="pred": F.avg(F.abs(F.col(gold) - F.col(pred)).cast("double")),
    "perplexity": lambda loss="loss": F.exp(F.avg(loss)),
    "mean_loss": lambda loss="loss": F.avg(loss),
}
#: Of these, less is better: they add their reciprocal to a sum.
LESS_IS_BETTER = ("perplexity", "avg_dist")


def metric(df: DataFrame, name: str, *by: str, **columns: str) -> DataFrame:
    """One metric per group, null over no rows."""
    if name not in METRICS:
        raise ValueError(f"no metric {name}; there are {', '.join(METRICS)}")
    return df.groupBy(*by).agg(METRICS[name](**columns).alias(name))


def metric_sum(table: DataFrame, *by: str) -> DataFrame:
    """``sum`` of the optimisation metrics of a long table (metric, value); those of which less is better as their reciprocal."""
    return table.groupBy(*by).agg(F.sum(F.when(F.col("metric").isin(*LESS_IS_BETTER), F.try_divide(F.lit(1.0), F.col("value"))).otherwise(F.col("value"))).alias("sum"))


def best_epochs(scores: DataFrame, by: list[str], epoch: str, value: str, n: int = 1) -> DataFrame:
    """The ``n`` epochs of each run with the greatest ``value``, the earlier of equals first, with their rank from 1."""
    over = W.partitionBy(*by).orderBy(F.desc_nulls_last(value), epoch)
    return scores.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n)


def first_epoch_outlier(scores: DataFrame, by: list[str], epoch: str, value: str, after: int = 4) -> DataFrame:
    """(by, outlier): whether the first epoch of a run lies further from the mean of all than their sample deviation; never for runs of ``after`` epochs or fewer."""
    far = F.abs(F.avg(value) - F.min_by(value, epoch)) > F.stddev_samp(value)
    return scores.groupBy(*by).agg(((F.max(epoch) > after) & F.coalesce(far, F.lit(False))).alias("outlier"))
