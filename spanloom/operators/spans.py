"""Spans of labelled tokens: four readings of BIO labels, joining and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.labels import SENTENCE, plain_type

KEY = [*SENTENCE, "start", "end", "label"]


def _island_spans(df: DataFrame, begin: Column, inside: Column, kind: Column, end: Column, key: tuple[str, ...] = SENTENCE) -> DataFrame:
    over = W.partitionBy(*key).orderBy("token_idx")
    marked = df.select(*key, "token_idx", "token", kind.alias("label"), begin.alias("__begin"), inside.alias("__inside")).withColumn("__island", F.sum(F.col("__begin").cast("int")).over(over))
    rows = marked.where("__inside").groupBy(*key, "__island").agg(F.min("token_idx").alias("start"), end.alias("end"), F.sort_array(F.collect_list(F.struct("token_idx", "token"))).alias("t"), F.first("label").alias("label"))
    return rows.select(*key, "start", "end", F.expr("array_join(transform(t, x -> x.token), ' ')").alias("text"), "label")


def token_spans(df: DataFrame, label: str, mode: str = "corrected", key: tuple[str, ...] = SENTENCE) -> DataFrame:
    """(text_id, sent_idx, start, end, text, label) of the BIO labels in ``label``; end is one past the last token.

    B opens a span, as does I after O, at the start of a sentence, or after another type; O closes. "faithful" leaves out spans that end
    with their sentence, but for the last sentence of all, as a reader does that forgets its buffer at each new sentence. Null labels
    are O. Sentences spread over tasks; one sentence is in one. ``key`` is that of a sentence, with columns that tell several readings of it apart.
    """
    over = W.partitionBy(*key).orderBy("token_idx")
    lab = F.coalesce(F.col(label), F.lit("O"))
    kind = plain_type(lab)
    inside = lab != "O"
    before = F.lag(lab).over(over)
    begin = inside & (lab.startswith("B-") | before.isNull() | (before == "O") | (plain_type(before) != kind))
    spans = _island_spans(df, begin, inside, kind, F.max("token_idx") + 1, key)
    if mode == "faithful":
        ends = df.groupBy(*SENTENCE).agg((F.max("token_idx") + 1).alias("__last"))
        final = df.agg(F.max(F.struct(*SENTENCE)).alias("s")).first().s
        spans = spans.join(ends, [*SENTENCE]).where((F.col("end") != F.col("__last")) | ((F.col("text_id") == final.text_id) & (F.col("sent_idx") == final.sent_idx))).drop("__last") if final else spans
    return spans


def by_side(df: DataFrame, sides: dict[str, str]) -> DataFrame:
    """(text_id, sent_idx, token_idx, token, side, l): the label columns of ``df`` below each other, with the name that ``sides`` gives each."""
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("side"), F.col(column).alias("l")) for name, column in sides.items())))
    return df.select(*SENTENCE, "token_idx", "token", pairs.alias("p")).select(*SENTENCE, "token_idx", "token", "p.side", "p.l")


def spans_of_sides(df: DataFrame, sides: dict[str, str]) -> DataFrame:
    """token_spans of several label columns in one pass: with ``side``, the name that ``sides`` gives the column."""
    return token_spans(by_side(df, sides), "l", key=(*SENTENCE, "side"))


def begin_spans(df: DataFrame, label: str, mode: str = "corrected", key: tuple[str, ...] = SENTENCE) -> DataFrame:
    """(text_id, sent_idx, start, end, label) as the span score reads labels: each B with the I after it, whatever their type.

    Positions count from 0. ``end`` is the first position that is not I. In "faithful" mode a span that reaches the last token ends there
    all the same, so ``B I`` and ``B O`` at the end of a sentence give one key. ``key`` as in token_spans.
    """
    over = W.partitionBy(*key).orderBy("token_idx")
    lab = F.coalesce(F.col(label), F.lit("O"))
    rows = df.select(*key, "token_idx", lab.alias("__l"), (F.row_number().over(over) - 1).alias("p"))
    after = W.partitionBy(*key).orderBy("token_idx").rowsBetween(1, W.unboundedFollowing)
    stop = F.min(F.when(~F.col("__l").startswith("I"), F.col("p"))).over(after)
    last = F.max("p").over(W.partitionBy(*key))
    end = F.coalesce(stop, last if mode == "faithful" else last + 1)
    return rows.select(*key, F.col("p").alias("start"), end.alias("end"), F.substr("__l", F.lit(3)).alias("label"), "__l").where(F.col("__l").startswith("B")).drop("__l")


def inclusive_spans(df: DataFrame, label: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, sent_idx, start, end, label) with end the last token; ill-formed series count, ``ignored`` types don't."""
    return token_spans(df, label).where(~F.col("label").isin(*ignored) if ignored else F.lit(True)).select(*SENTENCE, "start", (F.col("end") - 1).alias("end"), "label")


def span_key(prefix: str = "") -> Column:
    """The printed key of a span."""
    c = lambda n: F.col(prefix + n)
    # fixed value: how a span is printed
    return F.format_string('%s %d: Span[%d:%d]: "%s"', c("text_id"), c("sent_idx"), c("start"), c("end"), c("text"))


def parse_span(key: Column) -> Column:
    """The struct of a printed key; its text ends at the first inner quote; raises on anything else."""
    pattern = r'^(.*?) (\d+): Span\[(\d+):(\d+)\]: "([^"]*)"'
    part = lambda i: F.regexp_extract(key, pattern, i)
    good = F.struct(part(1).alias("text_id"), part(2).cast("int").alias("sent_idx"), part(3).cast("int").alias("start"), part(4).cast("int").alias("end"), part(5).alias("text"))
    return F.when(key.rlike(pattern), good).otherwise(F.raise_error(F.concat(F.lit("no span: "), key)))


def merge_spans(spans: DataFrame, group: list[str]) -> DataFrame:
    """One span per ``group`` of spans of one sentence: first start, last end, texts joined, labels as a sorted set."""
    rows = spans.groupBy(*SENTENCE, *group).agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("s"), F.sort_array(F.collect_set("label")).alias("labels"))
    return rows.select(*SENTENCE, *group, F.expr("s[0].start").alias("start"), F.expr("element_at(s, -1).end").alias("end"), F.expr("array_join(transform(s, x -> x.text), ' ')").alias("text"), "labels")


def chained_spans(spans: DataFrame, opener: str) -> DataFrame:
    """Each span of label ``opener`` with the spans that follow it without a gap, up to the next ``opener``, merged."""
    over = W.partitionBy(*SENTENCE).orderBy("start", "end", "label")
    starts = (F.col("label") == opener) | F.coalesce(F.lag("end").over(over) != F.col("start"), F.lit(True))
    marked = spans.withColumn("__new", starts).withColumn("chain", F.sum(F.col("__new").cast("int")).over(over))
    opened = F.max(F.when(F.col("__new"), F.col("label") == opener)).over(W.partitionBy(*SENTENCE, "chain"))
    return merge_spans(marked.withColumn("__open", opened).where("__open"), ["chain"]).drop("chain")
