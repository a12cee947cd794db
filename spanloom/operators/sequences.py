"""Walks over ordered rows: chunks, batches and blocks, with and without resets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from spanloom.operators.chains import exits, section_entries
from spanloom.operators.positions import running_totals
from spanloom.util import checkpointed


def reset_groups(df: DataFrame, by: list[str], order: list[str], size: str, rule: Callable[[], Callable[[int], int]], out: str = "group_id") -> DataFrame:
    """``df`` with ``out``, the group of each row in a walk over the rows of each ``by`` in ``order``.

    ``rule()`` makes the walker of one key: it takes a row's size and gives its group. Rows are sorted within partitions and streamed, so a
    key may have any number of rows; a walk with resets can't be split, so one key is one task's. Null sizes count 0.
    """
    names = [*by, *order]
    rows = df.repartition(*by) if by else df.repartition(1)
    rows = rows.sortWithinPartitions(*names)
    at = [df.columns.index(c) for c in by]
    size_at = df.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk = None, rule()
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in at))) if at else [()] * len(batch)
            groups = []
            for k, n in zip(keys, batch.column(size_at).to_pylist()):
                if k != key:
                    key, walk = k, rule()
                groups.append(walk(n or 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int32())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, _with(df, out))


def _with(df: DataFrame, out: str) -> StructType:
    return StructType([*df.schema.fields, StructField(out, IntegerType())])


def chunk_rule(limit: float, inclusive: bool = False, most: int | None = None) -> Callable[[], Callable[[int], int]]:
    """Rows join a group until its sum exceeds ``limit``, or reaches it if ``inclusive``; at most ``most`` groups, the last taking the rest."""

    def rule() -> Callable[[int], int]:
        total, group = 0, 0

        def walk(n: int) -> int:
            nonlocal total, group
            mine = group
            total += n
            if total >= limit if inclusive else total > limit:
                total, group = 0, group + 1 if most is None else min(group + 1, most - 1)
            return mine

        return walk

    return rule


def batch_rule(rows: int, words: int, mode: str = "corrected") -> Callable[[], Callable[[int], int]]:
    """A row opens a new batch if the open one has ``rows`` rows, or would have more than ``words`` words.

    "faithful" begins the word count of a new batch at 0, without its first row, so that a batch may have more.
    """

    def rule() -> Callable[[int], int]:
        group, count, total = 0, 0, 0

        def walk(n: int) -> int:
            nonlocal group, count, total
            total += n
            if count and (count >= rows or total > words):
                group, count, total = group + 1, 0, 0 if mode == "faithful" else n
            count += 1
            return group

        return walk

    return rule


def placed_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``__key``, a text of the columns ``by``, and ``__pos``, the row's place from 0 within it in ``order``; checkpointed.

    Rows are sorted over ranges, so a key of any size is many tasks'. Places are counted within tasks, and over tasks by their counts, one row per task and key.
    ``order`` should be unique within ``by``; equal rows get any of their places.
    """
    keyed = df.withColumn("__key", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit(""))
    rows = keyed.repartitionByRange("__key", *order).sortWithinPartitions("__key", *order).withColumn("__task", F.spark_partition_id())
    at = rows.columns.index("__key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, met = None, 0
        for batch in batches:
            runs = pa.compute.run_end_encode(batch.column(at))
            places, begin = [], 0
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                met = met if key == open_key else 0
                places.append(np.arange(met, met + end - begin))
                open_key, met, begin = key, met + end - begin, end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(places) if places else [], pa.int64())], names=[*batch.schema.names, "__i"])

    counted = checkpointed(rows.mapInArrow(count, StructType([*rows.schema.fields, StructField("__i", LongType())])))
    tasks = counted.groupBy("__key", "__task").agg(F.count(F.lit(1)).alias("__n"))
    tasks = tasks.select("__key", "__task", (F.sum("__n").over(W.partitionBy("__key").orderBy("__task")) - F.col("__n")).alias("__base"))
    return counted.join(tasks, ["__key", "__task"]).withColumn("__pos", F.col("__base") + F.col("__i")).drop("__task", "__i", "__base")


def _next_batches(sizes: np.ndarray, rows: int, words: int, faithful: bool, first: bool) -> np.ndarray:
    """Where the next batch begins after one that begins at each place."""
    n, at = len(sizes), np.arange(len(sizes))
    sums = np.concatenate(([0], np.cumsum(sizes)))
    counted_from = np.minimum(at + 1, n) if faithful else at
    if first and n:
        counted_from[0] = 0
    full = np.searchsorted(sums, sums[counted_from] + words, side="right") - 1
    return np.minimum(np.maximum(full, at + 1), np.minimum(at + rows, n))


def packed_batches(df: DataFrame, by: list[str], order: list[str], size: str, rows: int, words: int, mode: str = "corrected", out: str = "batch_id", section: int = 4096) -> DataFrame:
    """``df`` with ``out``, the batch of each row in a walk over the rows of each ``by`` in ``order``, from 0, as batch_rule says.

    A batch begins where the one before it is full, so the batches of a key are a chain: sections of it are asked where each possible begin leaves them, and walked once their
    true begin is known (see chains). No key is one task's, and ``section`` changes no batch. Null sizes count 0.
    """
    section, faithful = max(section, rows), mode == "faithful"
    placed = placed_rows(df, by, order)
    few = placed.select("__key", "__pos", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    k = F.expr(f"__pos div {section}")
    also = F.when((F.col("__pos") % section < rows) & (F.col("__pos") >= section), F.array(k - 1, k)).otherwise(F.array(k))
    parts = few.withColumn("k", F.explode(also)).groupBy("__key", "k").agg(F.sort_array(F.collect_list(F.struct("__pos", "n"))).alias("x"))
    parts = checkpointed(parts.select("__key", "k", F.col("x.n").alias("sizes")))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [exits(_next_batches(np.array(x), rows, words, faithful, i == 0), section, rows) for i, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["__key", "k", "exits"])

    most = (parts.agg(F.max("k")).first()[0] or 0) + 1
    entries = section_entries(parts.mapInArrow(ways, "__key string, k long, exits array<int>"), ["__key"], most)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            locals_ = []
            for i, x, at in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                following, begins, end = _next_batches(np.array(x), rows, words, faithful, i == 0), np.zeros(min(section, len(x)), np.int64), min(section, len(x))
                while at < end:
                    begins[at] = 1
                    at = int(following[at])
                locals_.append(np.cumsum(begins))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(locals_, pa.list_(pa.int64()))], names=["__key", "k", "l"])

    begun = checkpointed(parts.join(entries, ["__key", "k"]).select("__key", "k", "sizes", "entry").mapInArrow(walk, "__key string, k long, l array<bigint>"))
    counts = running_totals(begun.select("__key", "k", F.element_at("l", -1).alias("c")), "__key", "k", "c").select("__key", "k", "before")
    batches = begun.join(counts, ["__key", "k"]).select("__key", "k", "before", F.posexplode("l").alias("i", "l"))
    batches = batches.select("__key", (F.col("k") * section + F.col("i")).alias("__pos"), (F.col("before") + F.col("l") - 1).cast("int").alias(out))
    return placed.join(batches, ["__key", "__pos"]).select(*df.columns, out)


def without_edges(sentences: DataFrame, first: int, last: int, size: str = "n", by: str = "text_id", order: str = "sent_idx") -> DataFrame:
    """``sentences`` of (by, order, size) but those that begin within the first ``first`` tokens of their text or with fewer than ``last`` left."""
    return running_totals(sentences, by, order, size).where((F.col("before") >= first) & (F.col("total") - F.col("before") >= last)).drop("before", "total")


def fixed_blocks(tokens: DataFrame, length: int = 128) -> DataFrame:
    """``tokens`` (text_id, sent_idx, token_idx, …) with block_id and block_pos: blocks of ``length`` tokens of a text.

    The tokens after the last whole block are left out, unless there is no whole one.
    """
    sizes = running_totals(tokens.groupBy("text_id", "sent_idx").agg(F.count(F.lit(1)).alias("n")), "text_id", "sent_idx", "n").select("text_id", "sent_idx", "before", "total")
    rank = F.row_number().over(W.partitionBy("text_id", "sent_idx").orderBy("token_idx")) - 1
    placed = tokens.withColumn("__r", rank).join(sizes, ["text_id", "sent_idx"]).withColumn("__p", F.col("before") + F.col("__r"))
    whole = F.col("total") - F.col("total") % length
    kept = placed.where((F.col("__p") < whole) | (F.col("total") < length))
    return kept.withColumn("block_id", (F.floor(F.col("__p") / length)).cast("int")).withColumn("block_pos", (F.col("__p") % length).cast("int")).drop("__r", "__p", "before", "total")


def within_limits(sentences: DataFrame, max_sents: int | None = None, max_words: int | None = None, size: str = "n", by: str = "text_id", order: str = "sent_idx") -> DataFrame:
    """The first ``max_sents`` sentences of each ``by``, and of them those that end within ``max_words`` words.

    ``order`` is a whole number, unique per ``by``. Sums run in two levels, so no text is in one task.
    """
    out = sentences
    if max_sents is not None:
        out = running_totals(out.withColumn("__one", F.lit(1)), by, order, "__one").where(F.col("before") < max_sents).select(*sentences.columns)
    if max_words is not None:
        out = running_totals(out, by, order, size).where(F.col("before") + F.col(size) <= max_words).select(*sentences.columns)
    return out


def incomplete_sentences(tokens: DataFrame) -> DataFrame:
    """(text_id, sent_idx, tokens, last_idx) of the sentences whose number of tokens isn't their last token_idx."""
    return tokens.groupBy("text_id", "sent_idx").agg(F.count(F.lit(1)).alias("tokens"), F.max("token_idx").alias("last_idx")).where("tokens <> last_idx")


def chunk_terms(tokens: DataFrame, limit: int, skipped: str = r"^[^\p{L}\p{N}]*$", also: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, chunk_id, term, *also, n): frequencies of the lower-case tokens of each chunk, marks and blanks left out; ``also`` names columns such as lemma and part of speech that terms are told apart by.

    Chunks are of whole sentences; one closes once it has more than ``limit`` tokens.
    """
    kept = tokens.where(F.col("token").isNotNull() & ~F.col("token").rlike(skipped))
    sizes = tokens.groupBy("text_id", "sent_idx").agg(F.count_if(F.col("token").isNotNull() & ~F.col("token").rlike(skipped)).cast("int").alias("n"))
    groups = reset_groups(sizes, ["text_id"], ["sent_idx"], "n", chunk_rule(limit)).select("text_id", "sent_idx", "group_id")
    named = kept.join(groups, ["text_id", "sent_idx"]).select("text_id", F.concat("text_id", F.lit("-chunk-"), F.lpad((F.col("group_id") + 1).cast("string"), 3, "0")).alias("chunk_id"), F.lower("token").alias("term"), *also)
    return named.groupBy("text_id", "chunk_id", "term", *also).agg(F.count(F.lit(1)).alias("n"))
