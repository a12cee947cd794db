"""Sentences that occur, exactly or almost, on both sides of a split.

Sentences are canonicalised and hashed; equal ones form a class, so copies are compared once. Classes of training sentences are
cut into one segment more than the edits allowed, and the segments hashed: within those edits, one segment must stand unchanged in
the other sentence. Evaluation classes hash all their runs of words of those lengths, and the hashes are joined. Length and place rule
out most chance matches in the join; the edit distance of the rest is exact. No similar pair can be missed, and no cap is set.

Results come as pairs of classes with the sentences of each class, which grow with the sentences, however many copies a class has; counts are
products of the numbers of copies. Pairs of sentences are spelled out only where they are asked for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.positions import current_tokens
from spanloom.util import checkpointed, heavy_keys, salted_join

LEAST_WORDS = 10
#: Edits allowed for n words: 15 percent, in whole numbers.
EDITS = "((3 * ({n})) div 20)"
#: The lengths that segments have, for 10 words and more.
SEGMENTS = (4, 5, 6)
#: Sentences of a text that are made in one task.
BLOCK = 64
#: Training classes that share a segment, above which it is hot; and how many numbers of segments a class may choose from.
HOT, LEVELS = 1000, 4


def canonical(token: str) -> str | None:
    """``token`` in lower case, without accents and without U+0020 at its ends; None if it has no letter or digit. A long s is a letter of its own, as lower case leaves it."""
    if not any(c.isalnum() for c in token):
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", plain).strip(" ")


def edit_distance(a: list[str], b: list[str]) -> int:
    """The least number of words to insert, delete or replace; bits of one number hold a column of the table."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for w in b:
        same = at.get(w, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(horizontal | up)), up & horizontal
        score += bool(rise & last) - bool(fall & last)
        rise = (rise << 1 | 1) & full
        up, down = (fall << 1 | ~(vertical | rise)) & full, rise & vertical
    return score


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, str | None] = {}
    for batch in batches:
        out = []
        for tokens in batch.column(2).to_pylist():
            words = []
            for t in tokens:
                if t not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[t] = canonical(t)
                if (w := known[t]) is not None:
                    words.append(w)
            out.append(words)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["text_id", "sent_idx", "words"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
        edits = [edit_distance(a, b) for a, b in sides]
        keep = pa.array([3 * max(len(a), len(b)) // 20 >= e for (a, b), e in zip(sides, edits)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(edits, pa.int32()).filter(keep)], names=["h_train", "h_eval", "edits"])


def sentence_words(annotation: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(text_id, sent_idx, words, h) of the sentences with ``least`` words or more; null tokens are skipped."""
    # partitioned by blocks of sentences at once, so that sentences are made where their positions were settled
    blocked = annotation.withColumn("__block", F.expr(f"sent_idx div {BLOCK}"))
    tokens = current_tokens(blocked, by=("text_id", "__block")).where("token is not null")
    lists = tokens.groupBy("text_id", "__block", "sent_idx").agg(F.sort_array(F.collect_list(F.struct("token_idx", "token"))).alias("t")).select("text_id", "sent_idx", "t.token")
    return lists.mapInArrow(_word_lists, "text_id string, sent_idx int, words array<string>").where(F.size("words") >= least).withColumn("h", F.unhex(F.md5(F.array_join("words", "\x01"))))


def text_sides(split_assign: DataFrame) -> DataFrame:
    """(text_id, split) by the latest row of each text; split in lower case without blanks at its ends."""
    latest = split_assign.where("text_id is not null").groupBy("text_id").agg(F.max_by("split", F.struct("assigned_at", "split")).alias("split"))
    return latest.select("text_id", F.lower(F.trim("split")).alias("split")).where(F.col("split").isin("train", "dev", "test"))


def _segments(classes: DataFrame, level: int) -> DataFrame:
    """(h_train, l, level, p, key) of the training classes: hashes of ``level`` segments more than are needed for one to stand unchanged."""
    rows = classes.where("in_train").selectExpr("h as h_train", "size(words) as l", "words", f"{EDITS.format(n='((20 * size(words)) div 17)')} + 1 + {level} as k")
    if level:
        rows = rows.where("l div k >= 2")
    place = "i * (l div k) + greatest(0, i - (k - l % k))"
    return rows.selectExpr("h_train", "l", f"{level} as level", f"inline(transform(sequence(0, cast(k as int) - 1), i -> named_struct('p', cast({place} as int), 'key', xxhash64(slice(words, cast({place} + 1 as int), cast(l div k + if(i >= k - l % k, 1, 0) as int))))))")


def segment_index(classes: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame | None, tuple[int, ...]]:
    """(h_train, l, p, key) to look up runs of words in, the same of classes that keep hot segments, if there are any, and the lengths of runs to look up.

    A segment that more than ``hot`` classes share would pair them all. With n segments more than needed, n more stand unchanged, so n hot ones can be left out and
    still no pair is missed: each class takes the fewest segments of which so few are hot. Only a class without such a number keeps its hot ones.
    """
    plain = _segments(classes, 0)
    if plain.groupBy("key").count().where(F.col("count") > hot).isEmpty():
        return plain.drop("level"), None, SEGMENTS
    levels = checkpointed(reduce(DataFrame.unionByName, (_segments(classes, n) for n in range(LEVELS))))
    shared = levels.groupBy("level", "key").count().where(F.col("count") > hot).select("level", "key", F.lit(1).alias("hot"))
    flagged = levels.join(shared, ["level", "key"], "left")
    chosen = checkpointed(flagged.groupBy("h_train", "level").agg(F.count("hot").alias("n")).where("n <= level").groupBy("h_train").agg(F.min("level").alias("level")))
    good = flagged.where("hot is null").join(chosen, ["h_train", "level"])
    columns = ["h_train", "l", "p", "key"]
    return good.select(*columns), plain.join(chosen, "h_train", "left_anti").select(*columns), (2, 3, *SEGMENTS)


def similar_classes(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """(h_train, h_eval, edits) of classes (h, words, in_train, in_eval) of different words within the edits allowed."""
    index, kept, sizes = segment_index(classes, hot)
    runs = "concat(" + ", ".join(f"transform(sequence(1, size(words) - {g - 1}), q -> named_struct('q', q - 1, 'key', xxhash64(slice(words, q, {g}))))" for g in sizes) + ")"
    probe = classes.where("in_eval").selectExpr("h as h_eval", "size(words) as m", f"inline({runs})")
    met = index.join(probe, "key")
    if kept is not None:  # segments that stay hot: their classes are dealt out, the runs that meet them repeated
        met = met.unionByName(salted_join(kept, probe, ["key"], heavy_keys(kept, "key", least=hot)))
    most = EDITS.format(n="greatest(l, m)")
    pairs = met.where(f"h_train <> h_eval and abs(l - m) <= {most} and abs(p - q) <= {most}").select("h_train", "h_eval").distinct()
    pairs = pairs.join(classes.selectExpr("h as h_train", "words as a"), "h_train").join(classes.selectExpr("h as h_eval", "words as b"), "h_eval")
    return pairs.select("h_train", "h_eval", "a", "b").mapInArrow(_near, "h_train binary, h_eval binary, edits int")


def class_overlap(annotation: DataFrame, split_assign: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(text_id, sent_idx, split, h), the sentences that can overlap with the class of each, and (h_train, h_eval, edits), the pairs of classes
    that are equal or within 15 percent of edits. Texts without a split are left out, as are sentences of fewer than 10 words.
    """
    words = checkpointed(salted_join(sentence_words(annotation), text_sides(split_assign), ["text_id"], heavy_keys(annotation, "text_id")))
    train = F.col("split") == "train"
    classes = checkpointed(words.groupBy("h").agg(F.any_value("words").alias("words"), F.bool_or(train).alias("in_train"), F.bool_or(~train).alias("in_eval")))
    same = classes.where("in_train and in_eval").selectExpr("h as h_train", "h as h_eval", "0 as edits")
    return words.drop("words"), same.unionByName(similar_classes(classes, hot))


def split_overlap(sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text_id_train, sent_idx_train, text_id_eval, sent_idx_eval, split, edits): each pair of a training and an evaluation sentence of class_overlap, copies spelled out."""
    train = F.col("split") == "train"
    left = sentences.where(train).selectExpr("h as h_train", "text_id as text_id_train", "sent_idx as sent_idx_train")
    right = sentences.where(~train).selectExpr("h as h_eval", "text_id as text_id_eval", "sent_idx as sent_idx_eval", "split")
    half = salted_join(left, pairs, ["h_train"], heavy_keys(left, "h_train"))
    return salted_join(half, right, ["h_eval"], heavy_keys(right, "h_eval")).drop("h_train", "h_eval")


def class_members(sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text_id, sent_idx, split, class_id, links): each sentence of class_overlap once, with its class, named by the least text_id/sent_idx in it, and the number of sentences of the other side that it overlaps with."""
    train = F.col("split") == "train"
    sizes = checkpointed(sentences.groupBy("h").agg(F.min(F.struct("text_id", "sent_idx")).alias("first"), F.count_if(train).alias("trains"), F.count_if(~train).alias("evals")))
    pairs = checkpointed(pairs)
    to_eval = pairs.join(sizes.select(F.col("h").alias("h_eval"), "evals"), "h_eval").groupBy(F.col("h_train").alias("h")).agg(F.sum("evals").alias("from_train"))
    to_train = pairs.join(sizes.select(F.col("h").alias("h_train"), "trains"), "h_train").groupBy(F.col("h_eval").alias("h")).agg(F.sum("trains").alias("from_eval"))
    named = sizes.select("h", F.concat_ws("/", "first.text_id", "first.sent_idx").alias("class_id")).join(to_eval, "h", "left").join(to_train, "h", "left")
    links = F.coalesce(F.when(train, F.col("from_train")).otherwise(F.col("from_eval")), F.lit(0))
    return salted_join(sentences, named, ["h"], heavy_keys(sentences, "h")).select("text_id", "sent_idx", "split", "class_id", links.alias("links"))


def pair_columns(overlap: DataFrame) -> DataFrame:
    """(text_id_a, sent_idx_a, text_id_b, sent_idx_b), the lesser text_id first."""
    first = F.col("text_id_train") < F.col("text_id_eval")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return overlap.select(
        pick("text_id_train", "text_id_eval").alias("text_id_a"),
        pick("sent_idx_train", "sent_idx_eval").alias("sent_idx_a"),
        pick("text_id_eval", "text_id_train").alias("text_id_b"),
        pick("sent_idx_eval", "sent_idx_train").alias("sent_idx_b"),
    )


def overlap_counts(sentences: DataFrame, pairs: DataFrame, text_meta: DataFrame) -> DataFrame:
    """Per split and source of the evaluation text: pairs, the exact ones among them, and evaluation sentences met; source by the latest row of text_meta, null if none.

    Pairs are products of the numbers of copies, so none is spelled out.
    """
    train = F.col("split") == "train"
    sources = text_meta.where("text_id is not null").groupBy("text_id").agg(F.max_by("source", F.struct("catalogued_at", "source")).alias("source"))
    right = sentences.where(~train)
    right = salted_join(right, sources, ["text_id"], heavy_keys(right, "text_id"), "left").groupBy(F.col("h").alias("h_eval"), "split", "source").agg(F.count(F.lit(1)).alias("sentences"))
    left = sentences.where(train).groupBy(F.col("h").alias("h_train")).agg(F.count(F.lit(1)).alias("n"))
    each = pairs.join(left, "h_train").groupBy("h_eval").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("edits") == 0, F.col("n")).otherwise(0)).alias("exact"))
    met = right.join(each, "h_eval")
    return met.groupBy("split", "source").agg(F.sum(F.col("n") * F.col("sentences")).alias("pairs"), F.sum(F.col("exact") * F.col("sentences")).alias("exact_pairs"), F.sum("sentences").alias("eval_sentences"))
