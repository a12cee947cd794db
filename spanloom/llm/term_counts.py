"""How often each term occurs, and in how many texts, by heavy-light aggregation.

Rows are partitioned by text, large texts by their parts, which is what finding the current row of each position needs. In that partitioning
terms are counted within tasks, text after text: those found to be heavy by a sketch over all rows, a bounded list, exactly in counter arrays, of
which a task sends one row a term; the others summed up for all of a batch's texts. Only those sums are shuffled; no row of a heavy term is. A large
text lies in several tasks, so its terms go along with its name and are counted once after. Which terms are heavy, and which texts large, changes no result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.packed_values import values_of
from spanloom.operators.positions import POSITION, text_sizes, with_parts
from spanloom.util import lookup_rows

#: Heavy terms of each field, at most.
HEAVY = 512
COUNTS = "field string, term string, text_id string, n long, t long"


def folded(token: str | None) -> str | None:
    """``token`` in NFC, lower case, without U+0020 at its ends."""
    return None if token is None else unicodedata.normalize("NFC", token).lower().strip(" ")


def text_rows(annotation: DataFrame, large: list[tuple[str, int]]) -> DataFrame:
    """(text_id, token, labels) of all rows with text_id, those of a text, or of a part of a large one, one after another.

    ``token`` is null in rows that aren't the current one of a position. One shuffle.
    """
    rows = with_parts(annotation.where("text_id is not null").select(*POSITION, "token", "labels", "edited_at", "anno_id"), large)
    place = W.partitionBy("text_id", "__part", "sent_idx", "token_idx").orderBy(F.desc_nulls_last("edited_at"), F.desc_nulls_last("anno_id"), "token")
    rows = rows.repartition("text_id", "__part").withColumn("__rank", F.row_number().over(place))
    current = (F.col("__rank") == 1) & F.col("sent_idx").isNotNull() & F.col("token_idx").isNotNull()
    return rows.sortWithinPartitions("text_id", "__part").select("text_id", F.when(current, F.col("token")).alias("token"), "labels")


def heavy_terms(annotation: DataFrame, tags: DataFrame, most: int = HEAVY) -> list[tuple[str, str]]:
    """(field, term) of the ``most`` most frequent tokens, by a sketch over all rows, and of the known tags."""
    top = annotation.where("token is not null").select(F.lower(F.trim("token")).alias("t")).agg(F.expr(f"approx_top_k(t, {most}, {16 * most})").alias("top")).first().top
    known = lookup_rows(tags.select("tag").where("tag is not null").distinct())
    return [("token", x["item"]) for x in top or []] + [("tag", r.tag) for r in known][:most]


def _counter(heavy: list[tuple[str, str]], large: set[str], spelling: dict[str, str]):
    """The count within a task: rows of COUNTS, with text_id for terms of large texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(dict.fromkeys(heavy))}
        names = list(place)
        occurrences, texts = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        open_text, seen = None, set()
        for batch in batches:
            if not len(batch):
                continue
            coded = batch.column(0).dictionary_encode()
            ids, text = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            terms: dict[tuple[str, str], int] = {}
            tokens = batch.column(1).dictionary_encode()
            code = np.array([terms.setdefault(("token", folded(x)), len(terms)) for x in tokens.dictionary.to_pylist()], np.int64)
            there = tokens.is_valid().to_numpy(zero_copy_only=False)
            at, what = [text[there]], [code[tokens.indices.drop_null().to_numpy()]]
            labels = batch.column(2).dictionary_encode()
            read = [[terms.setdefault(("tag", tag), len(terms)) for tag, _ in values_of(x, spelling)] for x in labels.dictionary.to_pylist()]
            there = np.flatnonzero(labels.is_valid().to_numpy(zero_copy_only=False))
            mine = labels.indices.drop_null().to_numpy()
            at.append(np.repeat(text[there], [len(read[i]) for i in mine]))
            what.append(np.array([k for i in mine for k in read[i]], np.int64))
            listed = list(terms)
            pairs, n = np.unique(np.concatenate(at).astype(np.int64) * max(1, len(listed)) + np.concatenate(what), return_counts=True)
            t, k = np.divmod(pairs, max(1, len(listed)))
            # a text that goes on from the batch before: its terms that were met count no more
            fresh = np.ones(len(pairs), bool)
            goes_on = ids[0] == open_text
            if goes_on:
                head = np.flatnonzero(t == 0)
                fresh[head] = [listed[i] not in seen for i in k[head]]
            last = {listed[i] for i in k[t == len(ids) - 1]}
            seen = seen | last if goes_on and len(ids) == 1 else last
            open_text = ids[-1]
            big = np.array([x in large for x in ids], bool)[t]
            slot = np.array([place.get(x, -1) for x in listed], np.int64)
            known = slot[k] >= 0
            occurrences += np.bincount(slot[k][known], n[known], len(names)).astype(np.int64)
            texts += np.bincount(slot[k][known & ~big], fresh[known & ~big], len(names)).astype(np.int64)
            light = ~known & ~big
            sums = np.bincount(k[light], n[light], len(listed)).astype(np.int64)
            met = np.flatnonzero(sums)
            apart = np.flatnonzero(big & (fresh | ~known))
            rows = [(*listed[i], None, x) for i, x in zip(met, sums[met])] + [(*listed[k[i]], ids[t[i]], 0 if known[i] else n[i]) for i in apart]
            t_of = np.concatenate([np.bincount(k[light], fresh[light], len(listed))[met], np.ones(len(apart))]).astype(np.int64)
            yield _rows(rows, t_of)
        met = np.flatnonzero(occurrences)
        yield _rows([(*names[i], None, occurrences[i]) for i in met], texts[met])

    return run


def _rows(rows: list[tuple], t: np.ndarray) -> pa.RecordBatch:
    field, term, text, n = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(field, pa.string()), pa.array(term, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(t, pa.int64())], names=["field", "term", "text_id", "n", "t"])


def term_counts(annotation: DataFrame, tags: DataFrame, heavy: list[tuple[str, str]], large: list[tuple[str, int]] = ()) -> DataFrame:
    """(field, term, occurrences, texts): of the folded tokens of positions, and of the tags of all rows.

    Null tokens are no terms; tokens of blanks only are the empty term. Rows without text_id count for no text and are left out. ``heavy`` are
    (field, term) to count in arrays within tasks; ``large`` are texts to be counted in parts, see text_sizes.
    """
    if len(heavy) > 100_000:
        raise ValueError("too many heavy terms to broadcast")
    spelling = {r.tag.lower(): r.tag for r in lookup_rows(tags.select("tag").where("tag is not null"))}
    counted = text_rows(annotation, list(large)).mapInArrow(_counter(heavy, {x for x, _ in large}, spelling), COUNTS)
    # a term of a large text counts once, however many parts have it; the other rows are sums over texts already
    counted = counted.groupBy("field", "term", "text_id").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    return counted.groupBy("field", "term").agg(F.sum("n").alias("occurrences"), F.sum(F.when(F.col("text_id").isNull(), F.col("t")).otherwise(1)).alias("texts"))


def judged_terms(annotation: DataFrame, tags: DataFrame, limits: DataFrame) -> DataFrame:
    """(field, term, occurrences, texts, verdict): ``rare`` below min_texts of the field, ``common`` above max_text_share of all texts.

    A term that is both is ``rare``; one that is neither, or whose field has no limits, has null. The share is of the distinct
    text_id of ``annotation``.
    """
    all_texts, large = text_sizes(annotation)
    counts = term_counts(annotation, tags, heavy_terms(annotation, tags), large)
    rare, common = F.lit(False), F.lit(False)
    for r in lookup_rows(limits.select("field", "min_texts", "max_text_share").dropna()):
        mine = F.col("field") == r.field
        rare = rare | (mine & (F.col("texts") < r.min_texts))
        common = common | (mine & (F.col("texts") > r.max_text_share * all_texts))
    return counts.withColumn("verdict", F.when(rare, "rare").when(common, "common"))
