"""Row-wise operators on arrays: alignment of words and subwords, top-n, padding and splitting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subtoken_marks(pieces: Column) -> Column:
    """Subtokens without ``</w>``, those after the first with ``##`` before them, empty ones left out."""
    bare = F.filter(F.transform(pieces, lambda x: F.replace(x, F.lit("</w>"), F.lit(""))), lambda x: x != "")
    return F.transform(bare, lambda x, i: F.when((i > 0) & ~x.startswith("##"), F.concat(F.lit("##"), x)).otherwise(x))


def word_pieces(word: Column, size: int = 4) -> Column:
    """A plain stand-in for a subword tokenizer: pieces of ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(word) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(word, i * size + 1, F.lit(size)))


def fertility(df: DataFrame, pieces: str, *by: str) -> DataFrame:
    """Subtokens per token of each group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.size(pieces)).alias("subtokens"), F.try_divide(F.sum(F.size(pieces)), F.count(F.lit(1))).alias("fertility"))


def align_labels(word_ids: Column, labels: Column, every: bool = False) -> Column:
    """The label id of each subword: -100 for special ones (null word), the word's label for its first, and for its others that or -100."""
    before = F.transform(word_ids, lambda w, i: F.when(i > 0, F.get(word_ids, i - 1)))
    pairs = F.arrays_zip(word_ids.alias("w"), before.alias("b"))
    return F.transform(pairs, lambda p: F.when(p["w"].isNull(), -100).when(~p["w"].eqNullSafe(p["b"]) | F.lit(every), F.get(labels, p["w"])).otherwise(-100))


def first_subwords(word_ids: Column, values: Column) -> Column:
    """The value of the first subword of each word, special ones left out."""
    rows = F.transform(word_ids, lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get(word_ids, i - 1)).alias("b"), F.get(values, i).alias("v")))
    return F.transform(F.filter(rows, lambda r: r["w"].isNotNull() & ~r["w"].eqNullSafe(r["b"])), lambda r: r["v"])


def gather(values: Column, offsets: Column) -> Column:
    """values[offset] for each offset from 0; null outside."""
    return F.transform(offsets, lambda i: F.get(values, i))


def masked_pairs(gold: Column, pred: Column, mask: int = -100) -> Column:
    """array<struct<gold, pred>> without the places where gold is ``mask``."""
    return F.filter(F.arrays_zip(gold.alias("gold"), pred.alias("pred")), lambda p: p["gold"] != mask)


def space_places(text: Column) -> Column:
    """Where the words of a text, parted by single blanks, end: numbers of characters before each blank, blanks not counted."""
    sizes = F.transform(F.split(text, " "), F.length)
    ends = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    return F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0)))


def nearest_places(gold: Column, found: Column) -> Column:
    """For each place in ``gold`` the index of the same place in ``found``, else of a neighbour.

    Of the two neighbours, one that isn't itself a gold place is taken if only one is such, else the nearer, the earlier of equals. Beyond
    the last place the last is the only neighbour. ``found`` is sorted; an empty one gives nulls.
    """

    def pick(g: Column) -> Column:
        later = F.filter(found, lambda x: x > g)
        earlier = F.filter(found, lambda x: x < g)
        right = F.when(F.size(later) > 0, later[0])
        left = F.when(F.size(earlier) > 0, F.element_at(earlier, -1))
        free = lambda x: x.isNotNull() & ~F.array_contains(gold, F.coalesce(x, F.lit(-1)))
        one = F.when(free(left) & right.isNotNull() & ~free(right), left).when(free(right) & left.isNotNull() & ~free(left), right)
        near = F.when(left.isNull(), right).when(right.isNull(), left).when(g - left <= right - g, left).otherwise(right)
        place = F.when(F.array_contains(found, g), g).otherwise(F.coalesce(one, near))
        return F.array_position(found, place).cast("int") - 1

    return F.transform(gold, lambda g: F.when(F.size(found) > 0, pick(g)))


def top_n(labels: Column, odds: Column, n: int, excluded: str | None = None) -> Column:
    """The n likeliest (p, label), likeliest first, equal ones by label; ``excluded`` takes no place."""
    rows = F.transform(labels, lambda x, i: F.struct((-F.get(odds, i)).alias("m"), x.alias("label")))
    if excluded is not None:
        rows = F.filter(rows, lambda r: r["label"] != excluded)
    return F.transform(F.slice(F.array_sort(rows), 1, n), lambda r: F.struct((-r["m"]).alias("p"), r["label"].alias("label")))


def render_top(top: Column) -> Column:
    """``label=p|label=p`` of a top_n array."""
    return F.array_join(F.transform(top, lambda r: F.concat(r["label"], F.lit("="), r["p"].cast("string"))), "|")


def best_label(odds: Column, from_: int = 1) -> Column:
    """The index of the greatest of ``odds`` from index ``from_`` on, the first of equals."""
    rest = F.slice(odds, F.lit(from_ + 1), F.greatest(F.size(odds) - from_, F.lit(0)))
    return (F.array_position(rest, F.array_max(rest)).cast("int") - 1 + from_)


def above(labels: Column, odds: Column, threshold: float = 0.7) -> Column:
    """The labels with odds above ``threshold``, joined by ``|``."""
    rows = F.transform(labels, lambda x, i: F.struct(x.alias("l"), F.get(odds, i).alias("p")))
    return F.array_join(F.transform(F.filter(rows, lambda r: r["p"] > threshold), lambda r: r["l"]), "|")


def padded(values: Column, n: Column | int, fill: int = 0) -> Column:
    """``values`` with ``fill`` after them up to n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(n - F.size(values), F.lit(0))))


def parts_of(values: Column, most: int, specials: int = 2) -> Column:
    """``values`` as arrays of at most ``most`` less ``specials``; one empty array for none."""
    room = most - specials
    n = F.greatest(F.lit(1), F.ceil(F.size(values) / room)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * room + 1, F.lit(room)))


def joined_parts(df: DataFrame, key: list[str], part: str, values: str) -> DataFrame:
    """(key, values): parts_of put together again in the order of ``part``."""
    rows = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(part, values))).alias("__x"))
    return rows.select(*key, F.flatten(F.transform("__x", lambda x: x[values])).alias(values))


def script_ranges(df: DataFrame, text: str, ranges: DataFrame, key: str) -> DataFrame:
    """(key, script, n): letters of each script in ``text``; ``ranges`` is a fixed table (start, end, script) of code points.

    The table is sent to all tasks; a text's distinct characters are looked up by binary search in one Arrow pass.
    """
    from spanloom.util import lookup_rows

    rows = sorted((r.start, r.end, r.script) for r in lookup_rows(ranges.select("start", "end", "script"), 10_000))
    starts = [r[0] for r in rows]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_right
        from collections import Counter

        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text]):
                counts: Counter = Counter()
                for c, n in Counter(t or "").items():
                    i = bisect_right(starts, ord(c)) - 1
                    counts[rows[i][2] if i >= 0 and ord(c) <= rows[i][1] else "Common"] += n
                out += [(k, s, n) for s, n in counts.items()]
            yield pd.DataFrame(out, columns=[key, "script", "n"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, script string, n long")


def majority_script(counts: DataFrame, key: str) -> DataFrame:
    """(key, script): the most frequent script that isn't Common, the first by name of equals; Common if there is none."""
    best = F.max_by(F.col("script"), F.struct((F.col("script") != "Common").cast("int"), "n", F.expr("transform(split(script, ''), c -> -ascii(c))")))
    return counts.groupBy(key).agg(best.alias("script"))
