"""From text to subwords and back: cleaning, places to split at, edits over subwords, and labels that say where words begin.

Cleaning, splitting and rendering are expressions of columns. The label pipeline needs a tokenizer, so it runs over Arrow batches.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from spanloom.functions.scripts import SCRIPTS
from spanloom.functions.strings import ADD, DROP, edit_script

# ---- fixed values: white space, signs that stand apart, and scripts without blanks between words ----
BLANKS = r"[\t\n\r\p{Zs}]"
SIGNS = r"\p{P}$+<=>^`|~"
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
KANA = ("Hiragana", "Katakana")
# ---- end of fixed values ----
MODEL = "piece_bpe_32k.model"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is made once; within the lambdas of ``use`` its expression would be made again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(sizes: Column) -> Column:
    """The sum of ``sizes``, whole numbers from 0, up to each, in time that grows as their total. Null if one of them is null."""
    marks = F.flatten(F.transform(sizes, lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))
    # a mark comes after its sum and the marks before it
    return F.transform(F.filter(F.transform(marks, lambda m, p: F.when(m, p)), lambda p: p.isNotNull()), lambda p, i: p - i)


def plain_spaces(text: Column) -> Column:
    """Any white space as a blank, then each pair of blanks as one, from the left, once."""
    return F.replace(F.regexp_replace(text, BLANKS, " "), F.lit("  "), F.lit(" "))


def clean_text(text: Column) -> Column:
    """``text`` without U+FFFD and control, format and unassigned characters, white space as in plain_spaces."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), r"[\x{FFFD}\p{C}]", ""), F.lit("  "), F.lit(" "))


def pre_tokens(text: Column) -> Column:
    """The words of a text: signs and ideographs each by itself, all else up to the next of them or white space."""
    one = rf"[{SIGNS}{IDEOGRAPHS}]|[^\s{SIGNS}{IDEOGRAPHS}]+"
    return F.regexp_extract_all(clean_text(text), F.lit(one), F.lit(0))


def script_places(word: Column, changes: bool = True, mode: str = "corrected") -> Column:
    """Where to split a word, counted in characters before: at each kana, and with ``changes`` at each other character of another script than that before it.

    Characters of no listed script are Common, as digits are. "faithful" takes Hiragana for all of kana, and gives the places of
    kana first.
    """
    kana = KANA[:1] if mode == "faithful" else KANA

    listed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("s")) for a, b, s in SCRIPTS))
    script_of = lambda c: F.coalesce(F.get(F.filter(listed, lambda r: F.ascii(c).between(r["a"], r["b"])), F.lit(0))["s"], F.lit("Common"))
    script = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), script_of)
    # each with that before it; made by shifting once, as a look back would make all scripts again for each character
    pairs = F.arrays_zip(script.alias("s"), F.concat(F.array(F.lit(None).cast("string")), script).alias("b"))
    rows = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["s"].isin(*kana).alias("k"), p["s"].alias("s"), p["b"].alias("b"))), lambda r: r["s"].isNotNull())
    at_kana = F.transform(F.filter(rows, lambda r: r["k"]), lambda r: r["i"])
    if not changes:
        return at_kana
    turned = F.transform(F.filter(rows, lambda r: ~r["k"] & (r["b"] != r["s"])), lambda r: r["i"])
    return F.concat(at_kana, turned) if mode == "faithful" else F.array_sort(F.concat(at_kana, turned))


@lru_cache(100_000)
def _script_parts(word: str, changes: bool) -> tuple[str, ...]:
    """The parts of ``word`` between script_places, for words that are in Python already."""
    script = [next((s for a, b, s in SCRIPTS if a <= ord(c) <= b), "Common") for c in word]
    cuts = [i for i in range(1, len(word)) if script[i] in KANA or (changes and script[i] != script[i - 1])]
    return tuple(word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)]) if b > a)


def with_blanks(word: Column, places: Column) -> Column:
    """``word`` with a blank before each of ``places``, put in from the last of the list to the first."""
    return F.aggregate(F.reverse(places), word, lambda w, i: F.concat(F.substring(w, F.lit(1), i), F.lit(" "), F.substr(w, i + 1)))


def rendered_splits(subwords: Column, places: Column) -> Column:
    """Each subword with a blank at those of ``places``, counted in characters over all subwords, that lie within it.

    Each subword's places are a slice of all, found by how many places come before its characters; to search them for each subword would take the square of a sentence's length.
    """

    def looked_up(ends: Column) -> Column:
        total = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0))
        inner = F.sort_array(F.filter(places, lambda p: (p > 0) & (p < total)))
        return once(F.struct(ends.alias("ends"), inner.alias("places"), total.alias("total")), lambda v: once(F.struct(v["ends"].alias("ends"), v["places"].alias("places"), before(v["places"], v["total"]).alias("before")), rendered))

    def before(inner: Column, total: Column) -> Column:  # of each character: how many places are not after its begin
        steps = F.arrays_zip(F.concat(inner, F.array(total)).alias("to"), F.concat(F.array(F.lit(0)), inner).alias("from"))
        return F.flatten(F.transform(steps, lambda s, n: F.array_repeat(n, s["to"] - s["from"])))

    def rendered(v: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            end = F.get(v["ends"], i)
            start = end - F.length(x)
            low, high = F.get(v["before"], start), F.get(v["before"], end - 1)
            return F.when(F.length(x) < 2, x).otherwise(with_blanks(x, F.transform(F.slice(v["places"], low + 1, high - low), lambda p: p - start)))

        return F.transform(subwords, one)

    return once(running_sums(F.transform(subwords, F.length)), looked_up)


def split_marks(offsets: Column, size: Column) -> Column:
    """``split`` at each of ``offsets``, ``merge`` elsewhere, of ``size`` subwords."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(F.array_contains(offsets, i), "split").otherwise("merge"))


def edited(script: str, subwords: list[str]) -> list[str]:
    """``subwords`` after an edit script over their characters; each kept or added character stays with a subword.

    An added character goes to the subword of the one before it, or to the next if that is empty by now and the other at its end; the first of all to the first subword.
    """
    done, rest, last, at = [""] * len(subwords), list(subwords), None, 0
    signs = iter(script)
    for sign in signs:
        while at < len(rest) and not rest[at]:
            at += 1
        if sign == ADD:
            new = next(signs, "")
            if last is None:
                last = 0
            elif not rest[last] and last + 1 < len(rest) and not done[last + 1] and not rest[last + 1]:
                last += 1
            if subwords:
                done[last] += new
        elif at < len(rest):
            if sign != DROP:
                done[at] += rest[at][0]
                last = at
            rest[at] = rest[at][1:]
    return [a + b for a, b in zip(done, rest)]


@F.pandas_udf(ArrayType(StringType()))
def edited_subwords(script: pd.Series, subwords: pd.Series) -> pd.Series:
    """edited of two columns; null if one is null."""
    return pd.Series([None if s is None or w is None else edited(s, list(w)) for s, w in zip(script, subwords)], dtype=object)


def tokenizer_kind(pieces: list[str]) -> str:
    """How a tokenizer marks the places of blanks, by its pieces of some words: wordpiece, sentencepiece or other."""
    joined = "".join(pieces)
    return "wordpiece" if "##" in joined else "sentencepiece" if "▁" in joined else "other"


def subword_rows(df: DataFrame, key: list[str], text: str, splits: dict[str, str] | None = None, model: str | None = None, changes: bool = True) -> DataFrame:
    """(key, subwords, ids, words): the subwords of each text as they stand in it, without blanks; their ids, 0 for words that the tokenizer can't write; and its pre_tokens.

    Words are split at script_places and as ``splits`` (word, word with blanks) says before they are tokenized by the sentence-piece ``model``. Where it writes
    a character otherwise than the text, or cleaning leaves one out, the edit script between both gives the subwords their own characters back. Null texts have none.
    """
    path = model or os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), MODEL)
    listed = dict(splits or {})
    words = pre_tokens(F.col(text))
    rows = df.select(*key, F.replace(plain_spaces(F.col(text)), F.lit(" "), F.lit("")).alias("__chars"), words.alias("words"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        known: dict[str, tuple[list[str], list[int]]] = {}

        def tokenize(part: str) -> tuple[list[str], list[int]]:
            if part not in known:
                if len(known) > 200_000:
                    known.clear()
                ids = pieces.encode(part)
                shown = [pieces.id_to_piece(i) for i in ids]
                if any(pieces.is_byte(i) or pieces.is_unknown(i) for i in ids):
                    known[part] = [part], [pieces.unk_id()]
                else:
                    bare = [s.replace("▁", "") for s in shown]
                    if "".join(bare) != part:  # normalized: the subwords get the characters of the text back
                        bare = edited(edit_script("".join(bare), part), bare)
                    known[part] = [s for s in bare if s], [i for s, i in zip(bare, ids) if s]
            return known[part]

        for frame in frames:
            out = []
            for k, chars, own in zip(frame[key].itertuples(index=False, name=None), frame["__chars"], frame["words"]):
                subwords, ids = [], []
                for w in own if own is not None else []:
                    for part in listed[w].split(" ") if w in listed else _script_parts(w, changes):
                        a, b = tokenize(part)
                        subwords += a
                        ids += b
                if "".join(subwords) != (chars or ""):  # characters that cleaning leaves out
                    fixed = edited(edit_script("".join(subwords), chars or ""), subwords)
                    pairs = [(s, i) for s, i in zip(fixed, ids) if s]
                    subwords, ids = [s for s, _ in pairs], [i for _, i in pairs]
                out.append((*k, subwords, ids, list(own) if own is not None else []))
            yield pd.DataFrame(out, columns=[*key, "subwords", "ids", "words"])

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)
    return rows.mapInPandas(run, f"{fields}, subwords array<string>, ids array<int>, words array<string>")


def word_places(words: Column) -> Column:
    """Where each of ``words`` ends, in characters over all; blanks don't count. Null if one of them is null."""
    return running_sums(F.transform(words, lambda w: F.length(F.replace(w, F.lit(" "), F.lit("")))))


def learned_splits(rows: DataFrame, gold: str) -> DataFrame:
    """(word, split, n): the pre_tokens of subword_rows that ``gold`` words cut where no subword ends, with blanks there; the most frequent way of each word, the first by name of equals."""
    missed = F.array_except(word_places(F.col(gold)), word_places(F.col("subwords")))
    pairs = rows.select(F.explode(F.arrays_zip(F.col("words").alias("word"), rendered_splits(F.col("words"), missed).alias("split"))).alias("p")).where("p.word <> p.split")
    counts = pairs.groupBy("p.word", "p.split").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("m"), "split")).alias("b"))
    return best.select("word", "b.split", (-F.col("b.m")).alias("n"))
