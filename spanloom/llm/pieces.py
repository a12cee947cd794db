"""Texts larger than a limit, cut into pieces at natural boundaries, with overlap.

A text is written as its shape, a string of one letter per token: S for the last of a sentence, C for a mark that ends a
clause, w for any other. One regular expression with bounded quantifiers takes pieces from the shape: as much as fits that ends a
sentence, else as much as ends a clause, else the limit itself. Lookback offsets into the array of tokens supply the overlap.

No text, sentence or block of sentences is gathered whole. Letters are made of the tokens of a sentence by runs of token numbers, and get their
offset in the text by running totals. Sections of a fixed number of tokens are cut apart from each other: a piece goes over a section's end where
it must, and the place where the next section's pieces begin follows from what each section does to every possible begin (see
chains). So the pieces are those that one walk over the whole text takes, whatever the length of sections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.chains import exits, section_entries
from spanloom.operators.positions import POSITION, current_tokens, running_totals
from spanloom.util import checkpointed, heavy_keys, lookup_rows, salted_join

#: Marks that end a clause.
CLAUSE = r"^[,;:.!?)\]»”…–—]+$"
#: Tokens of a section, sentences of a block and token numbers of a run: how the work is split, not what comes out.
SECTION, BLOCK, RUN = 4096, 64, 4096
#: Runs that a sentence can have.
RUNS = 2**31


def _cut(limit: Column) -> Column:
    """The pattern that takes pieces of at most ``limit`` letters."""
    most, less = limit.cast("string"), (limit - 1).cast("string")
    return F.concat(F.lit("(?:.{0,"), less, F.lit("}S|.{0,"), less, F.lit("}C|.{1,"), most, F.lit("})"))


def _ends(shape: np.ndarray, limit: int) -> np.ndarray:
    """Where the piece from each place of ``shape`` ends, as _cut takes it."""
    n = len(shape)
    at = np.arange(n)
    through = np.minimum(at + limit, n) - 1
    sentence, clause = (np.maximum.accumulate(np.where(shape == ord(c), at, -1))[through] for c in "SC")
    return np.where(sentence >= at, sentence, np.where(clause >= at, clause, through)) + 1


def _section_exits(section: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, shape, most, fresh in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                letters = np.frombuffer(shape.encode(), np.uint8)
                ways = exits(_ends(letters, fresh), section, section)
                if k == 0:  # entered at 0 only, and its first piece has no overlap
                    head = int(_ends(letters[:most], most)[0])
                    ways[:fresh] = ways[head] if head < section else head - section
                out.append(ways[:fresh])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["text_id", "k", "exits"])

    return run


def _keyed(annotation: DataFrame, block: int, run: int) -> DataFrame:
    """The rows that have a position, with the block of sentences and the run of token numbers they lie in."""
    return annotation.dropna(subset=[*POSITION]).withColumn("__block", F.expr(f"sent_idx div {block}")).withColumn("__run", F.expr(f"token_idx div {run}"))


def placed_letters(annotation: DataFrame, limits: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(text_id, __block, __run, sent_idx, letters, before, total, lang, max_tokens, ov): the letters of each sentence, or run of one, from offset ``before`` of ``total``."""
    known = [r for r in lookup_rows(limits.select("lang", "max_tokens", "overlap_tokens").dropna()) if r.max_tokens > 0]
    if not known:
        raise ValueError("no limits")
    least = min(known, key=lambda r: (r.max_tokens, r.lang))
    limit, overlap = F.lit(least.max_tokens), F.lit(min(least.overlap_tokens, (least.max_tokens - 1) // 2))
    for r in known:
        limit = F.when(F.col("lang") == r.lang, r.max_tokens).otherwise(limit)
        overlap = F.when(F.col("lang") == r.lang, min(r.overlap_tokens, (r.max_tokens - 1) // 2)).otherwise(overlap)

    part = ["text_id", "__block", "__run"]
    rows = _keyed(annotation, block, run).select(*part, "sent_idx", "token_idx", F.coalesce(F.col("token").rlike(CLAUSE), F.lit(False)).alias("c"), "edited_at", "anno_id").repartition(*part)
    newest = rows.groupBy(*part, "sent_idx", "token_idx").agg(F.max_by("c", F.struct("edited_at", "anno_id")).alias("c"))
    lettered = newest.groupBy(*part, "sent_idx").agg(F.expr("array_join(transform(sort_array(collect_list(struct(token_idx, c))), x -> if(x.c, 'C', 'w')), '')").alias("letters"))
    # made once, a byte a token: sums within texts and over them, sections and their entries all come from it
    lettered = checkpointed(lettered.withColumn("__last", F.col("__run") == F.max("__run").over(W.partitionBy("text_id", "sent_idx"))))
    sized = lettered.withColumn("n", F.length("letters")).withColumn("__order", F.col("sent_idx").cast("long") * (RUNS // run) + F.col("__run"))
    totals = running_totals(sized, "text_id", "__order", "n", span=max(1, block) * (RUNS // run))
    langs = annotation.dropna(subset=[*POSITION]).select("text_id", "lang").distinct().groupBy("text_id").agg(F.min("lang").alias("lang"))
    placed = salted_join(totals, langs, ["text_id"], heavy_keys(lettered, "text_id")).withColumn("max_tokens", limit).withColumn("ov", overlap)
    letters = F.when(F.col("__last"), F.expr("concat(substr(letters, 1, n - 1), 'S')")).otherwise(F.col("letters"))
    return placed.select(*part, "sent_idx", letters.alias("letters"), "before", "total", "lang", "max_tokens", "ov")


def _sections(placed: DataFrame, section: int, lookback: Column, ahead: Column) -> DataFrame:
    """Each row of ``placed`` (before, n, …) once per section k whose tokens, with ``lookback`` before and ``ahead`` behind, it has some of, with those (first, last)."""
    first, last = F.greatest(F.lit(0), F.col("before") - ahead), F.least(F.col("before") + F.col("n") - 1 + lookback, F.col("total") - 1)
    rows = placed.withColumn("k", F.explode(F.sequence(F.floor(first / section), F.floor(last / section))))
    rows = rows.withColumn("first", F.greatest(F.col("before"), F.col("k") * section - lookback))
    return rows.withColumn("last", F.least(F.col("before") + F.col("n"), (F.col("k") + 1) * section + ahead)).where("first < last")


def cut_places(placed: DataFrame, section: int = SECTION) -> DataFrame:
    """Pieces by their places, of placed_letters: (text_id, lang, max_tokens, ov, k, start, overlap, n, sentences), of section k."""
    greatest = placed.agg(F.max("max_tokens").alias("m"), F.max("total").alias("n")).first()
    section = max(section, 2 * (greatest.m or 1))
    fresh = F.col("max_tokens") - F.col("ov")
    rows = _sections(placed.withColumn("n", F.length("letters")), section, F.lit(0), fresh)
    rows = rows.select("text_id", "k", "total", "lang", "max_tokens", "ov", F.struct(F.col("first").alias("o"), "sent_idx", F.expr("substr(letters, cast(first - before + 1 as int), cast(last - first as int))").alias("letters")).alias("l"))
    cut = rows.groupBy("text_id", "k").agg(F.first("lang").alias("lang"), F.first("total").alias("total"), F.first("max_tokens").alias("max_tokens"), F.first("ov").alias("ov"), F.sort_array(F.collect_list("l")).alias("ls"))
    cut = cut.withColumn("shape", F.expr("array_join(transform(ls, x -> x.letters), '')"))
    maps = cut.where(F.col("total") > section).select("text_id", "k", "shape", "max_tokens", fresh.alias("fresh")).mapInArrow(_section_exits(section), "text_id string, k long, exits array<int>")
    cut = cut.join(section_entries(maps, ["text_id"], -(-(greatest.n or 1) // section)), ["text_id", "k"], "left")
    cut = cut.withColumn("entry", F.coalesce("entry", F.lit(0))).withColumn("body", F.expr("substr(shape, entry + 1)"))
    cut = cut.withColumn("head", F.when(F.col("k") == 0, F.length(F.regexp_substr("body", _cut(F.col("max_tokens"))))).otherwise(0))
    sizes = F.transform(F.regexp_extract_all(F.expr("substr(body, head + 1)"), _cut(fresh), F.lit(0)), F.length)
    cut = cut.withColumn("sizes", F.concat(F.when(F.col("head") > 0, F.array("head")).otherwise(F.array().cast("array<int>")), sizes))
    # outer, as else the optimizer has the expressions cut once more to see that there are pieces; there always are
    cut = cut.selectExpr("text_id", "lang", "max_tokens", "ov", "k", "entry", "ls", "sizes", "posexplode_outer(sizes) as (i, n)")
    cut = cut.withColumn("start", F.expr(f"k * {section} + entry + aggregate(slice(sizes, 1, i), 0, (a, x) -> a + x)")).where(F.col("start") < (F.col("k") + 1) * section)
    mine = "filter(ls, x -> x.o < start + n and x.o + length(x.letters) > start)"
    spans = f"transform({mine}, x -> named_struct('s', x.sent_idx, 'n', cast(least(start + n, x.o + length(x.letters)) - greatest(start, x.o) as int)))"
    cut = cut.withColumn("spans", F.expr(spans)).withColumn("overlap", F.expr("cast(least(ov, start) as int)"))
    sentences = "transform(array_distinct(transform(spans, x -> x.s)), s -> named_struct('sent_idx', s, 'new_tokens', aggregate(filter(spans, x -> x.s = s), 0, (a, x) -> a + x.n)))"
    return cut.select("text_id", "lang", "max_tokens", "ov", "k", "start", "overlap", "n", F.expr(sentences).alias("sentences"), F.lit(section).alias("section"))


def split_oversized(annotation: DataFrame, limits: DataFrame, section: int = SECTION, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """Pieces of every text: (text_id, lang, max_tokens, start, overlap, tokens, sentences).

    ``start`` is the offset in the text of the piece's first new token; ``tokens`` has ``overlap`` tokens from before it, then the new
    ones, max_tokens at most together; the new ones of all pieces make up the text. ``sentences`` are (sent_idx, new tokens).
    ``limits`` has lang, max_tokens, overlap_tokens; a text of no listed lang, or null, gets the least max_tokens and its
    overlap. The lang of a text is the least that its rows name. Overlap is less than half of a limit, else half of it less one.
    Null tokens count as tokens. An empty table gives no pieces. ``section`` is raised to twice the greatest limit; it, ``block`` and ``run`` change no piece.
    """
    placed = placed_letters(annotation, limits, block, run)
    cut = cut_places(placed, section)
    section = max(section, 2 * (placed.agg(F.max("max_tokens")).first()[0] or 1))
    part = ["text_id", "__block", "__run"]
    tokens = current_tokens(_keyed(annotation, block, run), by=tuple(part))
    tokens = tokens.groupBy(*part, "sent_idx").agg(F.expr("sort_array(collect_list(struct(token_idx, token))).token").alias("tokens"))
    places = placed.groupBy(*part).agg(F.map_from_entries(F.collect_list(F.struct("sent_idx", "before"))).alias("at"), F.first("total").alias("total"), F.first("max_tokens").alias("max_tokens"), F.first("ov").alias("ov"))
    tokens = tokens.join(places, part).withColumn("before", F.expr("at[sent_idx]")).withColumn("n", F.size("tokens"))
    rows = _sections(tokens, section, F.col("ov"), F.col("max_tokens") - F.col("ov"))
    rows = rows.select("text_id", "k", F.struct(F.col("first").alias("o"), F.expr("slice(tokens, cast(first - before + 1 as int), cast(last - first as int))").alias("tokens")).alias("t"))
    rows = rows.groupBy("text_id", "k").agg(F.sort_array(F.collect_list("t")).alias("t")).selectExpr("text_id", "k", "t[0].o as o0", "flatten(transform(t, x -> x.tokens)) as tokens")
    cut = cut.groupBy("text_id", "k").agg(F.first("lang").alias("lang"), F.first("max_tokens").alias("max_tokens"), F.collect_list(F.struct("start", "overlap", "n", "sentences")).alias("p"))
    pieces = cut.join(rows, ["text_id", "k"]).selectExpr("text_id", "lang", "max_tokens", "tokens as all", "o0", "inline(p)")
    return pieces.selectExpr("text_id", "lang", "max_tokens", "start", "overlap", "slice(all, cast(start - overlap - o0 + 1 as int), overlap + n) as tokens", "sentences")


def oversized(pieces: DataFrame) -> DataFrame:
    """(text_id, sent_idx) of pieces, or of their places: with sent_idx 0 the texts, else the sentences that had to be cut, being larger than their limit."""
    # outer, as else the optimizer has the arrays made once more to see that they aren't empty; none is
    parts = pieces.select("text_id", "max_tokens", F.explode_outer("sentences").alias("s")).select("text_id", "max_tokens", "s.sent_idx", F.col("s.new_tokens").alias("n"))
    sentences = parts.groupBy("text_id", "sent_idx").agg(F.sum("n").alias("n"), F.first("max_tokens").alias("m"))
    texts = sentences.groupBy("text_id").agg(F.lit(0).alias("sent_idx"), F.sum("n").alias("n"), F.first("m").alias("m"))
    return texts.unionByName(sentences).where("n > m").select("text_id", "sent_idx")
