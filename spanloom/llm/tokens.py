"""Encoding with a public byte-level BPE, and token counts per slice of the corpus.

Long texts are encoded by halves. Where a half can end at a place that always ends a piece of the tokenizer's pattern, the ids of both
sides just follow each other. Text that has no such place, one piece of any length, is encoded as a tree: both halves by themselves, in
parallel, then a window around the join, growing until its first and last ids agree with both sides. Ids whose neighbours are valid pairs are
the encoding, so the result is exact.

Totals count each distinct text once: whole documents are hashed, repeats are dropped within the tasks that read them and then by hash, and the
counts are joined back, the hashes that very many rows share by salted joins.
"""

from __future__ import annotations

import base64
import importlib.util
import itertools
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.positions import current_tokens
from spanloom.util import checkpointed, heavy_keys, lookup_rows, salted_join, spread

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text into pieces before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of a text, and of a piece, that are encoded in one go.
LEAF_TEXT, LEAF_PIECE = 8192, 512
#: A text of more leaves than this, and a piece of more code points than that, is encoded by so many threads.
THREADED, PARALLEL, THREADS = 8, 16_384, 4
#: Sentences of a text that are made in one task.
BLOCK = 64


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """The place of a public vocabulary: in ``folder``, else in $TOKENIZERS, else where the package of vocabularies is installed."""
    folder = folder or os.environ.get("TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


class Kinds:
    """What a character is to the pattern: L, N, S (space) or P (others), by asking the library itself, whose Unicode version may be another than Python's.

    A vocabulary of single bytes, and of such pairs as begin with a letter, a digit or a line end, shows by the merge of a pair that both are in one piece.
    """

    def __init__(self):
        ranks = {bytes([b]): b for b in range(256)} | {bytes([ord(c), b]): 256 + 256 * i + b for i, c in enumerate("a1\n") for b in range(256)}
        self._pairs = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._known: dict[str, str] = {}

    def __call__(self, c: str) -> str:
        kind = self._known.get(c)
        if kind is None:
            kind = next((k for k, first in (("L", "a"), ("N", "1"), ("S", "\n")) if self._pairs.encode_ordinary(first + c)[0] > 255), "P")
            self._known[c] = kind
        return kind


class Encoder:
    """Ids of texts by a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}
        self._one = self._bpe._core_bpe.encode_single_piece
        self._pattern = regex.compile(PATTERN)
        self._kind = Kinds()

    def __call__(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for null and empty texts."""
        if not text:
            return []
        if len(text) <= LEAF_TEXT:
            return self._bpe.encode_ordinary(text)
        leaves = list(self._leaves(text, 0, len(text)))
        if len(leaves) <= THREADED:
            return list(itertools.chain.from_iterable(map(self._leaf, leaves)))
        with ThreadPoolExecutor(THREADS) as pool:
            return list(itertools.chain.from_iterable(pool.map(self._leaf, leaves)))

    def _ends_piece(self, text: str, i: int) -> bool:
        """Whether a piece ends before text[i], whatever stands around."""
        a, b = self._kind(text[i - 1]), self._kind(text[i])
        return a != b and a != "S" and not (text[i - 1] == "'" and b == "L")

    def _leaves(self, text: str, a: int, b: int) -> Iterator[str]:
        """Parts of text[a:b] between places that always end a piece; a part of more than a leaf has none inside."""
        if b - a <= LEAF_TEXT:
            yield text[a:b]
            return
        middle = (a + b) // 2
        right = next((i for i in range(middle, b) if self._ends_piece(text, i)), b)
        if right - middle <= LEAF_TEXT // 2 and right < b:
            yield from self._leaves(text, a, right)
            yield from self._leaves(text, right, b)
            return
        left = next((i for i in range(middle - 1, a, -1) if self._ends_piece(text, i)), a)
        if left > a:
            yield from self._leaves(text, a, left)
        yield text[left:right]
        if right < b:
            yield from self._leaves(text, right, b)

    def _leaf(self, text: str) -> list[int]:
        if len(text) <= LEAF_TEXT:
            return self._bpe.encode_ordinary(text)
        # the pieces, found with a plain character of its kind for each that is not ASCII
        plain = {ord(c): {"L": "q", "N": "1", "S": "\n", "P": "!"}[self._kind(c)] for c in set(text) if not " " <= c <= "~"}
        return list(itertools.chain.from_iterable(self.piece(text[m.start() : m.end()]) for m in self._pattern.finditer(text.translate(plain))))

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece of the pattern, by tree concatenation if it is long, its parts in parallel if it is very long.

        Any part of a piece that ends at a character is one piece by itself too.
        """
        if len(piece) <= PARALLEL:
            return self._tree(piece)
        size = -(-len(piece) // (2 * THREADS))
        with ThreadPoolExecutor(THREADS) as pool:
            parts = list(pool.map(self._tree, [piece[i : i + size] for i in range(0, len(piece), size)]))
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def _tree(self, piece: str) -> list[int]:
        if len(piece) <= LEAF_PIECE:
            return self._bpe.encode_ordinary(piece)  # other threads run meanwhile
        middle = len(piece) // 2
        return self.join(self._tree(piece[:middle]), self._tree(piece[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of what ``left`` and ``right`` encode, one after the other, as one piece."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            seam = self._one(b"".join(self._bytes[i] for i in a + b))
            if (k >= len(left) or seam[0] == a[0]) and (k >= len(right) or seam[-1] == b[-1]):
                return left[:-k] + seam + right[k:]
            k *= 2


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file, once per process."""
    return Encoder(path)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens; null and empty texts have an empty list.

    ``vocabulary`` is the path of a rank file. Strings that look like special tokens are ordinary text. Repeated rows stay; other
    columns are not carried over. One pass, no shuffle.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids = [encode(x) for x in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["__key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"__key {kind}, ids array<int>").withColumnRenamed("__key", key)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (h, text) whose h this task hasn't met."""
    met: set[bytes] = set()
    for batch in batches:
        keep = []
        for h in batch.column(0).to_pylist():
            keep.append(h not in met)
            met.add(h)
        yield batch.filter(pa.array(keep, pa.bool_()))


def distinct_counts(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(h, n_tokens) of (h, text), each distinct text encoded once; null texts have no row.

    Repeats are dropped in the tasks that read them, so that a text that stands in very many rows goes on from each task at most once. Nothing is sorted.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in _first_of_each(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(x)) for x in batch.column(1).to_pylist()], pa.int64())], names=["h", "n_tokens"])

    first = df.select("h", "text").where("text is not null").mapInArrow(_first_of_each, "h binary, text string")
    return first.repartition("h").mapInArrow(run, "h binary, n_tokens long")


def hashed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``h``, a hash of 128 bits of the whole text; null for a null text."""
    return df.withColumn("h", F.unhex(F.md5(F.col(text))))


def slice_columns(df: DataFrame) -> DataFrame:
    """``df`` with lang as its first part in lower case and source in lower case, both without blanks at their ends."""
    return df.withColumn("lang", F.lower(F.regexp_extract(F.trim("lang"), "^[^-_]*", 0))).withColumn("source", F.lower(F.trim("source")))


def document_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(corpus, text_id, source, lang, domain, n_tokens) of each row of documents; a null text has no tokens."""
    rows = hashed(documents.select("doc_id", "text", "source", "lang", "domain"))
    counts = distinct_counts(rows.select("h", "text"), vocabulary)
    named = slice_columns(rows.drop("text")).withColumn("text_id", F.col("doc_id").cast("string"))
    return salted_join(named, counts, ["h"], heavy_keys(rows, "h"), "left").select(F.lit("documents").alias("corpus"), "text_id", "source", "lang", "domain", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def training_texts(split_assign: DataFrame) -> DataFrame:
    """(text_id, fold_num, train_data_path) of the texts whose latest row in split_assign says train.

    Paths are without blanks at their ends, with plain single slashes and no ``./`` before; a missing one is null.
    """
    latest = split_assign.where("text_id is not null").groupBy("text_id").agg(F.max_by(F.struct("split", "data_path", "fold_num"), F.struct("assigned_at", "split", "data_path", "fold_num")).alias("r")).select("text_id", "r.*")
    path = F.regexp_replace(F.regexp_replace(F.trim("data_path"), r"[\\/]+", "/"), r"^(\./)+", "")
    return latest.where(F.lower(F.trim("split")) == "train").select("text_id", "fold_num", path.alias("train_data_path"))


def train_tokens(annotation: DataFrame, split_assign: DataFrame, task_config: DataFrame, text_meta: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(corpus, text_id, source, lang, domain, n_tokens, train_data_path) of the texts behind the train_data_paths of task_config.

    A text's tokens are those of its sentences, each the current non-null tokens with a space before each. Whole texts are compared by a hash of 128 bits
    over all their sentences and places, which is added up in parts, and only one of equal ones is encoded; its sentences, equal ones once, in
    parts too, so that a text of any size is never in one task. Texts without source in the latest row of text_meta have null; domain is
    null. A training row without path belongs to the released path of its lang and fold_num.
    """
    texts = training_texts(split_assign)
    paths = lookup_rows(task_config.where("released = 1").select("lang", "fold_num", "train_data_path").distinct())
    known = [r.train_data_path for r in lookup_rows(task_config.select("train_data_path").where("train_data_path is not null").distinct())]
    large = heavy_keys(annotation, "text_id")
    rows = salted_join(annotation, texts.select("text_id"), ["text_id"], large, "left_semi").withColumn("__block", F.expr(f"sent_idx div {BLOCK}"))
    tokens = current_tokens(rows, "lang", by=("text_id", "__block")).where("token is not null")
    sentences = tokens.groupBy("text_id", "__block", "sent_idx").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("token_idx", "token"))).alias("t"))
    sentences = checkpointed(hashed(sentences.select("text_id", "sent_idx", "lang", F.concat(F.lit(" "), F.expr("array_join(transform(t, x -> x.token), ' ')")).alias("text"))))
    whole = ["a", "b", "sentences"]
    documents = sentences.groupBy("text_id").agg(F.bit_xor(F.xxhash64("sent_idx", "h")).alias("a"), F.bit_xor(F.xxhash64("h", "sent_idx")).alias("b"), F.count(F.lit(1)).alias("sentences"), F.min("lang").alias("lang"))
    first = checkpointed(documents.groupBy(*whole).agg(F.min("text_id").alias("text_id")))
    spoken = salted_join(sentences, first.select("text_id"), ["text_id"], large, "left_semi")
    uses = spoken.groupBy("text_id", "h").agg(F.count(F.lit(1)).alias("n"))
    counts = salted_join(uses, distinct_counts(spoken.select("h", "text"), vocabulary), ["h"], heavy_keys(sentences, "h"))
    each = first.join(counts.groupBy("text_id").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens")), "text_id").select(*whole, "n_tokens")
    totals = salted_join(documents, each, whole, heavy_keys(documents, *whole)).select("text_id", "lang", "n_tokens")
    sources = text_meta.where("text_id is not null").groupBy("text_id").agg(F.max_by("source", F.struct("catalogued_at", "source")).alias("source"))
    path = F.col("train_data_path")
    for r in paths:
        path = F.when(path.isNull() & (F.col("lang") == r.lang) & (F.col("fold_num") == r.fold_num), r.train_data_path).otherwise(path)
    named = slice_columns(texts.join(totals, "text_id").join(sources, "text_id", "left").withColumn("train_data_path", path))
    return named.where(F.col("train_data_path").isin(known)).select(F.lit("annotation").alias("corpus"), "text_id", "source", "lang", F.lit(None).cast("string").alias("domain"), "n_tokens", "train_data_path")


def token_totals(tokens: DataFrame) -> DataFrame:
    """Per corpus, source, lang and domain: texts and tokens; nulls are slices of their own."""
    return tokens.groupBy("corpus", "source", "lang", "domain").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"))


def document_totals(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """token_totals of document_tokens, by the multiplicity of each distinct text in each slice, so that copies aren't joined one by one."""
    rows = slice_columns(hashed(documents.select("text", "source", "lang", "domain")))
    counts = distinct_counts(rows.select("h", "text"), vocabulary)
    uses = rows.groupBy("h", "source", "lang", "domain").agg(F.count(F.lit(1)).alias("n"))
    per = uses.join(counts, "h", "left").select("source", "lang", "domain", "n", (F.col("n") * F.coalesce("n_tokens", F.lit(0))).alias("t"))
    return per.groupBy(F.lit("documents").alias("corpus"), "source", "lang", "domain").agg(F.sum("n").alias("texts"), F.sum("t").alias("tokens"))
