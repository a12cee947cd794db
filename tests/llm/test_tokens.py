"""Ids against two libraries, and totals against plain sums."""

import os
import random
from collections import Counter
from datetime import datetime

import pytest
import tiktoken
from tokenizers import Tokenizer

from spanloom.llm.tokens import Encoder, Kinds, document_tokens, document_totals, encode_texts, slice_columns, token_totals, train_tokens, vocabulary_path
from spanloom.util import heavy_keys

DOCUMENTS = "doc_id long, text string, source string, lang string, domain string, ids int, h string, n_tokens int"


def texts():
    draw = random.Random(9)
    words = ["smell", "Geruch", " ", "  ", "\n", "\r\n", "'s", "'", "''", "don't", "１２", "123", "é", "漢字", "😷", "<|endoftext|>", "\x1c", "\xa0", "­", ".", "—", "ſ"]
    out = ["".join(draw.choice(words) for _ in range(n)) for n in [1, 3, 9, 30, 100] * 20 + [5000] * 6]
    out += [c * n for c in ("a", "ab", "xyzzy", " ", "'", "'s", "\n ", "漢", "é1", "?!", "\x1c") for n in (511, 9000)]
    out += ["".join(draw.choice("abcdefghij") for _ in range(30_000)), "".join(draw.choice("etaoin") for _ in range(20_000)) + " tail", "x" * 9000 + "'s" * 5000 + " " * 9000 + "y"]
    out += ["".join(draw.choice("ab \n'1") for _ in range(40_000)), "w" * 8191 + " " + "w" * 8200, "the smell of it " * 9000]
    out += [c * 9000 + x + c * 9000 for c in ("ab", "漢", "5") for x in ("\x1c", "\u0378", "\U000e0fff", "\u2028", "\ufffd")]
    out += ["".join(draw.choice("abcdefghijkl") for _ in range(50_000)), "é" * 40_000, "!?" * 20_000 + "'s" * 9000, "\u00a0\u2003" * 20_000 + "x"]
    return out


def test_ids_like_two_libraries(spark):
    encode = Encoder(vocabulary_path())
    plain = encode._bpe
    other = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    assert isinstance(plain, tiktoken.Encoding)
    for x in texts():
        ids = encode(x)
        assert ids == plain.encode_ordinary(x)
        if len(x) < 20_000:
            assert ids == other.encode(x, add_special_tokens=False).ids
    for n in range(20):
        piece = "".join(random.Random(n).choices("etaoinshré漢", k=4000))
        assert encode.piece(piece) == plain._core_bpe.encode_single_piece(piece.encode())
    assert encode(None) == encode("") == []


def test_kinds_of_characters():
    """What the library takes a character for, also where it has no category here."""
    kind = Kinds()
    assert "".join(map(kind, "aé漢ſ1２½ \n\xa0\u2028.!'\x1c\u0301😷_")) == "LLLLNNNSSSSPPPPPPP"
    assert kind("\u0378") in "LNSP"


def test_totals_from_ids(spark):
    """Totals of documents against the ids of each."""
    folder = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    documents = spark.read.parquet(folder)
    n = {r.doc_id: len(r.ids) for r in encode_texts(documents).collect()}
    want = Counter()
    for r in slice_columns(documents).collect():
        want[r.source, r.lang, r.domain, "texts"] += 1
        want[r.source, r.lang, r.domain, "tokens"] += n[r.doc_id]
    got = Counter()
    for r in document_totals(documents).collect():
        got[r.source, r.lang, r.domain, "texts"], got[r.source, r.lang, r.domain, "tokens"] = r.texts, r.tokens
    assert got == want and sum(n.values()) > 10_000
    tokens = document_tokens(documents).collect()
    assert {int(r.text_id): r.n_tokens for r in tokens} == n


def test_copies_of_whole_texts(spark, monkeypatch):
    """Equal annotation texts are encoded once and counted each; whatever is salted."""
    day = datetime(2024, 1, 1)
    rows = [(i, f"t{t}", "de", s, k, f"w{(t % 3) * s + k}", day) for i, (t, s, k) in enumerate((t, s, k) for t in range(9) for s in range(1, 200) for k in range(1, 4))]
    annotation = spark.createDataFrame(rows, "anno_id long, text_id string, lang string, sent_idx int, token_idx int, token string, edited_at timestamp")
    assign = spark.createDataFrame([(f"t{t}", 0, "train", "de/0.tsv", day) for t in range(9)], "text_id string, fold_num int, split string, data_path string, assigned_at timestamp")
    config = spark.createDataFrame([("de", 0, "de/0.tsv", 1)], "lang string, fold_num int, train_data_path string, released int")
    meta = spark.createDataFrame([], "text_id string, source string, catalogued_at timestamp")
    encode = Encoder(vocabulary_path())
    want = {f"t{t}": sum(len(encode("".join(f" w{(t % 3) * s + k}" for k in range(1, 4)))) for s in range(1, 200)) for t in range(9)}
    assert {r.text_id: r.n_tokens for r in train_tokens(annotation, assign, config, meta).collect()} == want
    monkeypatch.setattr("spanloom.llm.tokens.heavy_keys", lambda df, *key: heavy_keys(df, *key, least=2))
    assert {r.text_id: r.n_tokens for r in train_tokens(annotation, assign, config, meta).collect()} == want
    assert sorted(r.n_tokens for r in document_tokens(spark.createDataFrame([(i, "a smell" if i % 2 else None, "s", "en", "d", 0, "", 0) for i in range(50)], DOCUMENTS)).collect()) == [0] * 25 + [len(encode("a smell"))] * 25


def test_rows(spark):
    rows = [(1, "a smell", "S ", "en-EN", "d", 0, "", 0), (1, "a smell", "S ", "en-EN", "d", 0, "", 0), (2, "a smell", "s", "EN", "d", 0, "", 0), (3, None, None, None, None, 0, "", 0), (4, "", "s", "de", None, 0, "", 0)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    n = len(got[1])
    assert n > 1 and got == {1: got[1], 2: got[1], 3: [], 4: []}
    tokens = document_tokens(df)
    assert sorted((r.text_id, r.source, r.lang, r.n_tokens) for r in tokens.where("text_id <> '3'").collect()) == [("1", "s", "en", n)] * 2 + [("2", "s", "en", n), ("4", "s", "de", 0)]
    totals = {tuple(r) for r in document_totals(df).collect()}
    assert totals == {("documents", "s", "en", "d", 3, 3 * n), ("documents", None, None, None, 1, 0), ("documents", "s", "de", None, 1, 0)}
    assert totals == {tuple(r) for r in token_totals(tokens).collect()}
    assert encode_texts(df.limit(0)).count() == document_tokens(df.limit(0)).count() == document_totals(df.limit(0)).count() == 0


def test_texts_behind_paths(spark):
    day = datetime(2024, 1, 1)
    annotation = spark.createDataFrame([(i, t, lang, s, k, w, day) for i, (t, lang, s, k, w) in enumerate([("a", "de", 1, 1, "Der"), ("a", "de", 1, 2, "Duft"), ("a", "de", 2, 1, "Der"), ("a", "de", 2, 2, "Duft"), ("a", "de", 2, 3, None), ("b", "en", 1, 1, "smell"), ("c", "en", 1, 1, "x")])], "anno_id long, text_id string, lang string, sent_idx int, token_idx int, token string, edited_at timestamp")
    assign = spark.createDataFrame([("a", 0, "train", ".//de\\0.tsv ", day), ("b", 1, "Train", None, day), ("c", 1, "dev", "en/1.tsv", day), ("gone", 0, "train", "de/0.tsv", day)], "text_id string, fold_num int, split string, data_path string, assigned_at timestamp")
    config = spark.createDataFrame([("de", 0, "de/0.tsv", 1), ("en", 1, "en/1.tsv", 1), ("en", 0, "en/0.tsv", 0)], "lang string, fold_num int, train_data_path string, released int")
    meta = spark.createDataFrame([("a", "H", day), ("a", "G", datetime(2025, 1, 1))], "text_id string, source string, catalogued_at timestamp")
    got = {r.text_id: r for r in train_tokens(annotation, assign, config, meta).collect()}
    encode = Encoder(vocabulary_path())
    assert set(got) == {"a", "b"}
    assert (got["a"].source, got["a"].lang, got["a"].n_tokens, got["a"].train_data_path) == ("g", "de", 2 * len(encode(" Der Duft")), "de/0.tsv")
    assert (got["b"].source, got["b"].n_tokens, got["b"].train_data_path) == (None, len(encode(" smell")), "en/1.tsv")
    assert train_tokens(annotation.limit(0), assign, config, meta).count() == 0
