"""Pieces keep every token, respect limits and overlap, and end at sentences where they can."""

import random

from spanloom.llm.pieces import cut_places, oversized, placed_letters, split_oversized

SCHEMA = "anno_id long, text_id string, lang string, sent_idx int, token_idx int, token string, edited_at timestamp, start int"


def corpus(draw, texts):
    rows, words = [], {}
    for text, sizes in texts.items():
        words[text] = [(s + 1, f"{text}{s}-{k}" if k % 5 else ",") for s, n in enumerate(sizes) for k in range(n)]
        k = {}
        for s, w in words[text]:
            k[s] = k.get(s, 0) + 1
            for _ in range(draw.choice([1, 1, 1, 2])):
                rows.append((len(rows), text, "xx" if text == "other" else "de", s, k[s], w, None, 7))
    draw.shuffle(rows)
    return rows, words


def taken(sents, words, most):
    """What a plain walk takes: the most that ends a sentence, else a clause, else ``most``."""
    fits = range(1, min(most, len(sents)) + 1)
    sentence = [n for n in fits if n == len(sents) or sents[n] != sents[n - 1]]
    clause = [n for n in fits if words[n - 1] == ","]
    return max(sentence or clause or fits)


def test_pieces(spark):
    draw = random.Random(3)
    texts = {"short": [3, 4], "exact": [10], "eleven": [11], "long": [draw.randint(1, 9) for _ in range(400)], "one": [700], "mixed": [3, 50, 2, 2, 90, 1] * 9, "other": [30]}
    rows, words = corpus(draw, texts)
    rows += [(10**6, None, "de", 1, 1, "x", None, 7), (10**6 + 1, "short", "de", None, 1, "x", None, 7)]
    limits = spark.createDataFrame([("de", 10, 2), ("en", 6, 5), (None, 1, 1)], "lang string, max_tokens int, overlap_tokens int")
    df, seen = spark.createDataFrame(rows, SCHEMA), []
    for section, block, run in ((1, 3, 7), (100, 64, 4096), (4096, 64, 4096)):
        pieces = split_oversized(df, limits, section, block, run).cache()
        seen.append(sorted((p.text_id, p.start, p.overlap, p.tokens, p.sentences) for p in pieces.collect()))
        assert seen[-1] == seen[0]  # one walk over the whole text, however the work is split
        assert {tuple(r) for r in oversized(cut_places(placed_letters(df, limits, block, run), section)).collect()} == {tuple(r) for r in oversized(pieces).collect()}
        got = {}
        for p in pieces.collect():
            got.setdefault(p.text_id, []).append(p)
        assert set(got) == set(texts)
        for text, ps in got.items():
            ps.sort(key=lambda p: p.start)
            size, ov = (6, 2) if text == "other" else (10, 2)
            flat = [w for _, w in words[text]]
            at = 0
            for p in ps:
                new = p.tokens[p.overlap :]
                assert p.start == at and len(p.tokens) <= size and p.overlap == min(ov, at)
                assert p.tokens == flat[at - p.overlap : at + len(new)]
                assert sum(s.new_tokens for s in p.sentences) == len(new)
                size_new, left = size - p.overlap, [s for s, _ in words[text]][at:]
                assert len(new) == taken(left, [w for _, w in words[text]][at:], size_new)
                at += len(new)
                if at < len(flat):
                    span = [s for s, _ in words[text]][p.start : p.start + size - p.overlap + 1]
                    ends = any(a != b for a, b in zip(span, span[1:]))
                    assert not ends or words[text][at - 1][0] != words[text][at][0]
            assert at == len(flat)
        found = {tuple(r) for r in oversized(pieces).collect()}
        want = {(t, 0) for t, n in texts.items() if sum(n) > (6 if t == "other" else 10)} | {(t, s + 1) for t, ns in texts.items() for s, n in enumerate(ns) if n > (6 if t == "other" else 10)}
        assert found == want


def test_no_rows(spark):
    limits = spark.createDataFrame([("de", 10, 2)], "lang string, max_tokens int, overlap_tokens int")
    assert split_oversized(spark.createDataFrame([], SCHEMA), limits).count() == 0
