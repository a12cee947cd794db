"""Cleaning, splits, edits over subwords and labels of where words begin, against plain Python."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from spanloom.functions.strings import edit_script
from spanloom.operators import arrays, folds, subwords
from spanloom.plans.subwords import split_rendering


def column(spark, value, kind, made):
    return spark.createDataFrame([(value,)], f"x {kind}").select(made(F.col("x"))).first()[0]


def test_cleaning_and_splits(spark):
    assert column(spark, "a\t b　　 c\x00�d​", "string", subwords.clean_text) == "a b  cd"
    assert column(spark, None, "string", subwords.clean_text) is None and column(spark, "", "string", subwords.pre_tokens) == []
    assert column(spark, "Don't pay 5$, 漢字x!", "string", subwords.pre_tokens) == ["Don", "'", "t", "pay", "5", "$", ",", "漢", "字", "x", "!"]
    shown = lambda w, **k: column(spark, w, "string", lambda c: subwords.with_blanks(c, subwords.script_places(c, **k)))
    assert shown("20s") == "20 s" and shown("abc") == "abc" and shown("xひカy") == "x ひ カ y" and shown("20sひ", changes=False) == "20s ひ"
    assert shown("xひカ", mode="faithful") == "x ひ カ" and column(spark, "カx", "string", lambda c: subwords.script_places(c, mode="faithful")) == [1]
    assert column(spark, ["abc", "de", ""], "array<string>", lambda c: subwords.rendered_splits(c, F.array(*map(F.lit, (4, 1, 2, 3))))) == ["a b c", "d e", ""]
    assert column(spark, [0, 2], "array<int>", lambda c: subwords.split_marks(c, F.lit(4))) == ["split", "merge", "split", "merge"]
    assert subwords.tokenizer_kind(["te", "##st"]) == "wordpiece" and subwords.tokenizer_kind(["▁te"]) == "sentencepiece" and subwords.tokenizer_kind(["te"]) == "other"


def test_rendering_of_a_long_sentence(spark, tmp_path):
    n = 2000
    rows = spark.range(n).selectExpr("id AS anno_id", "'t' AS text_id", "'en' AS lang", "1 AS sent_idx", "int(id) + 1 AS token_idx", "concat('é😀', id % 1000) AS token", "timestamp'2024-01-01' AS edited_at")
    rows.write.parquet(f"{tmp_path}/annotation.parquet")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # 2 seconds, but minutes if each subword looks through all places
    late.start()
    try:
        got = split_rendering(spark, str(tmp_path)).collect()
    finally:
        late.cancel()
    words = [f"é😀{i % 1000}" for i in range(n)]
    begins = {sum(map(len, words[:i])) for i in range(n)}
    assert [r.rendered for r in got] == ["".join(("|" if i % 5 == 0 and i else " " if i in begins and i else "") + c for i, c in enumerate("".join(words)))]


def test_rendering_as_a_walk(spark):
    draw, cases = random.Random(2), []
    for _ in range(200):
        cases.append((["".join(draw.choice("ab é😀\n") for _ in range(draw.choice([0, 1, 2, 5, 9]))) for _ in range(draw.randint(0, 9))], [draw.choice([None, *range(-2, 30)]) for _ in range(draw.randint(0, 12))]))
    got = spark.createDataFrame(cases, "w array<string>, p array<int>").select("w", "p", subwords.rendered_splits(F.col("w"), F.col("p")).alias("r"), subwords.word_places(F.col("w")).alias("e")).collect()
    for row in got:
        start, want = 0, []
        for x in row.w:
            shown = x
            for i in sorted((p - start for p in row.p if p is not None and start < p < start + len(x)), reverse=True):
                shown = shown[:i] + " " + shown[i:]
            want.append(shown)
            start += len(x)
        assert row.r == want and row.e == [sum(len(x.replace(" ", "")) for x in row.w[: i + 1]) for i in range(len(row.w))]


def test_edits_over_subwords(spark):
    draw = random.Random(1)
    for _ in range(300):
        words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 5))]
        target = "".join(draw.choice("abcd") for _ in range(draw.randint(0, 9)))
        got = subwords.edited(edit_script("".join(words), target), words)
        assert "".join(got) == target and len(got) == len(words)
    assert subwords.edited("→-+x→", ["ab", "c"]) == ["ax", "c"] and subwords.edited("+x→→→", ["ab", "c"]) == ["xab", "c"]
    assert subwords.edited("→→-+z", ["ab", "c"]) == ["ab", "z"] and subwords.edited("+x", []) == []
    rows = spark.createDataFrame([("→-", ["ab"]), (None, ["a"])], "s string, w array<string>")
    assert [r[0] for r in rows.select(subwords.edited_subwords("s", "w")).collect()] == [["a"], None]


@pytest.mark.skipif(not os.path.exists(f"{os.environ.get('TOKENIZERS', '/opt/tokenizers')}/{subwords.MODEL}"), reason="no tokenizer here")
def test_subwords_and_labels(spark):
    texts = [(1, "Don't pay 5$ for 20s, 漢字ひら x́ﬁ", ["Don't", "pay", "5", "$", "for", "20", "s,", "漢字", "ひら", "x́ﬁ"]), (2, None, []), (3, "", []), (4, "a\x00b  c", ["a\x00b", "c"])]
    df = spark.createDataFrame(texts, "k int, text string, gold array<string>")
    got = {r.k: r for r in subwords.subword_rows(df, ["k"], "text").collect()}
    for k, text, _ in texts:
        assert "".join(got[k].subwords) == "".join((text or "").split()) and len(got[k].ids) == len(got[k].subwords) and all(got[k].subwords)
    joined = df.join(subwords.subword_rows(df, ["k"], "text"), "k")
    marks = joined.select("k", "gold", "subwords", arrays.nearest_places(subwords.word_places(F.col("gold")), subwords.word_places(F.col("subwords"))).alias("o")).where("k = 1").first()
    ends = ["".join(marks.subwords[: i + 1]) for i in marks.o]
    assert ends[1].endswith("pay") and ends[4].endswith("for")
    learned = {r.word: r.split for r in subwords.learned_splits(spark.createDataFrame([(["abc", "d"], ["abcd"], ["abcd"]), (["a", "bcd"], ["abcd"], ["abcd"]), (["abc", "d"], ["abcd"], ["abcd"])], "gold array<string>, subwords array<string>, words array<string>"), "gold").collect()}
    assert learned == {"abcd": "abc d"}
    again = subwords.subword_rows(spark.createDataFrame([(1, "smells")], "k int, text string"), ["k"], "text", splits={"smells": "sme lls"}).first()
    assert "sme" in ["".join(again.subwords[:i]) for i in range(1, 4)]


def test_draws_and_masks(spark):
    rows = [(g, i) for g, n in (("a", 90), ("b", 10)) for i in range(n)]
    got = folds.batch_draws(spark.createDataFrame(rows, "g string, batch int"), "g", "batch", 0.5, 3).orderBy("draw").collect()
    assert len(got) == 100 and {r.g for r in got} == {"a", "b"}
    for g, n in (("a", 90), ("b", 10)):
        mine = [r.batch for r in got if r.g == g]
        assert mine == [i % n for i in range(len(mine))]
    assert 10 < sum(r.g == "b" for r in got) < 45  # a quarter by smoothed size, a tenth by size
    masked = folds.masked_ids(spark.range(20_000).withColumn("t", F.lit(5)), "t", 0.15, 1, 103, 50, "id").collect()
    chosen = [r for r in masked if r.label_id != -100]
    assert abs(len(chosen) - 3000) < 200 and all(r.input_id == 5 for r in masked if r.label_id == -100)
    assert abs(sum(r.input_id == 103 for r in chosen) / len(chosen) - 0.8) < 0.03 and all(r.input_id < 50 or r.input_id == 103 for r in chosen)
