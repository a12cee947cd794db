"""Walks, folds and array operators on small cases."""

import random

from pyspark.sql import functions as F

from spanloom.operators import arrays, folds, sequences
from spanloom.operators.positions import current_tokens, running_totals


def test_walks(spark):
    draw = random.Random(4)
    rows = [(draw.choice("abc"), i, draw.randint(0, 30)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, n int").repartition(4)

    def plain(step):
        out = {}
        for k in "abc":
            state = step()
            for _, i, n in sorted(r for r in rows if r[0] == k):
                out[k, i] = state(n)
        return out

    def batches(limit, words, faithful):
        def make():
            s = {"g": 0, "c": 0, "w": 0}

            def walk(n):
                if s["c"] and (s["c"] >= limit or s["w"] + n > words):
                    s.update(g=s["g"] + 1, c=0, w=0 if faithful else n)
                else:
                    s["w"] += n
                s["c"] += 1
                return s["g"]

            return walk

        return make

    for mode in ("corrected", "faithful"):
        got = sequences.reset_groups(df, ["k"], ["i"], "n", sequences.batch_rule(7, 90, mode))
        assert {(r.k, r.i): r.group_id for r in got.collect()} == plain(batches(7, 90, mode == "faithful"))
    assert sequences.reset_groups(df.limit(0), ["k"], ["i"], "n", sequences.chunk_rule(5)).count() == 0


def test_totals(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), i, draw.randint(0, 9)) for i in range(500)]
    got = running_totals(spark.createDataFrame(rows, "k string, o int, n int").where("k is not null"), "k", "o", "n", span=7)
    for r in got.collect():
        assert r.before == sum(n for k, o, n in rows if k == r.k and o < r.o) and r.total == sum(n for k, o, n in rows if k == r.k)


def test_greedy_folds(spark):
    texts = spark.createDataFrame([(f"t{i}", i % 7) for i in range(200)], "text_id string, n int")
    got = {r.text_id: r.fold_id for r in folds.greedy_folds(texts, 5, 1).collect()}
    import hashlib

    total, s, fold, want = sum(i % 7 for i in range(200)) / 5, 0, 0, {}
    for i in sorted(range(200), key=lambda i: (hashlib.md5(f"1|t{i}".encode()).hexdigest(), f"t{i}")):
        want[f"t{i}"] = fold
        s += i % 7
        if s >= total:
            s, fold = 0, min(fold + 1, 4)
    assert got == want and set(got.values()) == {0, 1, 2, 3, 4}
    assert folds.greedy_folds(texts.limit(0), 5, 1).count() == 0
    roles = folds.fold_roles(spark.createDataFrame([("t", 3)], "text_id string, fold_id int")).collect()
    assert {(r.fold_num, r.split) for r in roles} == {(0, "train"), (1, "test"), (2, "dev"), (3, "train"), (4, "train")}


def test_samples_are_nested(spark):
    df = spark.createDataFrame([("t", i) for i in range(50)], "text_id string, sent_idx int")
    parts = [{r.sent_idx for r in folds.downsample(df, f, 2629).collect()} for f in (0.2, 0.4, 0.8)]
    assert [len(p) for p in parts] == [10, 20, 40] and parts[0] < parts[1] < parts[2]


def test_arrays(spark):
    one = spark.createDataFrame([([None, 0, 0, 1, None], [7, 8], ["a</w>", "", "b", "##c"])], "w array<int>, l array<int>, p array<string>")
    r = one.select(
        arrays.align_labels(F.col("w"), F.col("l")).alias("first"),
        arrays.align_labels(F.col("w"), F.col("l"), True).alias("every"),
        arrays.first_subwords(F.col("w"), F.array(*(F.lit(i) for i in range(5)))).alias("back"),
        arrays.subtoken_marks(F.col("p")).alias("marks"),
        arrays.gather(F.col("l"), F.array(F.lit(1), F.lit(5))).alias("gathered"),
        arrays.space_places(F.lit("ab c def")).alias("places"),
        arrays.nearest_places(F.array(F.lit(2), F.lit(5), F.lit(99)), F.array(F.lit(2), F.lit(4), F.lit(9))).alias("near"),
        arrays.render_top(arrays.top_n(F.array(F.lit("NOUN"), F.lit("VERB"), F.lit("?")), F.array(F.lit(0.5), F.lit(0.3), F.lit(0.9)), 5, "?")).alias("top"),
        arrays.best_label(F.array(F.lit(9.0), F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("best"),
        arrays.parts_of(F.array(F.lit(1), F.lit(2), F.lit(3)), 4).alias("parts"),
        arrays.padded(F.array(F.lit(1)), 3).alias("padded"),
    ).first()
    assert r["first"] == [-100, 7, -100, 8, -100] and r.every == [-100, 7, 7, 8, -100] and r.back == [1, 3]
    assert r.marks == ["a", "##b", "##c"] and r.gathered == [8, None] and r.places == [2, 3] and r.near == [0, 1, 2]
    assert r.top == "NOUN=0.5|VERB=0.3" and r.best == 2 and r.parts == [[1, 2], [3]] and r.padded == [1, 0, 0]


def test_current_tokens(spark):
    rows = [(1, "t", 1, 1, "a", None), (2, "t", 1, 1, "b", None), (3, "t", 1, None, "c", None), (4, None, 1, 1, "d", None), (5, "t", 1, 2, None, None)]
    df = spark.createDataFrame(rows, "anno_id long, text_id string, sent_idx int, token_idx int, token string, edited_at timestamp")
    assert sorted((r.token_idx, r.token) for r in current_tokens(df).collect()) == [(1, "b"), (2, None)]
    assert current_tokens(df.limit(0), by=("text_id",)).count() == 0


def test_packed_batches_like_a_walk(spark):
    draw = random.Random(21)
    rows = [(key, i, draw.choice([0, 1, 2, 3, 9, 40, None]), "x") for key, n in (("a", 700), ("b", 30), (None, 100), ("c", 1)) for i in range(n)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, n int, k string")
    for mode in ("corrected", "faithful"):
        for limit, words in ((4, 20), (1, 5), (16, 1000)):
            walked = {(r.g, r.o): r.batch_id for r in sequences.reset_groups(df, ["g"], ["o"], "n", sequences.batch_rule(limit, words, mode), "batch_id").collect()}
            for section in (1, 50, 4096):
                got = {(r.g, r.o): r.batch_id for r in sequences.packed_batches(df, ["g"], ["o"], "n", limit, words, mode, section=section).collect()}
                assert got == walked, (mode, limit, words, section)
    assert sequences.packed_batches(df.limit(0), ["g"], ["o"], "n", 4, 20).count() == 0


def test_samples_by_rank(spark):
    import hashlib

    rows = [(g, f"t{i}", i) for g in ("a", None) for i in range(300)] + [("b", "t", 1)]
    df = spark.createDataFrame(rows, "g string, text_id string, sent_idx int")
    for by in ((), ("g",)):
        want = set()
        for g in {r[0] if by else 0 for r in rows}:
            mine = sorted(((hashlib.md5(f"5|{t}|{i}".encode()).hexdigest(), t, i, x) for x, t, i in rows if not by or x == g), key=lambda r: r[:3])
            want |= {(x, t, i) for _, t, i, x in mine[: int(0.3 * len(mine))]}
        got = [(r.g, r.text_id, r.sent_idx) for r in folds.downsample(df, 0.3, 5, *by, digits=1).collect()]
        assert len(got) == len(want) if by else len(got) == int(0.3 * len(rows))
        if by:
            assert set(got) == want


def test_terms_told_apart(spark):
    tokens = spark.createDataFrame([("t", 1, 1, "See", "see", "VERB"), ("t", 1, 2, "see", "sea", "NOUN"), ("t", 1, 3, "see", "see", "VERB"), ("t", 1, 4, ",", ",", "X")], "text_id string, sent_idx int, token_idx int, token string, lemma string, pos string")
    got = {(r.term, r.lemma, r.pos, r.n) for r in sequences.chunk_terms(tokens, 10, also=("lemma", "pos")).collect()}
    assert got == {("see", "see", "VERB", 2), ("see", "sea", "NOUN", 1)}
