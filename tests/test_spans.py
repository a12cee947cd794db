"""Spans, overlaps and scores against plain Python, in both modes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators import score
from spanloom.operators.labels import bare_word, clean_label, first_label, has_tag, iob2, label_ids, tag_columns, vocabulary
from spanloom.operators.match import matching, overlap_join, partial_lists
from spanloom.operators.spans import begin_spans, chained_spans, inclusive_spans, parse_span, token_spans

TOKENS = "text_id string, sent_idx int, token_idx int, token string, gold string, pred string, start int, label string"


def sentences(draw, n=160):
    out = {}
    for i in range(n):
        out[f"t{i % 9}", i // 9 + 1] = [(draw.choice(["O", "O", "B-X", "I-X", "B-Y", "I-Y"]), draw.choice(["O", "B-X", "I-X", "B-Y", "I-Y"])) for _ in range(draw.randint(1, 9))]
    out["t0", 1] = [("B-X", "B-X"), ("I-X", "O")]
    out["t0", 2] = [("I-X", "B-X"), ("I-Y", "I-Y"), ("B-Y", "B-Y")]
    return out


def rows_of(sents):
    return [(t, s, k + 1, f"w{k}", g, p, 0, "") for (t, s), pairs in sents.items() for k, (g, p) in enumerate(pairs)]


def plain_spans(sents, side, mode="corrected"):
    out = set()
    final = max(sents)
    for (t, s), pairs in sents.items():
        labels, mine = [p[side] for p in pairs], []
        for k, x in enumerate(labels):
            before = labels[k - 1] if k else "O"
            if x != "O" and (x[0] == "B" or before == "O" or before[2:] != x[2:]):
                mine.append([k, k + 1, x[2:]])
            elif x != "O":
                mine[-1][1] = k + 1
        for a, b, x in mine:
            if mode == "corrected" or b < len(labels) or (t, s) == final:
                out.add((t, s, a + 1, b + 1, " ".join(f"w{k}" for k in range(a, b)), x))
    return out


@pytest.fixture(scope="module")
def data(spark):
    sents = sentences(random.Random(1))
    df = spark.createDataFrame(rows_of(sents), TOKENS).repartition(3).cache()
    return sents, df


def test_spans(spark, data):
    sents, df = data
    for side, name in ((0, "gold"), (1, "pred")):
        for mode in ("corrected", "faithful"):
            assert {tuple(r) for r in token_spans(df, name, mode).collect()} == plain_spans(sents, side, mode)
    assert {tuple(r) for r in inclusive_spans(df, "gold", ("Y",)).collect()} == {(t, s, a, b - 1, x) for t, s, a, b, _, x in plain_spans(sents, 0) if x == "X"}
    for mode in ("corrected", "faithful"):
        want = set()
        for (t, s), pairs in sents.items():
            labels = [g for g, _ in pairs]
            for k, x in enumerate(labels):
                if x[0] == "B":
                    stop = next((j for j in range(k + 1, len(labels)) if labels[j][0] != "I"), len(labels) if mode == "corrected" else len(labels) - 1)
                    want.add((t, s, k, stop, x[2:]))
        assert {tuple(r) for r in begin_spans(df, "gold", mode).collect()} == want
    assert token_spans(df.limit(0), "gold").count() == token_spans(df.limit(0), "gold", "faithful").count() == 0
    bad = spark.createDataFrame([("no key",)], "k string").select(parse_span(F.col("k")).alias("s"))
    with pytest.raises(Exception, match="no span"):
        bad.collect()


def test_round_trip(spark, data):
    sents, df = data
    spans = token_spans(df, "gold").withColumn("n", F.monotonically_increasing_id())
    inside = df.alias("d").join(spans.alias("s"), (F.col("d.text_id") == F.col("s.text_id")) & (F.col("d.sent_idx") == F.col("s.sent_idx")) & (F.col("d.token_idx") >= F.col("s.start")) & (F.col("d.token_idx") < F.col("s.end")), "left")
    typed = inside.select("d.text_id", "d.sent_idx", "d.token_idx", "d.token", F.col("s.label").alias("tag"), F.col("s.n").alias("number"))
    assert {tuple(r) for r in token_spans(iob2(typed, "tag", "number", "again"), "again").collect()} == plain_spans(sents, 0)


def test_overlaps_and_scores(spark, data):
    sents, df = data
    gold, pred = token_spans(df, "gold"), token_spans(df, "pred")
    g, p = plain_spans(sents, 0), plain_spans(sents, 1)
    for mode, touch in (("corrected", 0), ("faithful", 1)):
        got = overlap_join(gold, pred, mode)
        pairs = [(a, b) for a in g for b in p if a[:2] == b[:2] and a[5] == b[5] and max(a[2], b[2]) < min(a[3], b[3]) + touch]
        met = {a for a, _ in pairs} | {("p", *b) for _, b in pairs}
        want = Counter("exact" if a == b else "partial" for a, b in pairs) + Counter(miss_pred=sum(a not in met for a in g), miss_test=sum(("p", *b) not in met for b in p))
        assert Counter(r.match_type for r in got.collect()) == want
        assert got.select("test_start", "test_end").count() == sum(want.values())
        frame = {r.label: r for r in score.match_frame(got, gold, pred).collect()}
        for label in "XY":
            n = Counter("exact" if a == b else "partial" for a, b in pairs if a[5] == label)
            r, t, q = frame[label], sum(a[5] == label for a in g), sum(b[5] == label for b in p)
            assert (r.test_freq, r.pred_freq, r.exact_freq, r.partial_freq, r.missing) == (t, q, n["exact"], n["partial"], t - n["exact"] - n["partial"])
            assert abs(r.exact_prec - n["exact"] / q) < 1e-12 and abs(r.lenient_rec - (n["exact"] + n["partial"]) / t) < 1e-12
        assert frame["Overall"].test_freq == len(g) and frame["Overall"].pred_freq == len(p)
        scores = {r.label: r for r in score.strict_lenient(score.match_frame(got, gold, pred)).collect()}
        assert abs(scores["macro_avg"].exact_f1 - (frame["X"].exact_f1 + frame["Y"].exact_f1) / 2) < 1e-12
        assert all(r.exact_prec <= r.lenient_prec for r in scores.values())
        by_span = {r.label: r for r in score.match_frame(got, gold, pred, count="spans").collect()}
        assert all(0 <= r.lenient_rec <= 1 and r.missing >= 0 for r in by_span.values())
    both, gold_only, pred_only = matching(gold, pred)
    printed = lambda x: {a[:5] for a in x}
    assert both.count() == sum(b[:5] in printed(g) for b in p) and gold_only.count() == sum(a[:5] not in printed(p) for a in g)
    a, b = {x for x in g if x[:5] not in printed(p)}, {x for x in p if x[:5] not in printed(g)}
    touching = sum(x[:2] == y[:2] and y[3] >= x[2] and x[3] >= y[2] for x in a for y in b)
    assert partial_lists(pred_only, gold_only).select(F.sum(F.size("gold"))).first()[0] == touching
    across = sum(x[1] == y[1] and y[3] >= x[2] and x[3] >= y[2] for x in a for y in b)
    assert partial_lists(pred_only, gold_only, "faithful").select(F.sum(F.size("gold"))).first()[0] == across
    empty = score.match_frame(overlap_join(gold.limit(0), pred), gold.limit(0), pred)
    row = empty.where("row_kind = 'overall'").first()
    assert row.exact_rec is None and row.exact_f1 is None and row.exact_prec == 0
    assert {r.label: r.precision_strict for r in score.legacy_score(gold, pred.limit(0)).collect()} == {"X": 0.0, "Y": 0.0}
    old = {r.label: r for r in score.legacy_score(gold.limit(0), pred).collect()}
    assert old["X"].recall_strict is None and old["X"].f1_strict is None and old["X"].precision_strict == 0.0


def test_chains(spark):
    rows = [("t", 1, 1, 2, "a", "RES"), ("t", 1, 2, 3, "b", "X"), ("t", 1, 3, 4, "c", "RES"), ("t", 1, 5, 6, "d", "X"), ("t", 2, 4, 5, "e", "X"), ("u", 1, 4, 5, "f", "RES"), ("u", 1, 5, 7, "g", "Y")]
    df = spark.createDataFrame(rows, "text_id string, sent_idx int, start int, end int, text string, label string")
    got = {(r.text_id, r.start, r.end, r.text, tuple(r.labels)) for r in chained_spans(df, "RES").collect()}
    assert got == {("t", 1, 3, "a b", ("RES", "X")), ("t", 3, 4, "c", ("RES",)), ("u", 4, 7, "f g", ("RES", "Y"))}


def test_golden_token_counts(spark):
    """A worked example: counts of tokens with I- merged into B-."""
    names = ["@@unkORpad@@", "O", "B-Time", "I-Time", "B-Quality", "I-Quality"]
    gold, pred = [1, 1, 2, 3, 3, 3, 1, 1, 4, 5, 5], [1, 1, 1, 2, 3, 3, 1, 1, 1, 4, 5]
    df = spark.createDataFrame([(names[a], names[b]) for a, b in zip(gold, pred)], "gold string, pred string")
    counts = score.token_counts(df, "gold", "pred")
    assert {r.label: (r.tp, r.fp, r.fn) for r in counts.collect()} == {"O": (4, 2, 0), "B-Time": (3, 0, 1), "B-Quality": (2, 0, 1)}
    vocab = spark.createDataFrame(list(zip(names, range(6))), "label string, id int")
    faithful = {r.label: r.f1 for r in score.f1_macro(counts, vocab, "faithful").collect()}
    assert set(faithful) == {"O", "B-Time", "I-Time", "B-Quality", "macro"} and faithful["I-Time"] == 0
    micro = score.f1_micro(counts).first()
    assert micro.precision == micro.recall == 9 / 11
    assert score.f1_micro(counts.limit(0)).first().f1 == 0
    assert score.metric(df.limit(0), "accuracy").first().accuracy is None
    with pytest.raises(ValueError, match="no metric"):
        score.metric(df, "bleu")


def test_small_label_functions(spark):
    df = spark.createDataFrame([("B-I-a\\_b|c", "naïve", "A|B[3]"), ("O", "é", "_"), ("x", "??", None)], "l string, w string, labels string")
    rows = df.select(clean_label(F.col("l")).alias("c"), bare_word(F.col("w")).alias("w"), first_label(F.col("labels"), ["B", "A"]).alias("f")).collect()
    assert [tuple(r) for r in rows] == [("B-a_b", "nave", "B"), ("O", "é", "O"), ("x", " ", "O")]
    vocab = vocabulary(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0)], "label string, at int"), "label", ["at"], "?")
    assert {r.label: r.id for r in vocab.collect()} == {"?": 0, "b": 1, "a": 2}
    ids = label_ids(spark.createDataFrame([("a",), ("z",), (None,)], "label string"), "label", vocab, "b")
    assert sorted(r.label_id for r in ids.collect()) == [1, 1, 2]
    assert tag_columns(["a", "b"], "SINGLETASK") == [["a", "b"]] and has_tag is not None
    with pytest.raises(ValueError, match="task_type"):
        tag_columns(["a"], "OTHER")
