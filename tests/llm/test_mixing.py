"""Shares and caps of mixtures, and the classifier behind soft membership."""

import random

import numpy as np

from spanloom.llm.mixing import FEASIBLE, SourceModel, _counts, fit_rates, memberships, mixture, moments, reached

DOCUMENTS = "doc_id long, text string, source string, lang string, domain string, repeats int, slice string"
WORDS = {"a": "alder amber apple", "b": "birch butter basil", "c": "cedar clove cumin"}


def corpus(draw, sizes):
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            kind = draw.choice("ab") if source is None else source.strip().lower()
            text = " ".join(draw.choice(WORDS.get(kind, "zinc zebra").split()) for _ in range(draw.randint(5, 40)))
            rows.append((len(rows), text, source, "en", None, 0, "x"))
    return rows


def test_classifier():
    draw = random.Random(2)
    texts = [" ".join(draw.choice(WORDS[k].split()) for _ in range(12)) for k in "abc" * 40]
    model = SourceModel(3).fit(_counts(texts[:90]), [0, 1, 2] * 30)
    odds = model.probabilities(texts[90:])
    assert (odds.argmax(1) == [0, 1, 2] * 10).all() and np.allclose(odds.sum(1), 1, atol=1e-4)
    assert np.allclose(SourceModel(2).fit([], []).probabilities(["x", ""]).sum(1), 1)


def test_mixture(spark):
    draw = random.Random(10)
    rows = corpus(draw, {"a": 400, "A ": 20, "b": 150, "c": 60, "other": 80, None: 30})
    rows += [(10_000, None, "a", "en", None, 0, "x"), (10_001, "", "b", "en", None, 0, "x"), (10_002, None, None, None, None, 0, "x"), (5, rows[5][1], rows[5][2], "en", None, 0, "x")]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    target = spark.createDataFrame([("a", 0.3, 2), ("B", 0.3, 4), ("c", 0.3, 3), ("empty", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture(df, target).cache()
    got = mixed.collect()
    caps = {"a": 2, "b": 4, "c": 3, None: 2}
    assert {r.source for r in got} == {"a", "b", "c", None} and all(1 <= r.repeats <= caps[r.slice] for r in got)
    report = {r.source: r for r in reached(mixed, target.dropna()).collect()}
    for s in "ab":
        assert abs(report[s].share - report["c"].share) < 0.05, report
    assert report["empty"].tokens == 0 and abs(sum(r.share for r in report.values()) - 1) < 1e-9
    assert mixture(df.limit(0), target).count() == mixture(df, target.limit(0)).count() == 0


def test_least_squares(spark):
    draw = random.Random(11)
    df = spark.createDataFrame(corpus(draw, {"a": 100, "b": 100, None: 100}), DOCUMENTS)
    members = memberships(df, ["a", "b"]).cache()
    shares, caps = np.array([0.7, 0.3]), np.array([3.0, 3.0])
    known, pairs = moments(members, 2)
    rates, total, expected = fit_rates(known, pairs, shares, caps, total=4000.0)
    rows, sums = members.collect(), np.zeros(2)
    for r in rows:
        if r.slice is not None:
            sums[r.slice] += rates[r.slice] * r.n_tokens
        else:
            sums += float(np.dot(r.odds, rates)) * r.n_tokens * np.array(r.odds)
    assert total == 4000.0 and np.allclose(sums, expected, rtol=1e-6) and np.abs(sums - total * shares).max() < 10
    assert (fit_rates(np.zeros(0), np.zeros((0, 0)), np.zeros(0), np.zeros(0))[0] == 0).all()


def test_rates_are_least_squares():
    """Against a search over all rates: no other rates within the caps come nearer, also where a source can't be served."""
    draw = np.random.default_rng(3)
    for _ in range(20):
        known, odds, n = draw.integers(0, 500, 2).astype(float), draw.dirichlet([1, 1], 50), draw.integers(1, 30, 50).astype(float)
        pairs, shares, caps = odds.T @ (n[:, None] * odds), draw.dirichlet([1, 1]), draw.integers(1, 4, 2).astype(float)
        rates, total, expected = fit_rates(known, pairs, shares, caps)
        whole = known + pairs.sum(1)
        miss = lambda e: float((((e - total * shares) ** 2) / whole).sum())
        grid = [np.array([a, b]) for a in np.linspace(0, caps[0], 41) for b in np.linspace(0, caps[1], 41)]
        best = min(miss(known * g + pairs @ np.minimum(g, caps.min())) for g in grid)
        assert (rates >= 0).all() and (rates <= caps).all() and miss(expected) <= best * 1.1 + 0.02 * total


def test_scarce_source_does_not_size_the_mixture(spark):
    draw = random.Random(12)
    df = spark.createDataFrame(corpus(draw, {"a": 200, "b": 200, "c": 3, None: 10}), DOCUMENTS)
    target = spark.createDataFrame([("a", 0.6, 4), ("b", 0.2, 4), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    members = memberships(df, ["a", "b", "c"]).cache()
    whole = sum(r.n_tokens for r in members.collect())
    scarce = sum(r.n_tokens for r in members.where("slice = 2").collect())
    got = mixture(df, target).cache()
    report = {r.source: r for r in reached(got, target).collect()}
    assert report["c"].documents == 3 and report["c"].tokens == 3 * scarce and report["c"].share < 0.1  # all it has, cap times over
    sums = {s: sum(r.n_tokens * r.repeats for r in got.where(f"slice = '{s}'").collect()) for s in "ab"}
    assert abs(sums["a"] - 0.6 * whole) < 0.05 * whole and abs(sums["b"] - 0.2 * whole) < 0.05 * whole
    assert report["a"].most_repeats == 2
    assert report["a"].served and not report["c"].served and report["c"].soft_share >= report["c"].share
    # the report against sums over the documents taken
    for i, s in enumerate("abc"):
        soft = sum(r.n_tokens * r.repeats * r.odds[i] for r in got.where("slice is null").collect())
        assert abs(report[s].soft_tokens - soft) < 1e-3 * max(1, soft)
    small = mixture(df, target, total=FEASIBLE).collect()
    assert sum(r.n_tokens * r.repeats for r in small) < 1.3 * 3 * scarce / 0.2 < 0.2 * whole
