"""Groups against union-find, and the shares of splits."""

import random
from collections import Counter, defaultdict

from spanloom.llm.groups import allotted, assign_groups, components, text_groups

META = "text_id string, author_id string, work_id string, n int, key string"


def joined(rows):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for t, a, w in rows:
        for k in ([("a", a.lower().replace("-", "").replace(" ", ""))] if a and any(c in "123456789" for c in a) else []) + ([("w", w)] if w is not None else []):
            up[root(k)] = root(("t", t))
    groups = defaultdict(list)
    for t in {r[0] for r in rows}:
        groups[root(("t", t))].append(t)
    return {t: min(g, key=str.encode) for g in groups.values() if len(g) > 1 for t in g}


def test_groups_and_splits(spark):
    draw = random.Random(8)
    rows = [(f"é{i}" if i % 9 else f"z{i}", draw.choice([None, "A-1", " a1", "A00", "?", f"a{draw.randint(2, 900)}"]) if i > 210 else draw.choice(["A 7", "a7"]), draw.choice([None, None, f"w{draw.randint(1, 900)}"])) for i in range(600)]
    rows += [("é3", "A99", ""), ("é4", None, ""), ("z0", "A7", None), ("z0", "A7", None)]
    rows += [(f"chain{i + j}", None, f"chain-{i}") for i in range(60) for j in (0, 1)]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows] + [(None, "A1", "w1", 5, "k")], META)
    want = joined(rows)
    groups = text_groups(df)
    assert {r.text_id: r.group_id for r in groups.collect()} == want
    assert max(Counter(want.values()).values()) > 200
    config = spark.createDataFrame([(1, 5, 0.6, 0.2, 0.2, 3), (2, 3, 0.5, 0.5, 0.0, 4)], "config_id int, num_folds int, train_share double, dev_share double, test_share double, seed int")
    got = assign_groups(df, config).collect()
    texts = {r[0] for r in rows}
    for c, shares in ((1, {"train": 0.6, "dev": 0.2, "test": 0.2}), (2, {"train": 0.5, "dev": 0.5})):
        mine = {r.text_id: r for r in got if r.config_id == c}
        assert set(mine) == texts and len([r for r in got if r.config_id == c]) == len(texts)
        for name in ("split", "fold"):
            assert len({(mine[t].group_id, mine[t][name]) for t in texts}) == len({mine[t].group_id for t in texts})
        n = Counter(r.split for r in mine.values())
        assert set(n) == set(shares) and all(abs(n[s] / len(texts) - x) < 0.1 for s, x in shares.items())


def test_no_ties_and_no_rows(spark):
    config = spark.createDataFrame([(1, 2, 0.5, 0.25, 0.25, 3)], "config_id int, num_folds int, train_share double, dev_share double, test_share double, seed int")
    alone = spark.createDataFrame([("a", None, None, 1, ""), ("b", "A0", None, 1, "")], META)
    assert text_groups(alone).count() == 0 and assign_groups(alone, config).count() == 2
    assert assign_groups(alone.limit(0), config).count() == 0
    assert assign_groups(alone, config.limit(0)).count() == 0


def test_cumulative_weight_at_every_size(spark):
    """Parts miss their share by one small group, for few groups and for many, with and without a group of a third."""
    draw = random.Random(9)
    config = spark.createDataFrame([(1, 4, 0.7, 0.2, 0.1, 3)], "config_id int, num_folds int, train_share double, dev_share double, test_share double, seed int")
    for n in (40, 3000):
        rows, at = [], 0
        for size in [n // 3, *[draw.choice([1, 1, 1, 2, 3, n // 40 + 1]) for _ in range(n // 3)]]:
            rows += [(f"t{at + i}", f"g{at}") for i in range(size)]
            at += size
        groups = spark.createDataFrame(rows, "text_id string, group_id string")
        meta = groups.select("text_id")
        got = assign_groups(meta, config, groups).collect()
        by = Counter(r.split for r in got)
        assert len(got) == at and all(abs(by[s] - x * at) <= 3 for s, x in (("train", 0.7), ("dev", 0.2), ("test", 0.1))), (n, by)
        folds = Counter(r.fold for r in got)  # the great group is one fold's, the rest is dealt out evenly
        great = {r.fold for r in got if r.group_id == "g0"}
        rest = [folds[f] for f in range(4) if f not in great]
        assert len(great) == 1 and max(rest) - min(rest) <= 3, folds
        assert len({r.group_id for r in got}) == len({(r.group_id, r.split) for r in got}) == len({(r.group_id, r.fold) for r in got})
        small = Counter((r.split, Counter(x.group_id for x in got)[r.group_id] == 1) for r in got) if n < 100 else None
        assert small is None or all(small[s, True] for s in ("train", "dev"))


def test_allotted():
    assert allotted([(0, 10, 10)], [0.5, 0.3, 0.2])[0][:2] == [5, 8]
    assert allotted([(5, 1, 6), (0, 4, 4)], [0.6, 0.2, 0.2]) == {5: [6.0, 6.0, float("inf")], 0: [0.0, 2.0, float("inf")]}
    assert allotted([(0, 3, 3)], [None, 0.0, 1.0])[0][:2] == [0.0, 0.0] and allotted([(0, 3, 3)], [0.0, 0.0])[0][0] == 3


def test_components_whatever_is_small(spark):
    draw = random.Random(12)
    edges = {tuple(sorted(draw.sample(range(400), 2))) for _ in range(330)}
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    want = joined([(str(v), None, f"{a}-{b}") for a, b in edges for v in (a, b)])
    for small in (0, 60, 10**6):
        got = components(df, small=small).collect()
        roots = {r.vertex: r.root for r in got}
        assert len(got) == len(roots) == len(want)
        assert {(roots[a], want[str(a)]) for a in roots}.__len__() == len(set(want.values())) == len(set(roots.values()))
    assert components(df.limit(0)).count() == 0
