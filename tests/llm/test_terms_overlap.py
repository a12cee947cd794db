"""Term counts and overlaps against brute force."""

import random
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime

from spanloom.llm.overlap import canonical, class_members, class_overlap, edit_distance, overlap_counts, pair_columns, split_overlap
from spanloom.llm.term_counts import folded, heavy_terms, judged_terms, term_counts
from spanloom.operators.positions import text_sizes

ANNOTATION = "anno_id long, text_id string, sent_idx int, token_idx int, token string, labels string, edited_at timestamp, n long, term string"


def day(n):
    return datetime(2024, 1, n)


def test_counts_whatever_is_heavy(spark):
    draw = random.Random(5)
    words = ["Éa", unicodedata.normalize("NFD", "éa"), "b ", "B", "", "c", "x" * 70_000, None]
    rows = [(i, draw.choice(["t1", "t1", "t1", "t2", "t3", "t4", None]), draw.randint(1, 40), 1, draw.choice(words), draw.choice([None, "_", "Time[1,2]|time", "'A; b'"]), day(draw.randint(1, 3)), 0, "") for i in range(600)]
    df = spark.createDataFrame(rows, ANNOTATION).repartition(3)
    tags = spark.createDataFrame([("Time",), (None,)], "tag string")
    best = {}
    for r in rows:
        if r[1] is not None and ((k := r[1:4]) not in best or (r[6], r[0]) > (best[k][6], best[k][0])):
            best[k] = r
    n, t = Counter(), defaultdict(set)
    for r in best.values():
        if r[4] is not None:
            n["token", folded(r[4])] += 1
            t["token", folded(r[4])].add(r[1])
    for r in rows:
        if r[1] is not None:
            for tag in {None: [], "_": [], "Time[1,2]|time": ["Time"] * 3, "'A; b'": ["A; b"]}[r[5]]:
                n["tag", tag] += 1
                t["tag", tag].add(r[1])
    want = {(*k, n[k], len(t[k])) for k in n}
    texts, large = text_sizes(df, rows=20, most=30)
    assert texts == 4 and dict(large)["t1"] > 10
    assert text_sizes(df, rows=20, most=3)[1] == [("t1", 2)] and text_sizes(df) == (4, [])
    for heavy in ([], [("token", "b"), ("tag", "Time"), ("token", "b"), ("token", "absent")], heavy_terms(df, tags)):
        for parts, batch in (([], 10_000), ([], 7), (large, 7), ([("t1", 2)], 10_000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert {tuple(r) for r in term_counts(df, tags, heavy, parts).collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    limits = spark.createDataFrame([("token", 2, 0.75), (None, 1, 1.0)], "field string, min_texts int, max_text_share double")
    got = {(r.field, r.term): r.verdict for r in judged_terms(df, tags, limits).collect()}
    assert got == {k: "rare" if k[0] == "token" and len(t[k]) < 2 else "common" if k[0] == "token" and len(t[k]) > 3 else None for k in n}
    assert judged_terms(df.limit(0), tags, limits).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    draw = random.Random(6)
    for _ in range(600):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 80))] for _ in range(2))
        assert edit_distance(a, b) == plain_distance(a, b)
    assert canonical(" Été") == "ete" and canonical("--") is None and canonical("") is None


def changed(draw, words, n):
    words = list(words)
    for _ in range(n):
        i = draw.randrange(len(words))
        draw.choice([lambda: words.pop(i), lambda: words.insert(i, "new"), lambda: words.__setitem__(i, "Öther")])()
    return words


def test_all_pairs_are_found(spark):
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    common = [draw.choice(vocabulary) for _ in range(8)]
    base = [common * draw.randint(0, 1) + [draw.choice(vocabulary) for _ in range(draw.choice([8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, 26, 33, 34, 47, 100, 300]))] for _ in range(40)]
    sentences = {}
    for t in range(30):
        for s in range(6):
            words = draw.choice(base)
            sentences[f"t{t}", s + 1] = changed(draw, words, draw.choice([0, 0, 1, 2, 3, len(words) // 6, len(words) // 7])) + draw.choice([[], [",", None]])
    rows = [(0, t, s, i, w if w is None or i % 3 else w.upper() + " ", None, day(1), 0, "") for (t, s), ws in sentences.items() for i, w in enumerate(ws)]
    rows += [(0, "t0", 1, 0, "older", None, None, 0, "")]
    sides = {f"t{t}": ["train", "Dev", " test "][t % 3] for t in range(29)}
    assign = spark.createDataFrame([(t, x, day(2)) for t, x in sides.items()] + [("t0", "test", day(1)), (None, "dev", day(1))], "text_id string, split string, assigned_at timestamp")
    df = spark.createDataFrame(rows, ANNOTATION)
    both = class_overlap(df, assign)
    got = split_overlap(*both)
    found = sorted(map(tuple, pair_columns(got).collect()))
    plain = {k: [c for w in ws if w is not None and (c := canonical(w)) is not None] for k, ws in sentences.items() if k[0] in sides}
    want = []
    for (t, s), a in plain.items():
        for (u, r), b in plain.items():
            if sides[t] == "train" != sides[u] and min(len(a), len(b)) >= 10 and plain_distance(a, b) <= 3 * max(len(a), len(b)) // 20:
                want.append((t, s, u, r) if t < u else (u, r, t, s))
    assert found == sorted(want) and len(want) > 60
    for hot in (0, 2, 8):  # whatever counts as a segment that too many share
        again = split_overlap(*class_overlap(df, assign, hot=hot))
        assert sorted(map(tuple, pair_columns(again).collect())) == found
    meta = spark.createDataFrame([("t1", "old", day(1)), ("t1", "new", day(2))], "text_id string, source string, catalogued_at timestamp")
    counts = overlap_counts(*both, meta).collect()
    assert sum(r.pairs for r in counts) == len(want) and {r.source for r in counts} == {"new", None}
    assert sum(r.exact_pairs for r in counts) == got.where("edits = 0").count() and sum(r.eval_sentences for r in counts) == got.select("text_id_eval", "sent_idx_eval").distinct().count()
    links = Counter(x for t, s, u, r in want for x in ((t, s), (u, r)))
    members = class_members(*both).collect()
    assert {(r.text_id, r.sent_idx): r.links for r in members} == {k: links[k] for k, ws in plain.items() if len(ws) >= 10}
    assert all((plain[a.text_id, a.sent_idx] == plain[b.text_id, b.sent_idx]) == (a.class_id == b.class_id) for a in members[:20] for b in members)
    assert split_overlap(*class_overlap(spark.createDataFrame([], ANNOTATION), assign)).count() == 0


def test_copies_are_counted_and_not_paired(spark):
    """A class of many copies on both sides: its rows and counts grow with the sentences, though its pairs are their product."""
    n = 3000
    tokens = spark.range(2 * n * 10).selectExpr("id as anno_id", "concat('t', (id div 10) % 2) as text_id", "cast(id div 20 as int) as sent_idx", "cast(id % 10 as int) as token_idx", "concat('w', id % 10) as token", "timestamp'2024-01-01' as edited_at")
    assign = spark.createDataFrame([("t0", "train", day(1)), ("t1", "test", day(1))], "text_id string, split string, assigned_at timestamp")
    meta = spark.createDataFrame([], "text_id string, source string, catalogued_at timestamp")
    both = class_overlap(tokens, assign)
    assert [tuple(r) for r in overlap_counts(*both, meta).collect()] == [("test", None, n * n, n * n, n)]
    members = class_members(*both)
    assert members.count() == 2 * n and {r.links for r in members.select("links").distinct().collect()} == {n}
