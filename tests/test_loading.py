"""Records and packed values, against plain readings of the same rules."""

import random
import re

from spanloom.operators.packed_values import split_packed, tokenize, values_of
from spanloom.sources.raw_lines import parse_lines, readable, unreadable


def judged(line):
    """The reason by a walk over characters."""
    if line is None or not line.strip() or line.startswith("#"):
        return None
    columns, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            text, j = "", i + 1
            while True:
                if j >= len(line):
                    return "quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] != '"':
                        break
                    j += 1
                text += line[j]
                j += 1
            j += 1
            if j < len(line) and line[j] != "\t":
                return "quoting"
            columns.append(text)
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            columns.append(line[i:j])
        if j >= len(line):
            break
        i = j + 1
    if len(columns) != 5:
        return "columns"
    pair = [re.fullmatch("([0-9]+)-([0-9]+)", c) for c in columns[:2]]
    if not pair[0] or not all(1 <= int(x) < 2**31 for x in pair[0].groups()):
        return "sent_token"
    if not pair[1] or not all(0 <= int(x) < 2**31 for x in pair[1].groups()):
        return "char_range"
    a, b = map(int, pair[1].groups())
    return "" if a < b and b - a == len(columns[2]) else "char_range"


def test_lines_like_a_walk_over_characters(spark):
    draw = random.Random(1)
    parts = ['"', '""', "\t", "a", "é𝄞", "1-1", "0-1", "0-2", "0001-2", " ", "9" * 11, "_", "2147483648-1"]
    lines = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    lines += ["\t".join(draw.choice(['"a"', "a", '"', '""', '""""', "1-1", "0-1", '"0-1"', '"1-1"', '"a\tb"', "0-3"]) for _ in range(draw.randint(4, 6))) for _ in range(3000)]
    lines += [None, "", " ", "#x", "\t" * 100_000, "\t" * 30 + '"', "\t" * 30 + '"x"', "1-1\t0-3\ta\"b\t_\t", "1-1\t0-100000\t" + "x" * 100_000 + "\t_\t_", "1-1\t0-1\té\t_\t"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").repartition(5)
    parsed = parse_lines(df).cache()
    got = {r.line_id: r.reason or "" for r in parsed.collect()}
    want = {i: w for i, x in enumerate(lines) if (w := judged(x)) is not None}
    assert got == want
    assert {w for w in want.values()} == {"", "quoting", "columns", "sent_token", "char_range"}
    assert readable(parsed).count() + unreadable(parsed).count() == len(want)
    row = readable(parsed).where(f"line_id = {len(lines) - 1}").first()
    assert (row.sent_idx, row.token_idx, row.char_start, row.char_end, row.token, row.labels, row.rest) == (1, 1, 0, 1, "é", "_", "")


def test_no_lines(spark):
    assert parse_lines(spark.createDataFrame([], "line_id long, line string, reason string")).count() == 0


def test_tokenizer():
    assert tokenize(None) == tokenize("_") == tokenize("  ") == tokenize("") == tokenize(";;") == []
    assert tokenize(r"Smell\_Word[4]|Quality") == [("Smell_Word", [4]), ("Quality", [])]
    assert tokenize('"Quality ""quoted"""[1, 2] / / "Effect; bodily" [3]') == [('Quality "quoted"', [1, 2]), ("Effect; bodily", [3])]
    assert tokenize("'Time'[1]&\"Time[2]\"") == [("Time", [1]), ("Time", [2])]
    assert tokenize("[3]") == [] and tokenize('"open') == [("open", [])] and tokenize("a[1") == [("a", [])]
    assert tokenize("Tag" * 50_000 + "[7]") == [("Tag" * 50_000, [7])]
    assert values_of("time[1;2] new", {"time": "Time"}) == [("Time", 1), ("Time", 2), ("new", 0)]
    assert values_of("t[99999999999]", {}) == [("t", 0)]


def test_values_keep_their_place(spark):
    tags = spark.createDataFrame([("Time", 1), (None, 2)], "tag string, priority int")
    rows = [(1, "time[1|2];x", 0), (1, "time[1|2];x", 0), (2, None, 0), (3, "_", 0), (4, "x", 0)]
    df = spark.createDataFrame(rows, "anno_id long, labels string, pos int")
    got = sorted(map(tuple, split_packed(df, "anno_id", "labels", tags, least=2).collect()))
    assert got == sorted([(1, 1, "Time", 1), (1, 2, "Time", 2), (1, 3, "x", 0)] * 2)
    assert split_packed(df, "anno_id", "labels", tags).count() == 7
    assert split_packed(df.limit(0), "anno_id", "labels", tags).count() == 0
