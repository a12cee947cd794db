"""Entries of sections against a walk."""

import random

import numpy as np

from spanloom.operators import chains


def test_entries_of_sections(spark, monkeypatch):
    monkeypatch.setattr(chains, "FAN", 3)
    draw, section, jump = random.Random(4), 8, 5
    rows, want = [], set()
    for key, n in (("a", 5), ("b", 8), ("c", 500), ("d", 77)):
        following = np.array([min(i + draw.randint(1, jump), n) for i in range(n)])
        at = 0
        while at < n:
            if at // section not in {k for x, k, _ in want if x == key}:
                want.add((key, at // section, at % section))
            at = int(following[at])
        for k in range(-(-n // section)):
            part = following[k * section : k * section + section + jump] - k * section
            rows.append((key, k, [int(x) for x in chains.exits(part, section, jump)] if (k + 1) * section < n else [0] * jump))
    maps = spark.createDataFrame(rows, "key string, k long, exits array<int>")
    got = {(r.key, r.k, r.entry) for r in chains.section_entries(maps, ["key"], 63).collect()}
    assert got == want and len(want) == 63 + 10 + 1 + 1
    assert chains.section_entries(maps.limit(0), ["key"], 63).count() == 0
