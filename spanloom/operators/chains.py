"""Chains of jumps over rows of any length: each place of a row says where the next jump from it leads, and the chain begins at place 0.

A chain can't be followed in pieces, as a piece doesn't know where it is entered. So each section of a row is asked where every possible
entry leaves it, which it can tell by itself; such answers are composed, block by block and level by level, into the section's true entry.
No row is gathered whole, and how long sections are changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections, or blocks of the level below, that are composed in one row.
FAN = 64


def exits(following: np.ndarray, section: int, entries: int) -> np.ndarray:
    """Where the chains that enter a section at its first ``entries`` places leave it, counted from its end; ``following`` has the jump of each place. 0 where a row ends before its section does."""
    last = max(section, int(following.max(initial=0)))
    to = np.concatenate([following[:section], np.arange(len(following[:section]), last + 1)])
    for _ in range(int(section).bit_length()):
        to = to[to]
    return np.maximum(to[:entries] - section, 0)


def section_entries(maps: DataFrame, key: list[str], most: int) -> DataFrame:
    """(key, k, entry): where the chain of each key enters its section ``k``, counted from the section's begin.

    ``maps`` has (key, k, exits), k from 0 without gaps: for each entry, in order, where it leaves, from the begin of section k + 1. ``most`` is the
    greatest number of sections of a key. Levels grow as its logarithm; a row holds the answers of FAN sections.
    """
    blocks = maps.groupBy(*key, F.expr(f"k div {FAN}").alias("b")).agg(F.sort_array(F.collect_list(F.struct("k", "exits"))).alias("s"))
    if most <= FAN:
        blocks = blocks.withColumn("e0", F.lit(0))
    else:
        through = F.expr("aggregate(slice(s, 2, size(s)), s[0].exits, (m, x) -> transform(m, e -> x.exits[e]))")
        upper = section_entries(blocks.select(*key, F.col("b").alias("k"), through.alias("exits")), key, -(-most // FAN))
        blocks = blocks.join(upper.select(*key, F.col("k").alias("b"), F.col("entry").alias("e0")), [*key, "b"])
    walk = "aggregate(s, named_struct('at', e0, 'out', cast(array() as array<struct<k: bigint, entry: int>>)), (a, x) -> named_struct('at', x.exits[a.at], 'out', array_append(a.out, named_struct('k', cast(x.k as bigint), 'entry', a.at)))).out"
    return blocks.select(*key, F.expr(f"inline({walk})"))
