"""Splits and folds that keep related texts together.

Texts tied by author or work form groups, found by random-mate contraction: texts are numbered once; each round every vertex flips a coin,
those with tails collapse into a neighbour with heads, and the edges are relabelled by joins, until none is left. A round takes at least a
quarter of the vertices away on average, so rounds grow as the logarithm of the texts. Labels are then unwound by pointer doubling.

Groups are given to splits by cumulative weight, from the largest size to the smallest: of each size, groups in an order drawn from the seed are
laid along a line, which is cut at the numbers of groups that bring the splits nearest to their shares. Sizes differ by five percent at most
within a class, so there are a few hundred classes whatever the number of groups, and only their counts and sums get to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.util import checkpointed, heavy_keys, lookup_rows, salted_join

#: The ratio of sizes within a class of groups; classes grow as the logarithm of the largest group.
RATIO, CLASSES = 1.05, 2000
BUCKETS = 1024
#: Edges or labels up to this number are one task's: rounds over so few need no shuffle. It changes no result.
SMALL = 200_000


def tie_keys(text_meta: DataFrame) -> DataFrame:
    """(text_id, key), unique: the author and the work that a row of text_meta names.

    Authors are the same if they differ only in case, blanks or hyphens; one without a digit from 1 to 9 names nobody. A null work
    names no work. Rows without text_id are left out.
    """
    rows = text_meta.where("text_id is not null")
    author = F.lower(F.regexp_replace("author_id", r"[\s\u00A0\u2009\u202F\u2010-\u2015\-]", ""))
    authors = rows.where(F.col("author_id").rlike("[1-9]")).select("text_id", F.concat(F.lit("a:"), author).alias("key"))
    works = rows.where("work_id is not null").select("text_id", F.concat(F.lit("w:"), "work_id").alias("key"))
    return authors.unionByName(works).distinct()


def numbered(keys: DataFrame) -> DataFrame:
    """(text_id, id), checkpointed: a number for each text of ``keys``, so that rounds compare and add up whole numbers."""
    return checkpointed(keys.select("text_id").distinct().withColumn("id", F.monotonically_increasing_id()))


def tie_edges(keys: DataFrame, salts: int = 64) -> DataFrame:
    """(u, v), u < v, unique, of (id, key): the texts of each key tied to its least, by way of the least of one of ``salts`` shares of the key, so that no key is gathered in one task."""
    salted = keys.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(salts)))
    shares = salted.groupBy("key", "s").agg(F.min("id").alias("least"))
    inner = salted.join(shares, ["key", "s"]).select(F.col("least").alias("u"), F.col("id").alias("v"))
    outer = shares.join(shares.groupBy("key").agg(F.min("least").alias("u")), "key").select("u", F.col("least").alias("v"))
    return inner.unionByName(outer).where("u <> v").distinct()


def _heads(vertex: str, turn: int) -> Column:
    # the turn as a text: a number would stand in the generated code, which would be compiled anew each round
    return F.xxhash64(F.col(vertex), F.lit(str(turn))).bitwiseAND(F.lit(1)) == 1


def components(edges: DataFrame, most_rounds: int = 400, small: int = SMALL) -> DataFrame:
    """(vertex, root) of all vertices of ``edges`` (u, v); equal roots are one component, and a root is a vertex of it.

    Each round's result is checkpointed, so a lost executor costs one round at most. Raises if ``most_rounds`` don't end it.
    """
    left = checkpointed(edges.select("u", "v", F.lit(False).alias("gone")))
    done = []
    for turn in range(most_rounds):
        live = left.where("not gone").select("u", "v")
        if turn % 3 == 0:  # a round over no edges does no harm, so not each round asks
            n = live.count()
            if not n:
                break
        if n <= small:
            live = live.coalesce(1)
        ways = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        into = ways.where(~_heads("u", turn) & _heads("v", turn)).groupBy("u").agg(F.min("v").alias("to"))
        a, b = into.select(F.col("u"), F.col("to").alias("ut")), into.select(F.col("u").alias("v"), F.col("to").alias("vt"))
        moved = live.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("ut", "u").alias("u"), F.coalesce("vt", "v").alias("v"))
        moved = moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        left = checkpointed(moved.withColumn("gone", F.lit(False)).unionByName(into.select("u", F.col("to").alias("v"), F.lit(True).alias("gone"))))
        done.append(left.where("gone").select(F.col("u").alias("vertex"), F.col("v").alias("root")))
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    if not done:
        return left.where("gone").select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    parents = reduce(DataFrame.unionByName, done)
    parents = checkpointed(parents.coalesce(1) if parents.count() <= small else parents)
    span = 1
    while span < len(done):
        above = parents.select(F.col("vertex").alias("root"), F.col("root").alias("__up"))
        parents = checkpointed(parents.join(above, "root", "left").select("vertex", F.coalesce("__up", "root").alias("root")))
        span *= 2
    return parents.unionByName(parents.select(F.col("root").alias("vertex"), "root").distinct())


def text_groups(text_meta: DataFrame) -> DataFrame:
    """(text_id, group_id) of the texts tied to another, directly or through others; group_id is the group's smallest text_id."""
    keys = tie_keys(text_meta)
    ids = numbered(keys)
    labels = components(tie_edges(keys.join(ids, "text_id").select("id", "key"))).join(ids.withColumnRenamed("id", "vertex"), "vertex")
    least = labels.groupBy("root").agg(F.min("text_id").alias("group_id"))
    return salted_join(labels, least, ["root"], heavy_keys(labels, "root")).select("text_id", "group_id")


def allotted(classes: list[tuple[int, int, int]], shares: list[float]) -> dict[int, list[float]]:
    """For each of ``classes`` (class, groups, their texts), the places on the line of its texts where each part ends.

    From the largest class to the smallest, groups go to parts in proportion to the room that these have left of their ``shares``, in whole
    numbers; those that remain go one by one to the part with most room left.
    """
    shares = [max(0.0, x or 0.0) for x in shares]
    total, whole = sum(n for _, _, n in classes), sum(shares)
    room = [x / whole * total if whole else total * (i == 0) for i, x in enumerate(shares)]
    open_ = [i for i, x in enumerate(room) if x > 0]
    ends = {}
    for name, groups, texts in sorted(classes, reverse=True):
        each = texts / groups
        left = {i: max(0.0, room[i]) for i in open_}
        scale = groups / sum(left.values()) if sum(left.values()) else 0.0
        given = {i: int(left[i] * scale) for i in open_}
        for _ in range(groups - sum(given.values())):
            most = max(open_, key=lambda i: (room[i] - given[i] * each, -i))
            given[most] += 1
        at, line = 0, []
        for i in range(len(shares)):
            at += given.get(i, 0)
            line.append(at * each)
            room[i] -= given.get(i, 0) * each
        ends[name] = [*line[:-1], float("inf")] if line else []
    return ends


def assign_groups(text_meta: DataFrame, fold_config: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(config_id, text_id, group_id, split, fold): each text once per row of ``fold_config``, the texts of a group together.

    A text that is tied to none is its own group. Parts miss their share by about one group of the smallest size, unless a larger group
    exceeds it. Null shares count as none. Splits and folds are assigned apart from each other. A null or repeated text_id gives no other row.
    """
    texts = text_meta.where("text_id is not null").select("text_id").distinct()
    groups = text_groups(text_meta) if groups is None else groups
    member = checkpointed(texts.join(groups, "text_id", "left").withColumn("group_id", F.coalesce("group_id", "text_id")))
    sizes = checkpointed(member.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.floor(F.log(RATIO, "n") + F.lit(1e-9)).cast("int")))
    classes = [(r["class"], r.m, r.n) for r in lookup_rows(sizes.groupBy("class").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")), CLASSES)]
    configs = lookup_rows(fold_config, 1000)
    lines = []
    for c in configs:
        folds = max(1, c.num_folds or 1)
        splits, parts = allotted(classes, [c.train_share, c.dev_share, c.test_share]), allotted(classes, [1 / folds] * folds)
        lines += [(c.config_id, c.seed, k, splits[k], parts[k]) for k, _, _ in classes]
    schema = "config_id int, seed int, class int, splits array<double>, folds array<double>"
    by = sizes.join(F.broadcast(member.sparkSession.createDataFrame(lines, schema)), "class").withColumn("h", F.xxhash64("group_id", "seed"))
    # sums along the line of a class in two levels, so that no class is gathered in one task
    by = by.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 32), F.lit(BUCKETS)))
    key = ["config_id", "class", "bucket"]
    sums = by.groupBy(*key).agg(F.sum("n").alias("sum"))
    sums = sums.select(*key, (F.sum("sum").over(W.partitionBy("config_id", "class").orderBy("bucket")) - F.col("sum")).alias("earlier"))
    within = F.sum("n").over(W.partitionBy(*key).orderBy("h", "group_id"))
    by = by.withColumn("within", within).join(sums, key).withColumn("middle", F.col("earlier") + F.col("within") - F.col("n") / 2)
    place = lambda line: F.size(F.filter(line, lambda e: e <= F.col("middle")))
    names = F.array(F.lit("train"), F.lit("dev"), F.lit("test"))
    chosen = by.select("config_id", "group_id", F.get(names, place("splits")).alias("split"), place("folds").cast("int").alias("fold"))
    return salted_join(member, chosen, ["group_id"], heavy_keys(member, "group_id")).select("config_id", "text_id", "group_id", "split", "fold")
