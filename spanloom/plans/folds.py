"""Queries over folds, samples, chunks and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import folds, sequences
from spanloom.operators.positions import current_tokens
from spanloom.plans.adapters import SEQUENCES, TOKENS, labelled, sentence_sizes, text_tokens, with_
from spanloom.plans.scores import rounded
from spanloom.util import table

SEED = 36437


def _text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("text_id").agg(F.sum((F.col("gold") == "A").cast("long")).alias("n"))


def fold_assign_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.greedy_folds(_text_counts(spark, sf_dir), 5, SEED)


def fold_assign_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = labelled(spark, sf_dir).groupBy("text_id", "sent_idx").agg(F.sum((F.col("gold") == "A").cast("long")).alias("n"))
    return folds.running_folds(per, 2)


def fold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_roles(fold_assign_greedy(spark, sf_dir))


def downsample_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.downsample(sentence_sizes(spark, sf_dir), 0.4, 2629, "text_id")


def smoothed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = text_tokens(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return rounded(folds.smoothed_shares(sizes, 0.5))


def masked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.masked_tokens(text_tokens(spark, sf_dir), 0.15, 7, "text_id", "sent_idx", "token_idx").select("text_id", "sent_idx", "token_idx", "masked")


def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.incomplete_sentences(text_tokens(spark, sf_dir))


def skip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.without_edges(sentence_sizes(spark, sf_dir), 20, 30)


def fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fixed_blocks(text_tokens(spark, sf_dir)).select("text_id", "sent_idx", "token_idx", "block_id", "block_pos")


def prefix_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.within_limits(sentence_sizes(spark, sf_dir), 6, 100)


def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.reset_groups(sentence_sizes(spark, sf_dir), ["text_id"], ["sent_idx"], "n", sequences.chunk_rule(50))


def chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.chunk_terms(text_tokens(spark, sf_dir), 50)


def _batches(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    sizes = text_tokens(spark, sf_dir).groupBy("lang", "text_id", "sent_idx").agg(F.count(F.lit(1)).alias("n"))
    return sequences.packed_batches(sizes, ["lang"], ["n", "text_id", "sent_idx"], "n", 32, 256, mode)


def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, "corrected")


def batch_pack_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, "faithful")


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_tokens(table(spark, sf_dir, "annotation"), "labels", "anno_id").select("text_id", "sent_idx", "token_idx", "anno_id", F.coalesce("token", F.lit("<null>")).alias("token"), F.coalesce("labels", F.lit("<null>")).alias("labels"))


def reader_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tokens(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.count_distinct("text_id", "sent_idx").alias("sentences"), F.count_distinct("text_id").alias("texts"), F.count_distinct("token").alias("types"))


def _walk(source: str, key: str, order: str, first: str, step: str, columns: str) -> str:
    """A recursive walk over rows in ``order`` within ``key``; ``step`` makes the state of row x from the state of p."""
    return f"""walked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}),
walk AS (SELECT {columns}, rn, {first} FROM walked x WHERE rn = 1 UNION ALL SELECT {", ".join("x." + c.strip() for c in columns.split(","))}, x.rn, {step} FROM walk p JOIN walked x ON x.rn = p.rn + 1 AND {" AND ".join(f"x.{k.strip()} = p.{k.strip()}" for k in key.split(",")) if key != "1" else "true"})"""


def _recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


_HASHED = f"{with_(SEQUENCES)}, docs AS (SELECT text_id, count(*) FILTER (gold = 'A') AS n, md5('{SEED}|' || text_id) AS h FROM seq GROUP BY text_id), lim AS (SELECT CAST(sum(n) AS DOUBLE) / 5 AS l FROM docs)"
_GREEDY = f"""{_HASHED}, {_walk("docs", "1", "h, text_id", "CASE WHEN x.n >= (SELECT l FROM lim) THEN 0 ELSE x.n END AS s, 0 AS fold_id, CASE WHEN x.n >= (SELECT l FROM lim) THEN 1 ELSE 0 END AS nxt", "CASE WHEN p.s + x.n >= (SELECT l FROM lim) THEN 0 ELSE p.s + x.n END, p.nxt, CASE WHEN p.s + x.n >= (SELECT l FROM lim) THEN least(p.nxt + 1, 4) ELSE p.nxt END", "text_id, n")}"""
_BATCH = lambda restart: _recursive(f"""{with_(TOKENS)}, sz AS (SELECT lang, text_id, sent_idx, count(*) AS n FROM toks GROUP BY ALL), {_walk("sz", "lang", "n, text_id, sent_idx", "x.n AS w, 1 AS c, 0 AS batch_id", f"CASE WHEN p.c >= 32 OR p.w + x.n > 256 THEN {restart} ELSE p.w + x.n END, CASE WHEN p.c >= 32 OR p.w + x.n > 256 THEN 1 ELSE p.c + 1 END, CASE WHEN p.c >= 32 OR p.w + x.n > 256 THEN p.batch_id + 1 ELSE p.batch_id END", "lang, text_id, sent_idx, n")} SELECT lang, text_id, sent_idx, n, batch_id FROM walk""")
_CHUNK = _walk("{}", "text_id", "sent_idx", "CASE WHEN x.n > 50 THEN 0 ELSE x.n END AS s, 0 AS group_id, CASE WHEN x.n > 50 THEN 1 ELSE 0 END AS nxt", "CASE WHEN p.s + x.n > 50 THEN 0 ELSE p.s + x.n END, p.nxt, CASE WHEN p.s + x.n > 50 THEN p.nxt + 1 ELSE p.nxt END", "text_id, sent_idx, n")
_INK = r"regexp_matches(token, '[\p{L}\p{N}]')"
SQL = {
    "fold_assign_greedy": _recursive(f"{_GREEDY} SELECT text_id, fold_id FROM walk"),
    "fold_assign_running": f"""{with_(SEQUENCES)}, s AS (SELECT text_id, sent_idx, count(*) FILTER (gold = 'A') AS n FROM seq GROUP BY 1, 2), r AS (SELECT *, round_even(sum(n) OVER (PARTITION BY text_id) / 2.0, 0) AS size, sum(n) OVER (PARTITION BY text_id ORDER BY sent_idx) AS c FROM s)
SELECT text_id, sent_idx, n, CAST(CASE WHEN size = 0 THEN 0 ELSE least(floor(c / size), 1) END AS INT) AS fold_id FROM r""",
    "fold_roles": _recursive(f"{_GREEDY} SELECT text_id, fold_id, fold_num, CASE WHEN fold_id = t THEN 'test' WHEN fold_id = d THEN 'dev' ELSE 'train' END AS split FROM walk, (VALUES (0, 4, 0), (1, 3, 4), (2, 2, 3), (3, 1, 2), (4, 0, 1)) r(fold_num, t, d)"),
    "downsample_sentences": f"{with_(TOKENS)}, r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY md5('2629|' || text_id || '|' || sent_idx), text_id, sent_idx) AS sample_rank, count(*) OVER (PARTITION BY text_id) AS m FROM sizes) SELECT text_id, sent_idx, n, CAST(sample_rank AS INT) AS sample_rank FROM r WHERE sample_rank <= floor(CAST(0.4 AS DOUBLE) * m)",
    "smoothed_shares": f"{with_(TOKENS)}, l AS (SELECT lang, count(*) AS n FROM toks GROUP BY 1), s AS (SELECT lang, n, n / (sum(n) OVER ()) AS share FROM l) SELECT lang, n, round(share, 9) AS share, round(sqrt(share) / sum(sqrt(share)) OVER (), 9) AS smoothed FROM s",
    "masked_tokens": f"{with_(TOKENS)} SELECT text_id, sent_idx, token_idx, CAST('0x' || md5('7|' || text_id || '|' || sent_idx || '|' || token_idx)[1:8] AS BIGINT) < {int(0.15 * 2**32)} AS masked FROM toks",
    "integrity_check": f"{with_(TOKENS)} SELECT text_id, sent_idx, count(*) AS tokens, max(token_idx) AS last_idx FROM toks GROUP BY 1, 2 HAVING count(*) <> max(token_idx)",
    "skip_edges": f"{with_(TOKENS)}, c AS (SELECT *, sum(n) OVER (PARTITION BY text_id ORDER BY sent_idx) - n AS b, sum(n) OVER (PARTITION BY text_id) AS t FROM sizes) SELECT text_id, sent_idx, n FROM c WHERE b >= 20 AND t - b >= 30",
    "fixed_blocks": f"{with_(TOKENS)}, p AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY sent_idx, token_idx) - 1 AS p, count(*) OVER (PARTITION BY text_id) AS t FROM toks) SELECT text_id, sent_idx, token_idx, CAST(p // 128 AS INT) AS block_id, CAST(p % 128 AS INT) AS block_pos FROM p WHERE t < 128 OR p < t - t % 128",
    "prefix_limits": f"{with_(TOKENS)}, c AS (SELECT *, sum(n) OVER w AS b, row_number() OVER w AS s FROM sizes WINDOW w AS (PARTITION BY text_id ORDER BY sent_idx)) SELECT text_id, sent_idx, n FROM c WHERE s <= 6 AND b <= 100",
    "chunk_sentences": _recursive(f"{with_(TOKENS)}, {_CHUNK.format('sizes')} SELECT text_id, sent_idx, n, group_id FROM walk"),
    "chunk_terms": _recursive(f"{with_(TOKENS)}, inked AS (SELECT text_id, sent_idx, count(*) FILTER ({_INK}) AS n FROM toks GROUP BY 1, 2), {_CHUNK.format('inked')} SELECT text_id, text_id || '-chunk-' || lpad(CAST(group_id + 1 AS VARCHAR), 3, '0') AS chunk_id, lower(token) AS term, count(*) AS n FROM toks JOIN walk USING (text_id, sent_idx) WHERE {_INK} GROUP BY ALL"),
    "batch_pack": _BATCH("x.n"),
    "batch_pack_faithful": _BATCH("0"),
    "latest_rows": "SELECT text_id, sent_idx, token_idx, x.a AS anno_id, coalesce(x.t, '<null>') AS token, coalesce(x.l, '<null>') AS labels FROM (SELECT text_id, sent_idx, token_idx, arg_max(struct_pack(a := anno_id, t := token, l := labels), (edited_at, anno_id)) AS x FROM annotation GROUP BY 1, 2, 3)",
    "reader_stats": f"{with_(TOKENS)} SELECT lang, count(*) AS words, count(DISTINCT (text_id, sent_idx)) AS sentences, count(DISTINCT text_id) AS texts, count(DISTINCT token) AS types FROM toks GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (fold_assign_greedy, fold_assign_running, fold_roles, downsample_sentences, smoothed_shares, masked_tokens, integrity_check, skip_edges, fixed_blocks, prefix_limits, chunk_sentences, chunk_terms, batch_pack, batch_pack_faithful, latest_rows, reader_stats)}
