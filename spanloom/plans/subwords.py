"""Queries over cleaned texts, splits, subwords, and reports of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.scripts import SCRIPTS
from spanloom.operators import arrays, folds, labels, score, spans, subwords
from spanloom.plans.adapters import SEQUENCES, TOKENS, labelled, sequences, spans_sql, text_tokens, with_
from spanloom.plans.scores import rounded
from spanloom.util import table

#: Characters of the stand-in subwords of a sentence.
CUT = 5


def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", subwords.clean_text(F.col("text")).alias("cleaned"))


def pre_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(subwords.pre_tokens(F.col("text")), " ").alias("words"))


def script_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(subwords.pre_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", subwords.with_blanks(F.col("word"), subwords.script_places(F.col("word"))).alias("split"))


def _cut_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their words, their characters in stand-in subwords of CUT, and where words and subwords end."""
    rows = text_tokens(spark, sf_dir).where("length(replace(token, ' ', '')) > 0").groupBy("text_id", "sent_idx").agg(F.sort_array(F.collect_list(F.struct("token_idx", "token"))).alias("x"))
    rows = rows.select("text_id", "sent_idx", F.transform("x", lambda x: F.replace(x["token"], F.lit(" "), F.lit(""))).alias("words"))
    rows = rows.withColumn("subwords", F.regexp_extract_all(F.array_join("words", ""), F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)))
    return rows.withColumn("gold", subwords.word_places(F.col("words"))).withColumn("found", subwords.word_places(F.col("subwords")))


def split_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_sentences(spark, sf_dir).select("text_id", "sent_idx", F.array_join(subwords.rendered_splits(F.col("subwords"), F.col("gold")), "|").alias("rendered"))


def nearest_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cut_sentences(spark, sf_dir).withColumn("at", arrays.nearest_places(F.col("gold"), F.col("found")))
    places = arrays.gather(F.col("found"), F.col("at"))
    marks = subwords.split_marks(F.col("at"), F.size("subwords"))
    return rows.select("text_id", "sent_idx", F.array_join(F.col("at").cast("array<string>"), ",").alias("offsets"), F.array_join(places.cast("array<string>"), ",").alias("places"), F.size(F.filter(marks, lambda m: m == "split")).alias("splits"))


def _sentence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_tokens(spark, sf_dir).where("length(replace(token, ' ', '')) > 0").groupBy("text_id", "sent_idx").agg(F.sort_array(F.collect_list(F.struct("token_idx", "token"))).alias("x"))
    words = F.transform("x", lambda x: F.replace(x["token"], F.lit(" "), F.lit("")))
    return rows.select("text_id", "sent_idx", words.alias("gold"), F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\p{P}+$"), w).otherwise(F.concat(F.lit(" "), w))), "").alias("text"))


def tokenization_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subwords of each sentence by a public tokenizer, their labels, and the subword at which each gold word ends."""
    texts = _sentence_texts(spark, sf_dir)
    rows = texts.join(subwords.subword_rows(texts, ["text_id", "sent_idx"], "text"), ["text_id", "sent_idx"])
    # the places by themselves first: within the lookup of each they would be made again
    rows = rows.withColumn("a", subwords.word_places(F.col("gold"))).withColumn("b", subwords.word_places(F.col("subwords"))).withColumn("offsets", arrays.nearest_places(F.col("a"), F.col("b")))
    return rows.select("text_id", "sent_idx", "gold", "subwords", "ids", "offsets", subwords.split_marks(F.col("offsets"), F.size("subwords")).alias("marks"))


def subword_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, words, subwords and unknown subwords of each language; pieces of two characters that fewer than three words have count as unknown."""
    rows = text_tokens(spark, sf_dir).select("lang", "text_id", "sent_idx", "token_idx", F.explode(arrays.word_pieces(F.col("token"), 2)).alias("piece"))
    known = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("piece", F.lit(1).alias("known"))
    per = rows.join(known, "piece", "left").groupBy("lang", "text_id", "sent_idx").agg(F.countDistinct("token_idx").alias("words"), F.count(F.lit(1)).alias("subwords"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return per.groupBy("lang").agg(F.count(F.lit(1)).alias("sentences"), *(F.sum(c).alias(c) for c in ("words", "subwords", "unknown")))


def seqeval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F of all spans, and accuracy of all labels."""
    rows = labelled(spark, sf_dir)
    counts = score.span_counts(spans.inclusive_spans(rows, "gold_bio"), spans.inclusive_spans(rows, "a_bio"), ["text_id", "sent_idx", "start", "end", "label"])
    return rounded(counts.crossJoin(score.metric(rows, "accuracy", gold="gold_bio", pred="a_bio")))  # one row by one row


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("run"), F.col("l_linenumber").cast("int").alias("epoch"))
    return rows.agg(F.round(F.avg(F.col("l_discount").cast("double")), 4).alias("sum"))


def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.best_epochs(_epochs(spark, sf_dir), ["run"], "epoch", "sum", 2)


def first_epoch_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.first_epoch_outlier(_epochs(spark, sf_dir), ["run"], "epoch", "sum")


def batch_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from batches of 16 parts a status."""
    batches = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select("o_orderpriority", F.explode(F.sequence(F.lit(0), F.expr("cast(n div (16 + length(o_orderpriority)) as int)"))).alias("batch"))
    return folds.batch_draws(batches, "o_orderpriority", "batch", 0.5, 11)


def masked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_tokens(spark, sf_dir).withColumn("id", F.length("token"))
    return folds.masked_ids(rows, "id", 0.15, 7, 103, 1000, "text_id", "sent_idx", "token_idx").select("text_id", "sent_idx", "token_idx", "input_id", "label_id")


def _plain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem, numbered within their order, with a label field of two tags, one with a number."""
    rows = sequences(spark, sf_dir)
    return rows.withColumn("labels", F.when(F.col("gold") == "O", "_").otherwise(F.concat(F.lit("Smell\\_"), "gold", F.lit("["), F.col("number").cast("string"), F.lit("]|"), "pred_a")))


def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field: its first tag by priority, whether it has tag R, the cleaned label, the bare word and the marked subtokens."""
    tags = ["R", "A", "Smell\\_A"]
    parsed = labels.parse_labels(F.col("labels"), tags)
    marked = arrays.subtoken_marks(F.transform(arrays.word_pieces(F.col("token"), 3), lambda p: F.concat(p, F.lit("</w>"))))
    rows = _plain_labels(spark, sf_dir)
    return rows.select("text_id", "sent_idx", "token_idx", labels.first_label(F.col("labels"), tags).alias("first"), labels.has_tag(parsed, "R").alias("has_r"), labels.clean_label(F.concat(F.lit("B-I-"), "labels")).alias("clean"), labels.bare_word(F.concat("token", F.lit("-é!"))).alias("bare"), F.array_join(marked, " ").alias("marked"))


def label_id_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of labels by a vocabulary of those of the first fold, with an unknown one for the rest."""
    rows = labelled(spark, sf_dir)
    vocab = labels.vocabulary(rows.where("fold = 0 and gold_bio <> 'B-R'"), "gold_bio", ["gold_bio"], "@@unkORpad@@")
    return labels.label_ids(rows, "gold_bio", vocab, "@@unkORpad@@").select("text_id", "sent_idx", "token_idx", "gold_bio", "label_id")


def stacked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One BIO column for each tag of fields with several."""
    rows = _plain_labels(spark, sf_dir).withColumn("p", labels.parse_labels(F.col("labels")))
    return labels.iob2_stacked(rows, "p", [["A"], ["R"], ["Smell\\_A", "Smell\\_R"]]).select("text_id", "sent_idx", "token_idx", "label_0", "label_1", "label_2")


_CLEAN = r"replace(regexp_replace(regexp_replace(text, '[\t\n\r\p{Zs}]', ' ', 'g'), '[\x{FFFD}\p{C}]', '', 'g'), '  ', ' ')"
_SIGNS = r"\p{P}$+<=>^`|~"
_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
_PRE = rf"regexp_extract_all({_CLEAN}, '[{_SIGNS}{_CJK}]|[^\s{_SIGNS}{_CJK}]+')"
_SCRIPT = " ".join(f"WHEN unicode(c) BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in SCRIPTS)
_WORDS = "bare AS (SELECT text_id, sent_idx, token_idx, replace(token, ' ', '') AS w FROM toks WHERE length(replace(token, ' ', '')) > 0), ends AS (SELECT text_id, sent_idx, token_idx, w, CAST(sum(length(w)) OVER (PARTITION BY text_id, sent_idx ORDER BY token_idx) AS INT) AS e FROM bare)"
_NEAR = f"""{with_(TOKENS, _WORDS)}, g AS (SELECT *, max(e) OVER (PARTITION BY text_id, sent_idx) AS t, list(e) OVER (PARTITION BY text_id, sent_idx) AS all_ends FROM ends),
o AS (SELECT *, CASE WHEN e >= {CUT} THEN e - e % {CUT} END AS l, least((e // {CUT} + 1) * {CUT}, t) AS r FROM g),
f AS (SELECT *, l IS NOT NULL AND NOT list_contains(all_ends, l) AS fl, NOT list_contains(all_ends, r) AS fr FROM o),
p AS (SELECT *, CASE WHEN e % {CUT} = 0 OR e = t THEN e WHEN l IS NULL THEN r WHEN fl AND NOT fr THEN l WHEN fr AND NOT fl THEN r WHEN e - l <= r - e THEN l ELSE r END AS place FROM f),
i AS (SELECT *, (place + {CUT - 1}) // {CUT} - 1 AS i FROM p)"""
_EPOCHS = "WITH e AS (SELECT l_returnflag || '-' || l_linestatus AS run, CAST(l_linenumber AS INT) AS epoch, round(avg(CAST(l_discount AS DOUBLE)), 4) AS sum FROM lineitem GROUP BY 1, 2)"
_DRAW = "CAST('0x' || md5('7|' || text_id || '|' || sent_idx || '|' || token_idx)[{}:{}] AS BIGINT)"
_PLAIN = f"{with_(SEQUENCES)}, f AS (SELECT *, CASE WHEN gold = 'O' THEN '_' ELSE 'Smell\\_' || gold || '[' || number || ']|' || pred_a END AS labels FROM seq)"
SQL = {
    "cleaned_texts": f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents",
    "pre_tokens": f"SELECT doc_id, array_to_string({_PRE}, ' ') AS words FROM documents",
    "script_splits": f"""WITH w AS (SELECT DISTINCT unnest({_PRE}) AS word FROM documents), c AS (SELECT word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM w),
s AS (SELECT word, c, i, CASE {_SCRIPT} ELSE 'Common' END AS s FROM c), b AS (SELECT *, lag(s) OVER (PARTITION BY word ORDER BY i) AS b FROM s)
SELECT word, string_agg(CASE WHEN s IN ('Hiragana', 'Katakana') OR b <> s THEN ' ' || c ELSE c END, '' ORDER BY i) AS split FROM b GROUP BY word""",
    "split_rendering": f"""{with_(TOKENS, _WORDS)}, j AS (SELECT text_id, sent_idx, string_agg(w, '' ORDER BY token_idx) AS s, list(e) AS es FROM ends GROUP BY 1, 2), c AS (SELECT text_id, sent_idx, es, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) - 1 AS i FROM j)
SELECT text_id, sent_idx, string_agg(CASE WHEN i > 0 AND i % {CUT} = 0 THEN '|' || c WHEN list_contains(es, CAST(i AS INT)) AND i > 0 THEN ' ' || c ELSE c END, '' ORDER BY i) AS rendered FROM c GROUP BY 1, 2""",
    "nearest_boundaries": f"{_NEAR} SELECT text_id, sent_idx, string_agg(CAST(i AS VARCHAR), ',' ORDER BY token_idx) AS offsets, string_agg(CAST(place AS VARCHAR), ',' ORDER BY token_idx) AS places, CAST(count(DISTINCT i) AS INT) AS splits FROM i GROUP BY 1, 2",
    "subword_stats": f"""{with_(TOKENS)}, p AS (SELECT lang, text_id, sent_idx, token_idx, substr(token, CAST(2 * k + 1 AS INT), 2) AS piece FROM (SELECT *, unnest(range(CAST(greatest(1, ceil(length(token) / 2.0)) AS INT))) AS k FROM toks)), n AS (SELECT piece FROM p GROUP BY 1 HAVING count(*) >= 3),
q AS (SELECT lang, text_id, sent_idx, count(DISTINCT token_idx) AS words, count(*) AS subwords, count(*) FILTER (piece NOT IN (SELECT piece FROM n)) AS unknown FROM p GROUP BY 1, 2, 3) SELECT lang, count(*) AS sentences, sum(words)::BIGINT AS words, sum(subwords)::BIGINT AS subwords, sum(unknown)::BIGINT AS unknown FROM q GROUP BY 1""",
    "seqeval_report": f"""{with_(SEQUENCES, spans_sql("gold"), spans_sql("a"))}, g AS (SELECT text_id, sent_idx, "start", "end", label FROM gold_spans), p AS (SELECT text_id, sent_idx, "start", "end", label FROM a_spans),
n AS (SELECT (SELECT count(*) FROM (FROM g INTERSECT FROM p)) AS tp, (SELECT count(*) FROM (FROM p EXCEPT FROM g)) AS fp, (SELECT count(*) FROM (FROM g EXCEPT FROM p)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, (SELECT round(avg(CASE WHEN gold_bio = a_bio THEN 1.0 ELSE 0.0 END), 9) FROM bio) AS accuracy FROM n""",
    "best_epochs": f"{_EPOCHS} SELECT run, epoch, sum, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY sum DESC, epoch) AS rank FROM e) WHERE rank <= 2",
    "first_epoch_outlier": f"{_EPOCHS} SELECT run, max(epoch) > 4 AND coalesce(abs(avg(sum) - arg_min(sum, epoch)) > stddev_samp(sum), false) AS outlier FROM e GROUP BY 1",
    "batch_draws": """WITH g AS (SELECT o_orderpriority, count(*) // (16 + length(o_orderpriority)) + 1 AS n FROM orders GROUP BY 1), s AS (SELECT *, sqrt(n / (sum(n) OVER ())) / (SELECT sum(sqrt(n / t)) FROM g, (SELECT sum(n) AS t FROM g)) AS sm, n / (sum(n) OVER ()) AS share FROM g),
w AS (SELECT *, CAST(floor(n * sm / share + 1e-9) AS BIGINT) AS w FROM s), u AS (SELECT *, sum(w) OVER (ORDER BY o_orderpriority) AS upper FROM w), d AS (SELECT range AS draw, CAST('0x' || md5('11|' || range)[1:8] AS BIGINT) % (SELECT sum(w) FROM w) AS place FROM range((SELECT CAST(sum(n) AS BIGINT) FROM g)))
SELECT draw, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY draw) - 1) % n AS BIGINT) AS batch FROM d JOIN u ON place < upper AND place >= upper - w""",
    "masked_ids": f"""{with_(TOKENS)}, d AS (SELECT text_id, sent_idx, token_idx, length(token) AS id, {_DRAW.format(1, 8)} < {int(0.15 * 2**32)} AS m, {_DRAW.format(9, 16)} % 10 AS t, {_DRAW.format(17, 24)} % 1000 AS r FROM toks)
SELECT text_id, sent_idx, token_idx, CAST(CASE WHEN NOT m THEN id WHEN t < 8 THEN 103 WHEN t = 8 THEN r ELSE id END AS INT) AS input_id, CAST(CASE WHEN m THEN id ELSE -100 END AS INT) AS label_id FROM d""",
    "label_forms": f"""{_PLAIN}, k AS (SELECT *, gold <> 'O' AND pred_a = 'R' AS r, CASE WHEN gold <> 'O' AND pred_a = 'R' THEN 'R' WHEN gold <> 'O' AND pred_a = 'A' THEN 'A' WHEN gold = 'A' THEN 'Smell\\_A' ELSE 'O' END AS first FROM f)
SELECT text_id, sent_idx, token_idx, first, r AS has_r, CASE WHEN gold = 'O' THEN 'B-_' ELSE 'B-Smell_' || gold || '[' || number || ']' END AS clean, token AS bare, regexp_replace(regexp_replace(token, '(.{{3}})', '\\1 ##', 'g'), ' ##$', '') AS marked FROM k""",
    "label_id_rows": f"""{with_(SEQUENCES)}, v AS (SELECT l, row_number() OVER (ORDER BY l) AS id FROM (SELECT DISTINCT gold_bio AS l FROM bio WHERE fold = 0 AND gold_bio <> 'B-R')) SELECT text_id, sent_idx, token_idx, gold_bio, CAST(coalesce(id, 0) AS INT) AS label_id FROM bio LEFT JOIN v ON l = gold_bio""",
    "stacked_labels": f"""{_PLAIN}, h AS (SELECT *, CASE WHEN gold <> 'O' THEN pred_a END AS second, CASE WHEN gold <> 'O' THEN gold || number END AS head FROM f),
b AS (SELECT *, lag(second) OVER w AS before, lag(head) OVER w AS head_before FROM h WINDOW w AS (PARTITION BY text_id, sent_idx ORDER BY token_idx))
SELECT text_id, sent_idx, token_idx, CASE WHEN second IS NULL OR second <> 'A' THEN 'O' WHEN before = 'A' THEN 'I-A' ELSE 'B-A' END AS label_0, CASE WHEN second IS NULL OR second <> 'R' THEN 'O' WHEN before = 'R' THEN 'I-R' ELSE 'B-R' END AS label_1, CASE WHEN head IS NULL THEN 'O' WHEN head = head_before THEN 'I-Smell_' || gold ELSE 'B-Smell_' || gold END AS label_2 FROM b""",
}
QUERIES = {f.__name__: f for f in (cleaned_texts, pre_tokens, script_splits, split_rendering, nearest_boundaries, tokenization_labels, subword_stats, seqeval_report, best_epochs, first_epoch_outlier, batch_draws, masked_ids, label_forms, label_id_rows, stacked_labels)}
