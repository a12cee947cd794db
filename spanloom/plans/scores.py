"""Queries that score labels and spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import score
from spanloom.operators.match import overlap_join
from spanloom.operators.labels import SENTENCE
from spanloom.operators.spans import begin_spans, by_side
from spanloom.plans.adapters import SEQUENCES, keyed_spans, labelled, side_spans, spans_of, spans_sql, with_
from spanloom.plans.spans import BOTH, PAIRS

RUN = ("lang", "fold", "model")
DIGITS = 9


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at DIGITS places: sums differ in their last bits with the order of addition."""
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _frame(spark: SparkSession, sf_dir: str, count: str = "pairs") -> DataFrame:
    gold, pred = side_spans(spark, sf_dir, "gold", "a")
    return score.match_frame(overlap_join(gold, pred), gold, pred, count=count)


def match_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_frame(spark, sf_dir))


def match_frame_by_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_frame(spark, sf_dir, "spans"))


def score_strict_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.strict_lenient(_frame(spark, sf_dir)))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = keyed_spans(spark, sf_dir)
    return score.match_frame(overlap_join(gold, pred, by=RUN), gold, pred, RUN)


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.strict_lenient(_runs(spark, sf_dir), RUN).where("row_kind <> 'average'").drop("row_kind"))


def fold_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _runs(spark, sf_dir).groupBy("lang", "model", "label").agg(F.avg("lenient_f1").alias("mean"), F.stddev_samp("lenient_f1").alias("std"))
    return rounded(per)


def model_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _runs(spark, sf_dir).groupBy("lang", "fold", "label").pivot("model", ["a", "b"]).agg(F.max("lenient_f1"))
    return rounded(wide.withColumn("diff", F.col("a") - F.col("b")))


def metric_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_runs(spark, sf_dir).where("row_kind = 'label'").groupBy("model").agg(F.corr("exact_f1", "lenient_f1").alias("corr")))


def legacy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.legacy_score(*side_spans(spark, sf_dir, "gold", "a")))


def error_typology(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = keyed_spans(spark, sf_dir)
    only = lambda df: df.where("model = 'a'")
    return score.error_typology(overlap_join(only(gold), only(pred), by=("lang",)), "lang")


def docs_without_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = spans_of(spark, sf_dir).groupBy("text_id").pivot("label", ["A", "R"]).agg(F.count(F.lit(1))).na.fill(0, ["A", "R"])
    return per.where("A = 0").select("text_id", F.col("R").alias("others"))


def span_length_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans_of(spark, sf_dir).withColumn("length", F.col("end") - F.col("start"))
    return rounded(score.describe(rows, "length", "label"))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.metric(labelled(spark, sf_dir), "accuracy", "lang", gold="gold_bio", pred="a_bio"))


def avg_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("lang", F.length("gold_bio").alias("gold"), F.length("a_bio").alias("pred"))
    return rounded(score.metric(rows, "avg_dist", "lang"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("lang", (F.length("token") / F.lit(4.0)).alias("loss"))
    return rounded(score.metric(rows, "perplexity", "lang"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = labelled(spark, sf_dir).groupBy("lang", "text_id", "sent_idx").agg(F.collect_set("gold").alias("gold"), F.collect_set("pred_a").alias("pred"))
    return per


def multi_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.metric(_sets(spark, sf_dir), "multi_acc", "lang"))


def las(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("lang", F.col("number").alias("gold_head"), (F.length("token") % 2).alias("pred_head"), F.col("gold").alias("gold_rel"), F.col("pred_a").alias("pred_rel"))
    return rounded(score.metric(rows, "las", "lang"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.token_counts(labelled(spark, sf_dir), "gold_bio", "a_bio")


def token_f1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def token_f1_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.f1_micro(_counts(spark, sf_dir)))


VOCABULARY = ("@@unkORpad@@", "O", "B-A", "I-A", "B-R", "I-R")


def _vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(VOCABULARY, range(len(VOCABULARY)))), "label string, id int")


def token_f1_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.f1_macro(_counts(spark, sf_dir), _vocabulary(spark)))


def token_f1_macro_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.f1_macro(_counts(spark, sf_dir), _vocabulary(spark), "faithful"))


def token_f1_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.f1_binary(_counts(spark, sf_dir), "B-A"))


SPAN_KEY = ["text_id", "sent_idx", "start", "end", "label"]


def _span_f1(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = by_side(labelled(spark, sf_dir), {"gold": "gold_bio", "a": "a_bio"})
    return rounded(score.side_counts(begin_spans(rows, "l", mode, (*SENTENCE, "side")), SPAN_KEY))


def span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_f1(spark, sf_dir, "corrected")


def span_f1_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_f1(spark, sf_dir, "faithful")


def metric_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda df, name: df.select("lang", F.lit(name).alias("metric"), F.col(name).alias("value"))
    return rounded(score.metric_sum(long(accuracy(spark, sf_dir), "accuracy").unionByName(long(perplexity(spark, sf_dir), "perplexity")), "lang"))


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(accuracy, "accuracy"), (multi_acc, "multi_acc"), (las, "las"), (avg_dist, "avg_dist"), (perplexity, "perplexity")]
    line: Column = F.concat(F.col("lang"), F.lit(" "), F.col("metric"), F.lit(": "), F.format_number("value", 4))
    return reduce(DataFrame.unionByName, [f(spark, sf_dir).select("lang", F.lit(n).alias("metric"), F.col(n).alias("value")) for f, n in parts]).select(line.alias("line"))


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN NULL ELSE {a} / {b} END"


def frame_sql(by: tuple[str, ...] = (), hits: str = "") -> str:
    """CTEs that end with ``frame`` over counts(by, label, t, q, e, p)."""
    g = "".join(f"{c}, " for c in by)
    on = "".join(f" AND x.{c} = w.{c}" for c in by)
    f1 = lambda k: f"CASE WHEN {k}_prec + {k}_rec = 0 THEN 0 ELSE 2 * {k}_prec * {k}_rec / ({k}_prec + {k}_rec) END AS {k}_f1"
    return f"""per AS (SELECT {g}label, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(q) AS DOUBLE) AS q, CAST(sum(e) AS DOUBLE) AS e, CAST(sum(p) AS DOUBLE) AS p FROM counts GROUP BY ALL),
whole AS (SELECT {g}sum(t) AS t, sum(q) AS q, sum(e) AS e, sum(p) AS p FROM per {"GROUP BY " + ", ".join(by) if by else ""}),
both_ AS (SELECT {g}label, 'label' AS row_kind, t, q, e, p FROM per UNION ALL SELECT {g}'Overall', 'overall', t, q, e, p FROM whole),
ratios AS (SELECT {"".join(f"x.{c}, " for c in by)}label, row_kind, x.t AS test_freq, x.q AS pred_freq, x.e AS exact_freq, x.p AS partial_freq, x.t - x.e - x.p AS missing, x.e + x.p AS lenient_freq,
 {_ratio("x.e", "w.e")} AS exact_prop, {_ratio("x.p", "w.p")} AS partial_prop, {_ratio("(x.e + x.p)", "(w.e + w.p)")} AS lenient_prop, {_ratio("x.e", "x.t")} AS exact_frac, {_ratio("x.p", "x.t")} AS partial_frac,
 {_ratio("x.e", "x.q")} AS exact_prec, {_ratio("x.e", "x.t")} AS exact_rec, {_ratio("(x.e + x.p)", "x.q")} AS lenient_prec, {_ratio("(x.e + x.p)", "x.t")} AS lenient_rec FROM both_ x JOIN whole w ON true{on}),
frame AS (SELECT *, {f1("exact")}, {f1("lenient")} FROM ratios)"""


COUNTS = """counts AS (SELECT label, 1 AS t, 0 AS q, 0 AS e, 0 AS p FROM gold_spans UNION ALL SELECT label, 0, 1, 0, 0 FROM a_spans
 UNION ALL SELECT test_label, 0, 0, CAST(match_type = 'exact' AS INT), CAST(match_type = 'partial' AS INT) FROM pairs WHERE match_type IN ('exact', 'partial'))"""
FRAME = f"{PAIRS}, {COUNTS}, {frame_sql()}"
NUMBERS = ["test_freq", "pred_freq", "exact_freq", "partial_freq", "missing", "lenient_freq", "exact_prop", "partial_prop", "lenient_prop", "exact_frac", "partial_frac", "exact_prec", "exact_rec", "lenient_prec", "lenient_rec", "exact_f1", "lenient_f1"]


def _round(columns: list[str] | tuple[str, ...], source: str = "") -> str:
    return ", ".join(f"round({source}{c}, {DIGITS}) AS {c}" for c in columns)


_SIDES = f"""{with_(SEQUENCES, spans_sql("gold"), spans_sql("a"), spans_sql("b"))},
g AS (SELECT *, unnest(['a', 'b']) AS model FROM gold_spans), q AS (SELECT *, 'a' AS model FROM a_spans UNION ALL SELECT *, 'b' FROM b_spans),
hits AS (SELECT g.lang, g.fold, g.model, g.label, g."start" = q."start" AND g."end" = q."end" AND g.text = q.text AS same FROM g JOIN q ON g.text_id = q.text_id AND g.sent_idx = q.sent_idx AND g.label = q.label AND g.model = q.model AND g."start" < q."end" AND q."start" < g."end"),
counts AS (SELECT lang, fold, model, label, 1 AS t, 0 AS q, 0 AS e, 0 AS p FROM g UNION ALL SELECT lang, fold, model, label, 0, 1, 0, 0 FROM q UNION ALL SELECT lang, fold, model, label, 0, 0, CAST(same AS INT), CAST(NOT same AS INT) FROM hits), {frame_sql(RUN)}"""
_TOKEN = """, merged AS (SELECT replace(gold_bio, 'I-', 'B-') AS g, replace(a_bio, 'I-', 'B-') AS p FROM bio),
cells AS (SELECT g AS label, CAST(g = p AS INT) AS tp, 0 AS fp, CAST(g <> p AS INT) AS fn FROM merged UNION ALL SELECT p, 0, CAST(g <> p AS INT), 0 FROM merged),
counts AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM cells GROUP BY 1)"""
_PRF = lambda source: f"""(SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM {source}))"""
_PRF_COLUMNS = f"tp, fp, fn, {_round(['precision', 'recall', 'f1'])}"
_MACRO = lambda kept: f"""{with_(SEQUENCES)}{_TOKEN}, slots AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES ('O'), ('B-A'), ('I-A'), ('B-R'), ('I-R')) v(label) LEFT JOIN counts USING (label) WHERE {kept}),
per AS (SELECT * FROM {_PRF("slots")}) SELECT label, {_PRF_COLUMNS} FROM per UNION ALL SELECT 'macro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), round(avg(precision), {DIGITS}), round(avg(recall), {DIGITS}), round(avg(f1), {DIGITS}) FROM per"""  # noqa: E731


def _span_f1_sql(end: str) -> str:
    side = lambda s: f"""{s}_p AS (SELECT text_id, sent_idx, {s}_bio AS l, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY text_id, sent_idx) AS n FROM bio WINDOW w AS (PARTITION BY text_id, sent_idx ORDER BY token_idx)),
{s}_s AS (SELECT *, min(CASE WHEN l NOT LIKE 'I%' THEN p END) OVER (PARTITION BY text_id, sent_idx ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM {s}_p),
{s}_k AS (SELECT DISTINCT text_id, sent_idx, p AS b, coalesce(s, {end}) AS e, substr(l, 3) AS label FROM {s}_s WHERE l LIKE 'B%')"""  # noqa: E731
    return f"""{with_(SEQUENCES)}, {side("gold")}, {side("a")}, n AS (SELECT (SELECT count(*) FROM (SELECT * FROM gold_k INTERSECT SELECT * FROM a_k)) AS tp, (SELECT count(*) FROM a_k) AS q, (SELECT count(*) FROM gold_k) AS g),
c AS (SELECT tp, q - tp AS fp, g - tp AS fn FROM n) SELECT {_PRF_COLUMNS} FROM {_PRF("c")}"""


_ACC = f"round(avg(CAST(gold_bio = a_bio AS DOUBLE)), {DIGITS})"
_PPL = f"round(exp(avg(length(token) / 4.0)), {DIGITS})"
SQL = {
    "match_frame": f"{FRAME} SELECT label, row_kind, {_round(NUMBERS)} FROM frame",
    "match_frame_by_span": f"""{PAIRS}, one AS (SELECT test_text_id, test_sent_idx, test_start, test_end, test_label AS label, max(CASE match_type WHEN 'exact' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS r FROM pairs WHERE test_start IS NOT NULL GROUP BY ALL),
counts AS (SELECT label, 1 AS t, 0 AS q, 0 AS e, 0 AS p FROM gold_spans UNION ALL SELECT label, 0, 1, 0, 0 FROM a_spans UNION ALL SELECT label, 0, 0, CAST(r = 2 AS INT), CAST(r = 1 AS INT) FROM one), {frame_sql()} SELECT label, row_kind, {_round(NUMBERS)} FROM frame""",
    "score_strict_lenient": f"""{FRAME} SELECT label, row_kind, {_round(score.SCORES)} FROM frame
UNION ALL SELECT 'macro_avg', 'average', {", ".join(f"round(avg({c}), {DIGITS})" for c in score.SCORES)} FROM frame WHERE row_kind = 'label'
UNION ALL SELECT 'weight_avg', 'average', {", ".join(f"round(coalesce(sum({c} * {c.split('_')[0]}_prop), 0), {DIGITS})" for c in score.SCORES)} FROM frame WHERE row_kind = 'label'""",
    "run_scores": f"{_SIDES} SELECT lang, fold, model, label, {_round(score.SCORES)} FROM frame",
    "fold_mean_std": f"{_SIDES} SELECT lang, model, label, round(avg(lenient_f1), {DIGITS}) AS mean, round(stddev_samp(lenient_f1), {DIGITS}) AS std FROM frame GROUP BY ALL",
    "model_diff": f"{_SIDES}, w AS (SELECT lang, fold, label, max(lenient_f1) FILTER (model = 'a') AS a, max(lenient_f1) FILTER (model = 'b') AS b FROM frame GROUP BY ALL) SELECT lang, fold, label, {_round(['a', 'b'])}, round(a - b, {DIGITS}) AS diff FROM w",
    "metric_corr": f"{_SIDES} SELECT model, round(corr(exact_f1, lenient_f1), {DIGITS}) AS corr FROM frame WHERE row_kind = 'label' GROUP BY 1",
    "legacy_score": f"""{BOTH}, tp AS (SELECT x.* FROM a_spans x SEMI JOIN gold_spans y USING (text_id, sent_idx, "start", "end", text, label)), go AS (SELECT x.* FROM gold_spans x ANTI JOIN a_spans y USING (text_id, sent_idx, "start", "end", text, label)), po AS (SELECT x.* FROM a_spans x ANTI JOIN gold_spans y USING (text_id, sent_idx, "start", "end", text, label)),
m AS (SELECT p.label, p.text_id, p.sent_idx, p."start", p."end" FROM po p JOIN go g ON p.text_id = g.text_id AND p.sent_idx = g.sent_idx AND p.label = g.label AND p."end" >= g."start" AND g."end" >= p."start"),
ls AS (SELECT DISTINCT label FROM gold_spans UNION SELECT DISTINCT label FROM a_spans),
n AS (SELECT label, (SELECT count(*) FROM gold_spans x WHERE x.label = ls.label) AS support, (SELECT count(*) FROM a_spans x WHERE x.label = ls.label) AS q, (SELECT count(*) FROM tp x WHERE x.label = ls.label) AS true_pred, (SELECT count(*) FROM go x WHERE x.label = ls.label) AS true_only,
 (SELECT count(*) FROM po x WHERE x.label = ls.label) AS pred_only, (SELECT count(*) FROM m x WHERE x.label = ls.label) AS true_partial, (SELECT count(*) FROM (SELECT DISTINCT * FROM m) x WHERE x.label = ls.label) AS pred_partial FROM ls),
r AS (SELECT label, support, true_pred, true_only, pred_only, true_partial, pred_partial, true_pred / q AS ps, (true_pred + pred_partial) / q AS pl, true_pred / support AS rs, (true_pred + true_partial) / support AS rl FROM n)
SELECT label, support, true_pred, true_only, pred_only, true_partial, pred_partial, round(ps, {DIGITS}) AS precision_strict, round(pl, {DIGITS}) AS precision_lenient, round(rs, {DIGITS}) AS recall_strict, round(rl, {DIGITS}) AS recall_lenient, round(2 * ps * rs / (ps + rs), {DIGITS}) AS f1_strict, round(2 * pl * rl / (pl + rl), {DIGITS}) AS f1_lenient FROM r""",
    "error_typology": f"""{PAIRS}, k AS (SELECT ['de', 'en', 'fr'][CAST(CAST(coalesce(test_text_id, pred_text_id) AS BIGINT) % 3 + 1 AS INT)] AS lang, coalesce(test_label, pred_label) AS label, coalesce(test_text_id, pred_text_id) AS t, coalesce(test_sent_idx, pred_sent_idx) AS s, count(*) FILTER (match_type = 'miss_pred') AS m, count(*) FILTER (match_type = 'miss_test') AS h, count(test_start) AS g FROM pairs GROUP BY 1, 2, 3, 4)
SELECT lang, label, count(*) FILTER (m = 0 AND h > 0) AS hallucinated, count(*) FILTER (m > 0 AND h = 0) AS missed, count(*) FILTER (m > 0 AND h > 0) AS misplaced, CAST(sum(g) AS BIGINT) AS total FROM k GROUP BY 1, 2""",
    "docs_without_anchor": f"{BOTH} SELECT text_id, count(*) FILTER (label = 'R') AS others FROM gold_spans GROUP BY 1 HAVING count(*) FILTER (label = 'A') = 0",
    "span_length_describe": f"""{BOTH}, l AS (SELECT label, "end" - "start" AS v FROM gold_spans) SELECT label, count(v) AS "count", round(avg(v), {DIGITS}) AS mean, round(stddev_samp(v), {DIGITS}) AS std, CAST(min(v) AS DOUBLE) AS min, {", ".join(f"round(quantile_cont(v, {q}), {DIGITS}) AS q{n}" for q, n in ((0.25, 25), (0.5, 50), (0.75, 75)))}, CAST(max(v) AS DOUBLE) AS max FROM l GROUP BY 1""",
    "accuracy": f"{with_(SEQUENCES)} SELECT lang, {_ACC} AS accuracy FROM bio GROUP BY 1",
    "avg_dist": f"{with_(SEQUENCES)} SELECT lang, round(avg(abs(length(gold_bio) - length(a_bio))), {DIGITS}) AS avg_dist FROM bio GROUP BY 1",
    "perplexity": f"{with_(SEQUENCES)} SELECT lang, {_PPL} AS perplexity FROM bio GROUP BY 1",
    "multi_acc": f"{with_(SEQUENCES)}, s AS (SELECT lang, text_id, sent_idx, list_sort(list(DISTINCT gold)) = list_sort(list(DISTINCT pred_a)) AS same FROM seq GROUP BY 1, 2, 3) SELECT lang, round(avg(CAST(same AS DOUBLE)), {DIGITS}) AS multi_acc FROM s GROUP BY 1",
    "las": f"{with_(SEQUENCES)} SELECT lang, round(avg(CAST(number = length(token) % 2 AND gold = pred_a AS DOUBLE)), {DIGITS}) AS las FROM seq GROUP BY 1",
    "token_f1_counts": f"{with_(SEQUENCES)}{_TOKEN} SELECT * FROM counts",
    "token_f1_micro": f"{with_(SEQUENCES)}{_TOKEN}, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counts) SELECT {_PRF_COLUMNS} FROM {_PRF('s')}",
    "token_f1_macro": _MACRO("tp + fp + fn > 0"),
    "token_f1_macro_faithful": _MACRO("label <> 'I-R'"),
    "token_f1_binary": f"{with_(SEQUENCES)}{_TOKEN}, s AS (SELECT tp, fp, fn FROM counts WHERE label = 'B-A') SELECT {_PRF_COLUMNS} FROM {_PRF('s')}",
    "span_f1": _span_f1_sql("n"),
    "span_f1_faithful": _span_f1_sql("n - 1"),
    "metric_sum": f"{with_(SEQUENCES)} SELECT lang, round({_ACC} + 1 / {_PPL}, {DIGITS}) AS sum FROM bio GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (match_frame, match_frame_by_span, score_strict_lenient, run_scores, fold_mean_std, model_diff, metric_corr, legacy_score, error_typology, docs_without_anchor, span_length_describe, accuracy, avg_dist, perplexity, multi_acc, las, token_f1_counts, token_f1_micro, token_f1_macro, token_f1_macro_faithful, token_f1_binary, span_f1, span_f1_faithful, metric_sum, metric_table)}
