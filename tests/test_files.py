"""Readers and writers: what is written is read back; lines of other kinds are told apart."""

import json

from pyspark.sql import functions as F

from spanloom.operators.labels import barred, iob2_stacked, parse_labels, tag_columns
from spanloom.sources import readers, writers
from spanloom.sources.prose import paragraphs, prose_of

ANNO = """#FORMAT=WebAnno TSV 3.2

#Text=De reuk
1-1\t0-2\tDe\t_\t
1-2\t3-7\treuk\tSmell\\_Word[4]|Quality\t_
1-3\t7-8\t.\t_
2-1\t9-14\tfo rt\tQuality[2]\t
x1-1\t0-2\tno\t_\t

"""


def folder(tmp_path, files):
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_web_anno(spark, tmp_path):
    path = folder(tmp_path, {"Nürn berg.txt/a.tsv": ANNO, "Nürn berg.txt/b.tsv": "1-1\t0-1\tx\t_\t\n", "Two/c.tsv": "", "Two/d.txt": ANNO})
    rows = readers.read_web_anno(spark, path)
    got = {(r.text_id, r.sent_idx, r.token_idx): r for r in rows.where("token <> 'x'").collect()}
    assert set(got) == {("Nürn_berg", 1, 1), ("Nürn_berg", 1, 2)}
    r = got["Nürn_berg", 1, 2]
    assert (r.char_start, r.char_end, r.token) == (3, 7, "reuk") and [tuple(x) for x in r.labels] == [("Smell\\_Word", 4), ("Quality", None)]
    assert [r.token for r in readers.read_web_anno(spark, path, mode="faithful").collect()] == ["x"]
    assert [tuple(x) for x in readers.read_web_anno(spark, path, ["Quality"]).where("token = 'reuk'").first().labels] == [("Quality", None)]


def test_folds_and_predictions(spark, tmp_path):
    tokens = spark.createDataFrame([("t", s, k, k * 2, k * 2 + 1, f"w{s}{k}", f, "train") for f in (0, 1) for s in (1, 2, 10) for k in (1, 2, 3)], "text_id string, sent_idx int, token_idx int, char_start int, char_end int, token string, fold_num int, split string")
    tokens = tokens.withColumn("tag", F.when(F.col("token_idx") == 2, "B-X").otherwise("O"))
    path = str(tmp_path / "folds")
    writers.write_folds(tokens, path, ["tag"])
    text = next((tmp_path / "folds" / "fold_num=0" / "split=train").glob("*.txt")).read_text()
    assert text.split("\n\n")[0] == "t\t1-1\t2-3\tw11\tO\t\nt\t1-2\t4-5\tw12\tB-X\t\nt\t1-3\t6-7\tw13\tO\t" and text.index("w23") < text.index("w101")
    back = readers.read_folds(spark, path + "/fold_num=0")
    assert sorted((r.sent_idx, r.token_idx, r.token, r.tag) for r in back.collect()) == sorted((r.sent_idx, r.token_idx, r.token, r.tag) for r in tokens.where("fold_num = 0").collect())
    out = str(tmp_path / "pred")
    labelled = tokens.where("fold_num = 0").withColumn("labels", F.array(F.col("tag"), F.lit("O"), F.lit("")))
    writers.write_predictions(labelled, out)
    read = readers.read_predictions(spark, out)
    assert {len(r.labels) for r in read.collect()} == {3} and {len(r.labels) for r in readers.read_predictions(spark, out, mode="faithful").collect()} == {2}
    assert readers.melt_labels(read, ["text_id"]).where("layer = 4 and label = 'B-X'").count() == 3
    single = folder(tmp_path / "one", {"p.tsv": "t\t1\t2\tw\tO\tB-X\n\n"})
    r = readers.read_predictions(spark, single, sent_token=False).first()
    assert (r.sent_idx, r.token_idx, r.token, r.labels) == (1, 2, "w", ["O", "B-X"])
    assert readers.read_fold_table(spark, path + "/fold_num=0").where("Word = 'w11'").first().Num == "1-1"


def test_sentences_rows_and_vocabularies(spark, tmp_path):
    path = folder(tmp_path / "s", {"a.conll": "# text = a b\n# sent: POS\n1\ta\tX\n2\tb\tY\n\n\n1\tc\tZ\n"})
    got = {r.sentence: r for r in readers.read_sentences(spark, path).withColumn("label", readers.sentence_label(F.col("comments"), "sent")).collect()}
    assert got[1].rows == [["1", "a", "X"], ["2", "b", "Y"]] and got[1].label == "POS" and got[2].rows == [["1", "c", "Z"]] and got[2].label is None
    path = folder(tmp_path / "c", {"a.tsv": "text\tlabel\nx\n\ngood\t1\n"})
    assert [r["columns"] for r in readers.read_rows(spark, path, skip_first_line=True).collect()] == [["good", "1"]]
    path = folder(tmp_path / "p", {"a.txt": "a b c\n\n d\n"})
    assert [(r.sentence, r.words) for r in readers.read_plain(spark, path, 2).orderBy("sentence").collect()] == [(1, ["a", "b"]), (2, ["", "d"])]
    path = folder(tmp_path / "t", {"a.tsv": "a\tO\nb\tB-X\n\nc\tO\n"})
    assert sorted((r.sentence, r.row, r.token) for r in readers.read_tags(spark, path).collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    vocab = spark.createDataFrame([("O", 1), ("@@unkORpad@@", 0), ("B-X", 2)], "label string, id int")
    writers.write_vocabulary(vocab, str(tmp_path / "v"))
    assert {r.label: r.id for r in readers.read_vocabulary(spark, str(tmp_path / "v")).collect()} == {"@@unkORpad@@": 0, "O": 1, "B-X": 2}


def test_scores_and_merging(spark, tmp_path):
    long = spark.createDataFrame([("Time", "span_f1", "precision", 0.5), ("Time", "span_f1", "recall", 0.25), ("Place", "f1", "x", 1.0)], "task string, metric string, name string, value double")
    text = writers.score_tree(long).first().value
    assert json.loads(text) == {"Time": {"span_f1": {"precision": 0.5, "recall": 0.25}}, "Place": {"f1": {"x": 1.0}}}
    path = folder(tmp_path, {"a.eval": json.dumps({**json.loads(text), "sum": 3.0, "Other": {"optimization_metrics": "f", "f": {"f": 1.5, "sum": "f"}}})})
    got = {(r.task, r.metric, r.name): r.value for r in readers.read_scores(spark, path).collect()}
    assert got == {("Time", "span_f1", "precision"): 0.5, ("Time", "span_f1", "recall"): 0.25, ("Place", "f1", "x"): 1.0, ("Other", "f", "f"): 1.5}
    original = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d", "e", "f"])], "k int, row array<string>")
    merged = writers.merged_rows(original, spark.createDataFrame([(1, "B")], "k int, new string"), ["k"], {1: "new"})
    assert {r.k: r.row for r in merged.collect()} == {1: ["a", "B", "c"], 2: ["d", "e", "f"]}
    assert readers.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert readers.reader_for([]) == "raw" and readers.reader_for(["classification"]) == "classification" and readers.reader_for(["mlm"]) == "mlm" and readers.reader_for(["seq", "classification"]) == "sequence"
    assert readers.task_layout(["A", "B"], 3, "x", "y", "z")["tasks"]["B"]["column_idx"] == 5


def test_stacked_labels(spark):
    rows = [("t", 1, 1, "A[1]|B[2]"), ("t", 1, 2, "B[2]|A[1]"), ("t", 1, 3, "A[3]"), ("t", 2, 1, "A[3]"), ("t", 2, 2, "_")]
    df = spark.createDataFrame(rows, "text_id string, sent_idx int, token_idx int, labels string").withColumn("p", parse_labels(F.col("labels"), ["A", "B"]))
    assert [r[0] for r in df.orderBy("sent_idx", "token_idx").select(barred(F.col("p"))).collect()] == ["A[1]|B[2]", "A[1]|B[2]", "A[3]", "A[3]", "_"]
    show = lambda mode: [(r.label_0, r.label_1) for r in iob2_stacked(df, "p", tag_columns(["A", "B"], "MULTITASK"), mode).orderBy("sent_idx", "token_idx").collect()]
    assert show("corrected") == [("B-A", "B-B"), ("I-A", "I-B"), ("B-A", "O"), ("B-A", "O"), ("O", "O")]
    assert show("faithful") == [("B-A", "O"), ("I-A", "O"), ("B-A", "O"), ("B-A", "O"), ("O", "O")]


def test_prose(spark):
    xml = '<body><div lang="nl"><p>een</p><p lang="fr">deux</p><p>een</p><div ebook-type="poem"><p>vers</p></div></div><div lang="en"><p lang="nl"> twee\n woorden </p><p>three</p></div></body>'
    books = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "k int, xml string")
    rows = paragraphs(books, "k", "xml")
    assert rows.count() == 6
    assert [(r.k, r.text) for r in prose_of(rows, "k").orderBy("ord").collect()] == [(1, "een"), (1, "twee woorden")]
