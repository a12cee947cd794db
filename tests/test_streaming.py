"""A stream of tokens gives the spans of its sentences once they are closed."""

from datetime import datetime, timedelta

from spanloom.streaming.spans import stream_spans

SCHEMA = "text_id string, sent_idx int, token_idx int, token string, label string, edited_at timestamp"


def test_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    batches = [
        [("t", 1, 2, "b", "I-X", at(1)), ("t", 1, 1, "a", "B-X", at(0)), ("t", 1, 3, "old", "O", at(1))],
        [("t", 1, 3, "c", "I-Y", at(2)), ("t", 2, 1, "d", "O", at(3)), ("u", 1, 1, "e", "B-X", at(60))],
        [("v", 1, 1, "f", "O", at(200))],
        [("v", 2, 1, "g", "O", at(201))],
    ]
    source = str(tmp_path / "in")
    query = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if query is None:
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            query = stream_spans(stream).writeStream.format("memory").queryName("spans_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("spans_out").collect()))
    assert got == [("t", 1, 1, 3, "a b", "X"), ("t", 1, 3, 4, "c", "Y"), ("u", 1, 1, 2, "e", "X")]
