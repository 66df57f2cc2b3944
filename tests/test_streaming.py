import datetime

from pyspark.sql import functions as F

from textloom.streaming.ingest import ingest_batch, ingest_stream, open_collection
from textloom.streaming.limits import fresh_values, rate_limits


def test_ingest_stream_adds_documents_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, "c")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    store = open_collection(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    ingest_stream(stream, store, str(tmp_path / "check")).awaitTermination()
    before = store.read().count()
    ingest_batch(docs, store)
    assert store.read().count() == before == 2


def _events(spark, path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("u", 1.0, t), ("u", 2.0, t + datetime.timedelta(seconds=30)), ("u", 3.0, t + datetime.timedelta(seconds=90)), ("v", 4.0, t)]
    spark.createDataFrame(rows, "user string, value double, ts timestamp").coalesce(1).write.parquet(str(path))
    return spark.readStream.schema("user string, value double, ts timestamp").parquet(str(path))


def test_rate_limits_in_a_stream(spark, tmp_path):
    out = rate_limits(_events(spark, tmp_path / "e"), "user", "1 minute", 1)
    query = out.writeStream.format("memory").queryName("limits").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.user, r.requests, r.limited) for r in spark.table("limits").collect()) == [("u", 1, False), ("u", 2, True), ("v", 1, False)]


def test_values_are_fresh_for_a_time(spark, tmp_path):
    out = fresh_values(_events(spark, tmp_path / "e"), "user", 60)
    query = out.writeStream.format("memory").queryName("fresh").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = [(r.user, r.value, r.hit) for r in spark.table("fresh").orderBy("user", F.col("ts")).collect()]
    assert got == [("u", 1.0, False), ("u", 1.0, True), ("u", 3.0, False), ("v", 4.0, False)]
