import datetime
import random

from pyspark.sql import functions as F

from tests.harness import SF, same
from textloom.jobs.queries import ORACLES
from textloom.storage import read_table
from textloom.streaming.values import held_values, newest_values, replay, state_on_disk

SCHEMA = "user string, value double, ts timestamp, held string"
T = datetime.datetime(2024, 1, 1)


def _files(spark, path, batches):
    """One file, and so with one file a trigger one micro-batch, for each list of (user, value, seconds)."""
    for i, rows in enumerate(batches):
        made = [(u, v, None if s is None else T + datetime.timedelta(seconds=s), "x") for u, v, s in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_late_values_do_not_replace_newer_ones_and_old_ones_leave(spark, tmp_path):
    batches = [[("u", 1.0, 0), ("v", 2.0, 5), ("v", 9.0, 5)], [("u", 4.0, 50), ("u", 3.0, 20)], [("u", 5.0, 30), (None, 1.0, 9), ("n", None, 9), ("n", 1.0, None)], [("w", 6.0, 130)], [("late", 7.0, 1)]]
    check, out = f"file://{tmp_path}/check", f"file://{tmp_path}/out"
    held = replay(_files(spark, tmp_path / "in", batches), "user", 60, "20 seconds", check, out)
    # The watermark ends at 110 seconds: u (50 + 60) and v (5 + 60) are over, the last row is dropped as late.
    assert [(r.user, r.value) for r in held.collect()] == [("w", 6.0)]
    changes = sorted((r.user, r.expires_ms // 1000 - int(T.replace(tzinfo=datetime.UTC).timestamp()), r.change, r.value) for r in spark.read.parquet(out).collect())
    assert changes == [("u", 60, "stored", 1.0), ("u", 110, "expired", 4.0), ("u", 110, "stored", 4.0), ("v", 65, "expired", 9.0), ("v", 65, "stored", 9.0), ("w", 190, "stored", 6.0)]
    # A stream that goes on from its checkpoint holds what it held.
    stream = _files(spark, tmp_path / "in", batches[:0])
    spark.createDataFrame([("w", 1.0, T + datetime.timedelta(seconds=120), "x"), ("x", 8.0, T + datetime.timedelta(seconds=140), "x"), ("x", float("nan"), T + datetime.timedelta(seconds=141), "x")], SCHEMA).write.parquet(f"{tmp_path}/in/900")
    again = replay(stream, "user", 60, "20 seconds", check, out)
    assert sorted((r.user, r.value) for r in again.collect()) == [("w", 6.0), ("x", 8.0)]


def test_an_empty_stream_holds_nothing(spark, tmp_path):
    with state_on_disk(spark):
        changes = newest_values(_files(spark, tmp_path / "in", [[]]), "user", 60)
        query = changes.writeStream.format("memory").queryName("none").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("none").count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_shuffled_stream_equals_sql(spark, tmp_path):
    """Events in files out of order, within the lateness, hold what SQL finds alive."""
    rows = read_table(spark, SF, "events").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).orderBy("ts").collect()
    rng = random.Random(5)
    mixed = sorted(rows, key=lambda r: r.ts.timestamp() + rng.uniform(0, 40_000))
    size = len(mixed) // 4 + 1
    for i in range(0, len(mixed), size):
        spark.createDataFrame(mixed[i : i + size], "event_id long, key string, ts timestamp, value double").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i:06d}")
    stream = spark.readStream.schema("event_id long, key string, ts timestamp, value double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    held = replay(stream, "key", 3600, "1 day", f"file://{tmp_path}/check", f"file://{tmp_path}/out")
    asked = spark.createDataFrame(mixed, "event_id long, key string, ts timestamp, value double").select("event_id", "key")
    same(asked.join(held.select("key", "value"), "key", "left").select("event_id", "key", "value", F.col("value").isNotNull().alias("hit")), ORACLES["cache_hit_miss"])
    assert held_values(spark, f"file://{tmp_path}/check", "key").count() == held.count()
