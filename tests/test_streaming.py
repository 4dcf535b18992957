from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tamarack.operators import records, sessions
from tamarack.streaming.clips import consecutive_stream
from tamarack.streaming.records import RecordTable, upsert_stream

NOON = datetime(2024, 5, 1, 12)


def test_state_of_clips_ends(spark, tmp_path):
    schema = "s long, at timestamp, id string"
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    minutes = lambda *rows: [(s, NOON + timedelta(minutes=m), i) for s, m, i in rows]
    batches = [minutes((1, 0, "a"), (1, 1, "a"), (2, 1, "x"), (3, 2, None), (3, 3, None)), minutes((1, 5, "a"), (1, 6, "b")), minutes((2, 30, "x"), (4, 40, "y")), minutes((1, 200, "b"), (5, 201, "z")), minutes((6, 500, "end"))]

    def go():
        stream = spark.readStream.schema(schema).parquet(src)
        q = consecutive_stream(stream, "s", "at", "id", event_time="at", idle=timedelta(minutes=20)).writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]

    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        left = go()
    assert left[-1] <= 3  # all sessions but the last are gone: its value, its timer and the timer by time
    rows = lambda df: sorted(map(tuple, df.select("s", "at", "id").collect()), key=repr)
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    want = rows(sessions.consecutive(whole, "s", ["at"], "id", "at", timedelta(minutes=20)))
    assert rows(spark.read.schema(schema).parquet(str(tmp_path / "out"))) == want
    assert (2, NOON + timedelta(minutes=30), "x") in want and (1, NOON + timedelta(minutes=5), "a") not in want


def test_upsert_stream(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat("event_type", F.lit("-"), F.col("user_id") % 100).alias("key"), F.col("event_id").alias("line_no"), "value")
    src = str(tmp_path / "in")
    for i in range(4):  # later lines come first
        e.filter(F.col("line_no") % 4 == 3 - i).coalesce(1).write.mode("append").parquet(src)
    table = RecordTable(spark, str(tmp_path / "table"), buckets=5)
    assert table.read() is None and table.versions() == []

    def go(cp):
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
        upsert_stream(stream, table).option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start().awaitTermination()

    rows = lambda df: sorted(map(tuple, df.select("key", "first_line", "value").collect()))
    want = rows(records.upsert(e, "value"))
    go("cp")
    assert rows(table.read()) == want and table.versions() == [0, 1, 2, 3]
    go("again")  # all batches come once more, under the same numbers
    assert rows(table.read()) == want and table.versions() == [0, 1, 2, 3]
    table.merge(e, 4)  # and under a new one
    assert rows(table.read()) == want and len(rows(table.read(0))) <= len(want)
    got = records.with_ordinals(table.read())
    assert got.filter(F.col("ordinal") != 0).count() == len(want) - 1


def test_a_batch_that_failed_changes_nothing(spark, tmp_path):
    table = RecordTable(spark, str(tmp_path / "t"), buckets=2)
    schema = "key string, line_no long, value string"
    table.merge(spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], schema), 0)
    bad = spark.createDataFrame([("a", 5, "new"), ("c", 6, None)], schema)
    try:
        table.merge(bad.withColumn("value", F.when(F.col("key") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("value"))), 1)
        raise AssertionError
    except Exception as e:
        assert "lost" in str(e)
    rows = lambda: sorted((r.key, r.first_line, r.value) for r in table.read().collect())
    assert rows() == [("a", 0, "x"), ("b", 1, "y")] and table.versions() == [0]
    table.merge(bad, 1)
    assert rows() == [("a", 0, "new"), ("b", 1, "y"), ("c", 6, None)]
    table.merge(spark.createDataFrame([], schema), 2)
    assert rows() == [("a", 0, "new"), ("b", 1, "y"), ("c", 6, None)] and table.vacuum(1) >= 1 and table.versions() == [2]
    assert rows() == [("a", 0, "new"), ("b", 1, "y"), ("c", 6, None)]
