import datetime as dt
import random

from pyspark.sql import functions as F

from corpuswright.streaming import events, sinks


def write_files(spark, rows, path, schema, each=40):
    for k in range(0, len(rows), each):
        spark.createDataFrame(rows[k : k + each], schema).coalesce(1).write.mode("append").parquet(path)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    schema = "event_id long, user_id long, note string"
    rows = [(i, i % 7, f"call 0912-345-678 or write a{i}@b.org") for i in range(200)]
    write_files(spark, rows, str(tmp_path / "in"), schema)
    sink = sinks.OnceSink(spark, str(tmp_path / "out"), redact=True)
    stream = events.read_stream(spark, str(tmp_path / "in"), schema, 1)
    sink.start(stream, str(tmp_path / "check")).awaitTermination()
    first = {x.event_id: x.note for x in sink.read().collect()}
    assert sorted(first) == list(range(200)) and len(sink.batches()) == 5
    assert not any("0912" in n or "@b.org" in n for n in first.values())
    raw = spark.read.parquet(str(tmp_path / "out/batches/*"))
    assert raw.filter(F.col("note").contains("@b.org")).count() == 0  # nothing that isn't redacted is stored
    # the same batches again, as after a failure before the checkpoint was written
    again = sinks.OnceSink(spark, str(tmp_path / "out"), redact=True)
    again.start(stream, str(tmp_path / "other")).awaitTermination()
    assert {x.event_id: x.note for x in again.read().collect()} == first and again.read().count() == 200


def test_a_batch_that_was_begun_is_written_anew(spark, tmp_path):
    sink = sinks.OnceSink(spark, str(tmp_path))
    assert sink.read() is None and sink.batches() == []
    rows = spark.createDataFrame([(i, "x") for i in range(30)], "event_id long, note string")
    rows.limit(3).write.parquet(f"{tmp_path}/batches/{4:012d}")  # without an entry in the ledger
    assert sink.read() is None
    assert sink.write(rows, 4) and not sink.write(rows.limit(1), 4)
    assert sink.read().count() == 30


def test_sampling_is_by_row_and_errors_stay(spark, tmp_path):
    rows = spark.createDataFrame([(i, "error" if i % 50 == 0 else "ok") for i in range(1000)], "event_id long, status string")
    one, two = (sinks.OnceSink(spark, str(tmp_path / n), sample_rate=0.2, always=lambda d: F.col("status") == "error") for n in "ab")
    one.write(rows, 0)
    for k in range(4):
        two.write(rows.filter(F.col("event_id") % 4 == k), k)
    got = [{x.event_id for x in s.read().collect()} for s in (one, two)]
    assert got[0] == got[1] and 100 < len(got[0]) < 350 and set(range(0, 1000, 50)) <= got[0]


def test_sessions_are_decided_on_event_by_event(spark, tmp_path):
    r = random.Random(1)
    at, rows = dt.datetime(2024, 1, 1), []
    for i in range(400):
        at += dt.timedelta(seconds=r.choice([5, 60, 300, 4000]))
        rows.append((i, r.randrange(4), at))
    schema = "event_id long, user_id long, ts timestamp"
    write_files(spark, rows, str(tmp_path / "in"), schema, 80)
    stream = events.read_stream(spark, str(tmp_path / "in"), schema, 1)
    query = sinks.decided(stream, 1800, 3, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = sinks.decided_batch(spark.createDataFrame(rows, schema), 1800, 3)
    key = ["event_id", "user_id", "session_start", "n", "over_quota"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert want.filter("over_quota").count() > 10 and want.agg(F.max("n")).first()[0] > 3
    # long after the last event no state is left
    far = [(1000 + k, 9, at + dt.timedelta(days=k + 1)) for k in range(4)]
    write_files(spark, far, str(tmp_path / "in"), schema, 1)
    query = sinks.decided(stream, 1800, 3, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
