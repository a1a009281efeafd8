import datetime as dt

from pyspark.sql import functions as F

from sigeval.streaming.live import by_instalments, drain, late_rows, stream_confusion, stream_windows


def run_stream(spark, df, build, name):
    q = build(df).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_streams_match_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 3, t0 + dt.timedelta(seconds=7 * i), float(i % 11) - 5, i % 2) for i in range(300)]
    rows.append((0, t0 + dt.timedelta(days=2), 0.0, 0))  # moves the watermark past all earlier windows
    df = spark.createDataFrame(rows, "rec int, ts timestamp, v double, label int").withColumn("score", F.col("v"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    late = F.col("start") < F.lit(dt.datetime(2024, 1, 2))
    a = lambda x: stream_confusion(x, "ts", "5 minutes", "10 minutes", 0.0)
    b = lambda x: stream_windows(x, "ts", "6 minutes", "5 minutes", "10 minutes")
    assert run_stream(spark, stream, a, "conf") == {tuple(r) for r in a(df).where(late).collect()}
    assert run_stream(spark, stream, b, "wins") == {tuple(r) for r in b(df).where(late).collect()}


def test_late_rows_are_dropped_and_counted_once(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    hours = [(0, h) for h in range(6)] + [(1, h) for h in (6, 7, 0, 4)]  # after the first part the watermark stands at 3:00
    rows = spark.createDataFrame([(k, t0 + dt.timedelta(hours=h, minutes=5), 1, 1.0) for k, h in hours], "part int, ts timestamp, label int, score double")
    build = lambda x: stream_confusion(x, "ts", "1 hour", "125 minutes", 0.5)
    counted = by_instalments(rows, [0, 1], "part", "ts", build).select("start", F.col("tp").alias("n"))
    got = {r.start.hour: (r.arrived, r.counted, r.late) for r in late_rows(rows, counted, "ts", "1 hour").collect()}
    assert got[0] == (2, 1, 1) and got[4] == (2, 2, 0)
    assert sum(x[0] for x in got.values()) == 10 and sum(x[2] for x in got.values()) == 1


def test_a_repeated_drain_adds_nothing(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t0 + dt.timedelta(hours=h), 1, 1.0) for h in range(9)], "ts timestamp, label int, score double")
    rows.write.parquet(str(tmp_path / "in"))
    build = lambda x: stream_confusion(x, "ts", "1 hour", "1 hour", 0.5)
    for _ in range(2):
        drain(str(tmp_path / "in"), rows, build, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 7
