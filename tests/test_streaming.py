"""Streaming forms over files, run to their end."""

from pyspark.sql import functions as F

from tessella.streaming import workers


def _run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_registry_expires_workers(spark, tmp_path):
    src = str(tmp_path / "beats")
    schema = "worker string, ts timestamp, queue_length long"
    one = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', 1L), ('a', timestamp'2024-01-01 00:00:10', 2L), ('b', timestamp'2024-01-01 00:00:05', 5L) as t(worker, ts, queue_length)")
    two = spark.sql("select * from values ('b', timestamp'2024-01-01 00:05:00', 7L) as t(worker, ts, queue_length)")
    one.coalesce(1).write.mode("append").json(src)
    two.coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    _run(workers.registry(stream, 30), "update", "registry")
    rows = spark.sql("select * from registry").collect()
    assert ("a", "expired") in {(r.worker, r.event) for r in rows}
    assert any(r.worker == "b" and r.event == "beat" and r.queue_length == 7 for r in rows)


def test_windows_equal_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    _run(workers.windowed_counts(stream, "ts", "1 hour", None, "event_type", "value"), "complete", "wins")
    batch = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert spark.sql("select sum(n) from wins").first()[0] == e.count() and spark.sql("select * from wins").count() == batch.count()


def test_append_log(spark, tmp_path):
    rows = spark.sql("select * from values (timestamp'2024-01-01 10:00:00', 'x'), (timestamp'2024-01-02 10:00:00', 'y') as t(ts, m)")
    rows.write.json(str(tmp_path / "in"))
    q = workers.append_stream(spark.readStream.schema("ts timestamp, m string").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "ts")
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).select("date").distinct().count() == 2
