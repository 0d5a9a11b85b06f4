import pytest
from pyspark.sql import functions as F

from redsift.streaming import jobs

SCHEMA = "job string, ts timestamp, status string, value double"


def source(spark, path, rows):
    spark.createDataFrame(rows, "job string, ts string, status string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def finish(q):
    try:
        assert q.awaitTermination(30)
    finally:
        q.stop()


ROWS = [("a", "2024-01-01 00:00:00", "run", 1.0), ("a", "2024-01-01 00:05:00", "done", None), ("b", "2024-01-01 00:20:00", "run", 2.0)]


def test_heartbeats_stream_equals_batch(spark, tmp_path):
    s = source(spark, str(tmp_path / "in"), ROWS)
    q = jobs.heartbeats(s, "ts", "job").writeStream.outputMode("complete").format("memory").queryName("beats").trigger(availableNow=True).start()
    finish(q)
    batch = jobs.heartbeats(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), "ts", "job")
    assert sorted(map(tuple, spark.sql("select * from beats").collect())) == sorted(map(tuple, batch.collect()))


def test_watch_reports_running_jobs(spark, tmp_path):
    s = source(spark, str(tmp_path / "in"), ROWS)
    # with timers pending, batches without data would go on for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = jobs.watch(s, 600_000).writeStream.outputMode("append").format("memory").queryName("watched").trigger(availableNow=True).start()
    finish(q)
    got = {r["job"]: (r["n_events"], r["state"]) for r in spark.sql("select * from watched").collect()}
    assert got == {"a": (2, "running"), "b": (1, "running")}


def test_upsert_sink(spark, tmp_path):
    s = source(spark, str(tmp_path / "in"), ROWS)
    q = s.writeStream.foreachBatch(jobs.upsert_sink(str(tmp_path / "t"), "job", "ts")).trigger(availableNow=True).start()
    finish(q)
    state = lambda: {(r["job"], r["status"]) for r in jobs.read_upserted(spark, str(tmp_path / "t")).collect()}
    assert state() == {("a", "done"), ("b", "run")}
    sink = jobs.upsert_sink(str(tmp_path / "t"), "job", "ts")
    more = lambda *rows: spark.createDataFrame(rows, "job string, ts string, status string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    sink(more(("b", "2024-01-02", "done", 1.0), ("c", "2024-01-02", "run", None)), 1)
    sink(more(("a", "2024-01-09", "again", 1.0)), 1)  # a batch that is run again changes nothing
    sink(more(("a", "2023-01-01", "old", 1.0)), 2)
    assert state() == {("a", "done"), ("b", "done"), ("c", "run")}
    # a version without its pointer is not in force
    spark.range(1).write.parquet(str(tmp_path / "t" / "v9"))
    assert state() == {("a", "done"), ("b", "done"), ("c", "run")}
    assert jobs.read_upserted(spark, str(tmp_path / "none")) is None


def test_queue(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"name": "unit-queue", "jobs": [{"name": "job_a", "argv": ["python", "--version"]}, {"argv": ["x"]}]}')
    q = jobs.read_queue(spark, str(tmp_path / "q.json"))
    got = jobs.initial_status(q, str(tmp_path)).orderBy("index").collect()
    assert [(r["queue"], r["name"], r["status"], r["fail_fast"]) for r in got] == [("unit-queue", "job_a", "queued", True), ("unit-queue", "job_01", "queued", True)]
    assert got[0]["log_path"].endswith("/logs/00_job_a.log") and got[0]["exit_code"] is None
    for bad in ('{"name": "empty", "jobs": []}', '{"jobs": [{"name": "a"}]}', '{"jobs": [{"argv": []}]}'):
        (tmp_path / "q.json").write_text(bad)
        with pytest.raises(ValueError):
            jobs.read_queue(spark, str(tmp_path / "q.json"))


def test_queue_outcome(spark):
    df = spark.createDataFrame([("q", 1, 0), ("q", 2, 3), ("q", 3, None), ("r", 1, None), ("s", 1, 0)], "q string, pos int, code int")
    run = lambda fast: {(r["q"], r["pos"]): r["status"] for r in jobs.queue_outcome(df, ["q"], "pos", "code", fast).collect()}
    assert run(True) == {("q", 1): "completed", ("q", 2): "failed", ("q", 3): "skipped", ("r", 1): "queued", ("s", 1): "completed"}
    assert run(False)["q", 3] == "queued"
    states = {r["q"]: r["state"] for r in jobs.queue_states(jobs.queue_outcome(df, ["q"], "pos", "code"), ["q"]).collect()}
    assert states == {"q": "failed", "r": "running", "s": "completed"}
