"""Jobs as event logs: latest state, gaps, heartbeats, in batch and as streams.

Events have ``job``, ``ts``, ``status`` and ``value``. Event-time windows are an addition of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redsift.fixed import COMPLETED, FAILED, QUEUED, RUNNING, SKIPPED
from redsift.operators.ranks import with_next


def latest_state(events: DataFrame, job: str, ts: str, order: str) -> DataFrame:
    """The last event of each job (ties: greatest ``order``) and how many it had."""
    rest = [c for c in events.columns if c not in (job, ts, order)]
    g = events.groupBy(job).agg(F.max(F.struct(ts, order, *rest)).alias("_s"), F.count(F.lit(1)).alias("n_events"))
    return g.select(job, "_s.*", "n_events")


def stall_gaps(events: DataFrame, job: str, ts: str, order: str, seconds: int, grace: int = 0) -> DataFrame:
    """Gaps between consecutive events of a job longer than a timeout; before the second event ``grace`` more is given.

    Events are ordered over range partitions, so a job with very many of them is not gathered."""
    d = with_next(events.select(job, ts, order), [job], [ts, order], ts, "_next", "_first")
    d = d.withColumn("gap_s", (F.unix_micros(F.col("_next").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6)
    return d.where(F.col("gap_s") > F.lit(seconds) + F.when(F.col("_first"), grace).otherwise(0)).select(job, ts, order, F.round("gap_s", 3).alias("gap_s"))


def last_valid(events: DataFrame, job: str, ts: str, value: str) -> DataFrame:
    """Last non-null value of each job and whether it is a finite number."""
    v = F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(ts)))
    return events.groupBy(job).agg(v.alias("last")).withColumn("finite", F.coalesce(~F.isnan("last") & (F.abs("last") != float("inf")), F.lit(False)))


QUEUE_SPEC = "name string, fail_fast boolean, jobs array<struct<name:string,argv:array<string>,cwd:string>>"


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of a queue specification in order: ``(queue, fail_fast, index, name, argv, cwd)``.

    A file without jobs, or with a job without arguments, is an error.
    """
    spec = spark.read.schema(QUEUE_SPEC).option("multiLine", True).json(path).first()  # one small document
    if spec is None or not spec["jobs"]:
        raise ValueError("a queue needs a non-empty list 'jobs'")
    for i, job in enumerate(spec["jobs"]):
        if job is None or not job["argv"] or any(a is None for a in job["argv"]):
            raise ValueError(f"job {i} needs a non-empty list 'argv' of strings")
    fast = True if spec["fail_fast"] is None else spec["fail_fast"]
    rows = [(spec["name"] or "queue", fast, i, j["name"] or f"job_{i:02d}", j["argv"], j["cwd"]) for i, j in enumerate(spec["jobs"])]
    return spark.createDataFrame(rows, "queue string, fail_fast boolean, index int, name string, argv array<string>, cwd string")


def initial_status(jobs: DataFrame, folder: str, index: str = "index", name: str = "name") -> DataFrame:
    """``jobs`` as they wait: state queued, where they will log, and nothing measured yet."""
    log = F.concat(F.lit(f"{folder}/logs/"), F.lpad(F.col(index).cast("string"), 2, "0"), F.lit("_"), F.col(name), F.lit(".log"))
    empty = {c: F.lit(None).cast(t) for c, t in (("started_at", "timestamp"), ("finished_at", "timestamp"), ("duration_seconds", "double"), ("exit_code", "int"), ("pid", "long"), ("heartbeat_at", "timestamp"), ("last_output_at", "timestamp"), ("last_output_line", "string"))}
    return jobs.withColumns({"status": F.lit(QUEUED), "log_path": log} | empty)


def queue_outcome(jobs: DataFrame, by: list[str], position: str, exit_code: str, fail_fast: bool = True) -> DataFrame:
    """``jobs`` with ``status`` as a queue run one after the other leaves them: completed or failed by the exit code (null:
    still queued), and skipped behind the first failure of their queue if it fails fast."""
    own = F.when(F.col(exit_code).isNull(), QUEUED).when(F.col(exit_code) == 0, COMPLETED).otherwise(FAILED)
    if not fail_fast:
        return jobs.withColumn("status", own)
    first = jobs.where(F.col(exit_code) != 0).groupBy(*by).agg(F.min(position).alias("_f"))
    return jobs.join(first, by, "left").withColumn("status", F.when(F.col(position) > F.col("_f"), SKIPPED).otherwise(own)).select(*jobs.columns, "status")


def queue_states(jobs: DataFrame, by: list[str], status: str = "status", fail_fast: bool = True) -> DataFrame:
    """``(by, state, n_completed, n_failed, n_skipped, n_queued)`` of each queue; one that goes on after failures completes."""
    n = {s: F.count_if(F.col(status) == s).alias(f"n_{s}") for s in (COMPLETED, FAILED, SKIPPED, QUEUED)}
    got = jobs.groupBy(*by).agg(*n.values())
    state = F.when((F.col("n_failed") > 0) & F.lit(fail_fast), FAILED).when(F.col("n_queued") > 0, RUNNING).otherwise(COMPLETED)
    return got.select(*by, state.alias("state"), *[f"n_{s}" for s in n])


def lane_control(disabled: Column, draining: Column, disable: Column) -> tuple[Column, Column]:
    """Both sets after lanes are added to the first: sorted, and no lane in both."""
    return F.array_sort(F.array_union(disabled, disable)), F.array_sort(F.array_except(draining, disable))


# ---------------------------------------------------------------- streams


def heartbeats(events: DataFrame, ts: str, by: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per window and key; on a stream, rows later than ``late`` behind the newest are dropped."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last")).select(F.col("w.start").alias("start"), by, "n", "last")


def _stalls(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Per job: remember the last event, report a stall when the timer fires first."""
    if state.hasTimedOut:
        (last, n), _ = state.get, state.remove()
        yield pd.DataFrame({"job": [key[0]], "last": [pd.Timestamp(last, unit="us")], "n_events": [n], "state": ["stalled"]})
        return
    last, n = state.get if state.exists else (0, 0)
    for pdf in batches:
        n += len(pdf)
        last = max(last, int(pdf["ts"].max().value // 1000))
    state.update((last, n))
    state.setTimeoutDuration(_stalls.timeout)
    yield pd.DataFrame({"job": [key[0]], "last": [pd.Timestamp(last, unit="us")], "n_events": [n], "state": ["running"]})


_stalls.timeout = 60_000


def watch(events: DataFrame, milliseconds: int = 60_000) -> DataFrame:
    """A stream of ``(job, last, n_events, state)``: running after each batch of a job's events, stalled when none came
    for a processing time."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        _stalls.timeout = milliseconds
        yield from _stalls(key, batches, state)

    return events.select("job", "ts").groupBy("job").applyInPandasWithState(run, "job string, last timestamp, n_events long, state string", "last long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_sink(path: str, key: str, order: str):
    """A ``foreachBatch`` function that keeps the latest row per key in a table.

    Each batch writes a new version and then a pointer to it; :func:`read_upserted` follows the pointer, so a batch that
    dies half way, or is run again, leaves the version before in force. Versions before the last two are deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        from redsift.operators.cache import upsert

        spark = batch.sparkSession
        now = _version(spark, path)
        if now is not None and now >= epoch:
            return  # this batch has been written
        old = spark.read.schema(batch.schema).parquet(f"{path}/v{now}") if now is not None else batch.limit(0)
        upsert(old, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        fs, at = _files(spark, f"{path}/current-{epoch}")
        fs.create(at, True).close()
        for name in _names(spark, path):
            kind, _, n = name.partition("-") if name.startswith("current-") else ("v", "", name[1:] if name.startswith("v") else "")
            if n.isdigit() and int(n) < (now if now is not None else epoch):
                fs.delete(_files(spark, f"{path}/{name}")[1], True)

    return write


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that :func:`upsert_sink` keeps, None before its first batch."""
    now = _version(spark, path)
    return None if now is None else spark.read.parquet(f"{path}/v{now}")


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _version(spark: SparkSession, path: str) -> int | None:
    """The greatest version with a pointer."""
    return max((int(n.removeprefix("current-")) for n in _names(spark, path) if n.startswith("current-")), default=None)
