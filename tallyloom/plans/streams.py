"""The streaming jobs, each replayed over stored tables and checked against its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.batch import APPLIED_SQL, checked_digest, documents
from tallyloom.plans.common import SQL, query, table
from tallyloom.plans.evaluation import (
    OUTCOME_SQL, TIMED_RESPONSE_SQL, WAIT_HOURS, outcome_rows, session_events,
)
from tallyloom.session import scratch_path
from tallyloom.streaming import jobs


def _state(spark: SparkSession) -> dict[str, str]:
    """State of a replay: one partition per core."""
    return {jobs.PARTITIONS: str(spark.sparkContext.defaultParallelism)}


def _replay(df: DataFrame, name: str, files_per_trigger: int = 0) -> DataFrame:
    """Write a stand-in and read it back as a stream."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return jobs.read_table_stream(spark, path, df.schema, files_per_trigger)


@query("stream_status", f"""WITH {OUTCOME_SQL}
SELECT status, count(*) AS n FROM outcomes GROUP BY status""")
def stream_status(spark, sf_dir):
    stream = _replay(outcome_rows(spark, sf_dir).select("event_id", "status"), "statuses", 4)
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "counts-state")
    with jobs.settings(spark, _state(spark)):
        jobs.status_counts_stream(stream, path, checkpoint)
    return jobs.latest_counts(spark, path)


@query("stream_apply", APPLIED_SQL)
def stream_apply(spark, sf_dir):
    stream = _replay(documents(spark, sf_dir), "arriving", 4)
    path, checkpoint = scratch_path(spark, "applied"), scratch_path(spark, "applied-state")
    applied = jobs.apply_stream(stream, checked_digest, "text", "flow_variable")
    jobs.drain(applied.select("doc_id", "status", "result", "error"), path, checkpoint)
    return spark.read.parquet(path)


#: Every slice of a replay is one micro-batch of this many files.
SLICE_FILES = 2
SLICES = 6


def _tickets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """Tickets, and slices of them in which every ticket arrives twice."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ticket_id"), F.col("o_orderstatus").alias("status"))
    share = F.pmod(F.xxhash64("ticket_id"), F.lit(SLICES))
    return rows, [rows.where(share.isin(k, (k + 1) % SLICES)) for k in range(SLICES)]


def _arrive(rows: DataFrame, inbox: str) -> None:
    rows.repartition(SLICE_FILES).write.mode("append").parquet(inbox)


@query("stream_resume", """
SELECT o_orderkey AS ticket_id, o_orderstatus AS status FROM orders""")
def stream_resume(spark, sf_dir):
    """Six micro-batches with overlapping ids, four in one run and the rest after a restart."""
    rows, slices = _tickets(spark, sf_dir)
    inbox = scratch_path(spark, "inbox")
    path, checkpoint = scratch_path(spark, "indexed"), scratch_path(spark, "indexed-state")
    for arrived in (slices[:4], slices[4:]):
        for part in arrived:
            _arrive(part, inbox)
        stream = jobs.read_table_stream(spark, inbox, rows.schema, SLICE_FILES)
        with jobs.settings(spark, {**_state(spark), jobs.STATE_STORE: jobs.ROCKSDB}):
            jobs.resume_stream(stream, path, checkpoint, "ticket_id")
    return spark.read.parquet(path).select("ticket_id", "status")


@query("stream_cadence", """
SELECT o_orderkey AS ticket_id, o_orderstatus AS status FROM orders""")
def stream_cadence(spark, sf_dir):
    """The same tickets taken up at a steady cadence; half of them arrive while it runs."""
    rows, slices = _tickets(spark, sf_dir)
    inbox = scratch_path(spark, "inbox")
    path, checkpoint = scratch_path(spark, "steady"), scratch_path(spark, "steady-state")
    for part in slices[:3]:
        _arrive(part, inbox)
    later, quiet = slices[3:], jobs.idle(2)

    def until(query):
        if later and query.lastProgress:
            _arrive(later.pop(0), inbox)
        return quiet(query) and not later

    stream = jobs.read_table_stream(spark, inbox, rows.schema, SLICE_FILES)
    with jobs.settings(spark, {**_state(spark), jobs.STATE_STORE: jobs.ROCKSDB}):
        jobs.resume_stream(stream, path, checkpoint, "ticket_id", every="500 milliseconds",
                           until=until)
    return spark.read.parquet(path).select("ticket_id", "status")


@query("stream_running", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  count(*) AS n FROM orders GROUP BY 1""")
def stream_running(spark, sf_dir):
    """Every order starts a task, and those no longer open end it; both arrive out of order."""
    status = F.when(F.col("status") == "F", "success").when(F.col("status") == "P", "failed")
    tasks = _tickets(spark, sf_dir)[0].select(
        F.col("ticket_id").alias("task_id"), F.explode(F.array_compact(F.array(
            F.lit("running"), status))).alias("status"))
    slices = F.pmod(F.xxhash64("task_id", "status"), F.lit(3))
    inbox = scratch_path(spark, "transitions")
    for k in range(3):
        _arrive(tasks.where(slices == k), inbox)
    path, checkpoint = scratch_path(spark, "running"), scratch_path(spark, "running-state")
    stream = jobs.read_table_stream(spark, inbox, tasks.schema, SLICE_FILES)
    with jobs.settings(spark, {**_state(spark), jobs.STATE_STORE: jobs.ROCKSDB}):
        jobs.task_status_stream(stream, path, checkpoint)
    return jobs.latest_counts(spark, path)


def _arriving(df: DataFrame, name: str, at: str, row_id: str, cuts: list[str], late: str
              ) -> DataFrame:
    """A table as a stream of micro-batches that overlap in time.

    A row arrives up to ``late`` after its moment, by a hash of its id, so that rows of a
    micro-batch, and those of neighbouring ones, are out of order.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    arrival = F.col(at) + F.expr(f"INTERVAL {late}") * (F.pmod(F.xxhash64(row_id), F.lit(97)) / 97)
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = df if low is None else df.where(arrival >= F.lit(low).cast("timestamp"))
        part = part if high is None else part.where(arrival < F.lit(high).cast("timestamp"))
        part.repartition(SLICE_FILES).write.mode("append").parquet(path)
    return jobs.read_table_stream(spark, path, df.schema, SLICE_FILES)


def _heartbeat(df: DataFrame, at: str) -> DataFrame:
    """A last row that moves the watermark past every deadline."""
    late = F.lit("2200-01-01 00:00:00").cast("timestamp")
    beat = df.sparkSession.range(1).select(*[
        (late if f.name == at else F.lit(-1) if f.name.endswith("_id") else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(beat)


@query("stream_match_within", SQL["match_within"])
def stream_match_within(spark, sf_dir):
    """Orders and their lines in four micro-batches, out of order by up to 20 days."""
    cuts = [f"{year}-01-01" for year in (1997, 1998, 2000)]

    def replay(name: str, key: str, at: str, named: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(
            F.col(key).alias("task_id"), jobs.event_time(at).alias(named))
        return _arriving(_heartbeat(rows, named), name, named, "task_id", cuts, "20 DAYS")

    matched = jobs.match_within_stream(
        replay("orders", "o_orderkey", "o_orderdate", "submitted_at"),
        replay("lineitem", "l_orderkey", "l_shipdate", "arrived_at"), "90 days", "30 days")
    path, checkpoint = scratch_path(spark, "matched"), scratch_path(spark, "matched-state")
    with jobs.settings(spark, {**_state(spark), **jobs.JOIN_STATE}):
        jobs.drain(matched, path, checkpoint)
    return spark.read.parquet(path).where("task_id >= 0").select(
        "task_id", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"),
        "status", "error")


@query("stream_session", TIMED_RESPONSE_SQL)
def stream_session(spark, sf_dir):
    """Events in four micro-batches, out of order by up to six hours and polled twice each."""
    polled = session_events(spark, sf_dir).withColumn("ts", jobs.event_time("ts"))
    again = _heartbeat(polled.unionAll(polled), "ts")
    cuts = [f"2024-01-{day:02d}" for day in (2, 3, 10)]
    stream = _arriving(again, "polled", "ts", "event_id", cuts, "6 HOURS")
    path, checkpoint = scratch_path(spark, "sessions"), scratch_path(spark, "sessions-state")
    with jobs.settings(spark, {**_state(spark), jobs.STATE_STORE: jobs.ROCKSDB}):
        jobs.drain(jobs.session_response_stream(
            stream, f"{WAIT_HOURS} hours", "12 hours", "3650 days", "text"), path, checkpoint)
    return spark.read.parquet(path).where("session_id >= 0")
