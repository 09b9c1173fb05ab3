"""Incremental forms of the batch jobs on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tallyloom.operators.apply import RowFunction, apply_flow

PARTITIONS = "spark.sql.shuffle.partitions"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: For joins with much state: one store instead of four, changes instead of whole files at every
#: commit, and no look-up before every write only to count the rows. For new checkpoints.
JOIN_STATE = {
    STATE_STORE: ROCKSDB,
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries started inside; a query keeps them for its life.

    The number of shuffle partitions is also the number of state partitions, which a
    checkpoint fixes for good: choose it by the size of the state, not of one batch.
    """
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def read_table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 0
                      ) -> DataFrame:
    """A folder of Parquet files as a stream; the bound is the admission control."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append everything available to a Parquet table, then stop."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_steadily(
    writer: DataStreamWriter, checkpoint: str, every: str,
    until: Callable[[StreamingQuery], bool] | None = None, poll: float = 0.2,
) -> StreamingQuery:
    """Run a stream at a fixed cadence, a micro-batch ``every`` so often.

    With ``until`` the call returns once that holds, as asked between micro-batches: the one
    under way is finished and committed first, so that nothing is done twice after a restart.
    Without it the running query is returned. How much a micro-batch takes is bounded by the
    source (``files_per_trigger`` of ``read_table_stream``). A failure of the stream is raised.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    if until is None:
        return query
    try:
        while query.isActive and not (not query.status["isTriggerActive"] and until(query)):
            query.awaitTermination(poll)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return query


def idle(seconds: float) -> Callable[[StreamingQuery], bool]:
    """Holds once a stream that has run a micro-batch found nothing more for so long."""
    batch, since = None, time.monotonic()

    def holds(query: StreamingQuery) -> bool:
        nonlocal batch, since
        last = query.lastProgress
        now = last and last["batchId"]
        if now != batch or query.status["isDataAvailable"]:
            batch, since = now, time.monotonic()
        return batch is not None and time.monotonic() - since >= seconds

    return holds


def drain_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    """Hand everything available to ``write`` batch by batch, then stop."""
    query = (
        df.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def match_within_stream(
    tasks: DataFrame, results: DataFrame, timeout: str, delay: str = "0 seconds"
) -> DataFrame:
    """One row per task: its earliest result inside the timeout, or a timeout failure.

    Both sides need a ``timestamp`` column (``submitted_at``, ``arrived_at``) and may be out of
    order by ``delay``. An outer join within the timeout pairs tasks and results, and an
    aggregation behind it takes each task's earliest; both drop their state as the watermark,
    the slower of the two sides', passes the deadline, and a task is told of then. Task ids
    are unique; neither state nor rows leave the JVM. ``JOIN_STATE`` are ``settings`` for it.
    """
    asked = tasks.select("task_id", "submitted_at").withWatermark("submitted_at", delay)
    given = results.select(F.col("task_id").alias("__id"), "arrived_at")\
        .withWatermark("arrived_at", delay)
    deadline = F.col("submitted_at") + F.expr(f"INTERVAL {timeout}")
    inside = (F.col("task_id") == F.col("__id")) \
        & F.col("arrived_at").between(F.col("submitted_at"), deadline)
    # As a number it is no second event time, of which the aggregation could have only one.
    paired = asked.join(given, inside, "left_outer").select(
        "task_id", "submitted_at", F.unix_micros("arrived_at").alias("__micros"))
    earliest = paired.groupBy("task_id", "submitted_at").agg(
        F.timestamp_micros(F.min("__micros")).alias("completed_at"))
    missed = F.col("completed_at").isNull()
    return earliest.select(
        "*", F.when(missed, "failed").otherwise("success").alias("status"),
        F.when(missed, F.lit("Timeout waiting for completion")).alias("error"))


def _micros(text: str) -> int:
    return pd.Timedelta(text.lower()).value // 1000


#: Artefacts of a session are put aside by spans of this many microseconds.
SPAN = 3_600_000_000
#: Up to so many are held in the session's own row instead.
HELD = 4096


class _Session(StatefulProcessor):
    """Per session: its first event, earliest message, and artefacts.

    Rows are folded as they stream in; of a micro-batch only one Arrow batch is held. Artefacts
    above the watermark are held as arrays of times and ids in the session's row, and if
    there are many, put aside by time span; what the watermark has passed becomes a number. The
    end of a session only comes nearer, so artefacts beyond it are dropped at once. Every access
    to the state is a call to the JVM: a session of usual size needs its row read and written.
    """

    def __init__(self, timeout: int, forget: int) -> None:
        self._timeout, self._forget = timeout, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState(
            "seen", "first long, message_at long, message_id long, message string, "
                    "n_artefacts long, counted_to long, part long, closed_at long, timer long, "
                    "held_at binary, held_id binary")
        self._aside = handle.getMapState("aside", "span long, part long", "at binary, id binary")

    def _end(self, first: int, message_at: int | None) -> int:
        deadline = first + self._timeout
        return deadline if message_at is None else min(message_at, deadline)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
                        ) -> Iterator[pd.DataFrame]:
        first, at, event, text, count, counted_to, part, closed_at, timer, *held = (
            self._seen.get() or (None, None, None, None, 0, None, 0, None, None, b"", b""))
        if closed_at is not None:
            return
        message = None if at is None else (at, event, text)
        held = [np.frombuffer(x, np.int64) for x in held]
        for batch in rows:
            moments, ids = batch["at"].to_numpy(), batch["event_id"].to_numpy()
            fresh = np.ones(len(batch), bool) if counted_to is None else moments > counted_to
            if not fresh.any():
                continue
            first = min(x for x in (first, int(moments[fresh].min())) if x is not None)
            said = np.flatnonzero(fresh & (batch["kind"] == "message").to_numpy())
            if len(said):
                k = said[np.lexsort((ids[said], moments[said]))[0]]
                if message is None or (moments[k], ids[k]) < message[:2]:
                    message = int(moments[k]), int(ids[k]), batch["message"].iloc[k]
            within = moments <= self._end(first, message[0] if message else None)
            made = np.flatnonzero(fresh & within & (batch["kind"] == "artefact").to_numpy())
            held = [np.concatenate(x) for x in ((held[0], moments[made]), (held[1], ids[made]))]
            if len(held[0]) > HELD:
                part = self._put_aside(*held, part)
                held = [x[:0] for x in held]
        if first is None:
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        end = self._end(first, message[0] if message else None)
        whole = min(now, end) // SPAN * SPAN
        if counted_to is None or whole > counted_to:
            passed = held[0] < whole
            count += self._count(*(x[passed] for x in held), message, end)
            held = [x[~passed] for x in held]
            if part:
                count += self._fold(message, end, whole)
            counted_to = whole - 1
        if end != timer:
            self._handle.registerTimer(-(-end // 1000))
        self._seen.update((first, *(message or (None, None, None)), int(count), counted_to, part,
                           None, end, *(x.tobytes() for x in held)))
        yield from ()

    def _put_aside(self, at: np.ndarray, ids: np.ndarray, part: int) -> int:
        spans = at // SPAN
        for span in np.unique(spans).tolist():
            chosen = spans == span
            self._aside.updateValue((span, part), (at[chosen].tobytes(), ids[chosen].tobytes()))
            part += 1
        return part

    @staticmethod
    def _count(at: np.ndarray, ids: np.ndarray, message: tuple | None, end: int) -> int:
        """Artefacts before the message and the end."""
        wanted = at <= end
        if message is not None:
            wanted &= (at < message[0]) | ((at == message[0]) & (ids < message[1]))
        return int(wanted.sum())

    def _fold(self, message: tuple | None, end: int, below: int | None) -> int:
        """The count of the spans put aside below a moment; they are taken away."""
        count, done = 0, []
        for place, held in self._aside.iterator():
            if below is None or (place[0] + 1) * SPAN <= below:
                count += self._count(*(np.frombuffer(x, np.int64) for x in held), message, end)
                done.append(place)
        for place in done:
            self._aside.removeKey(place)
        return count

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any
                           ) -> Iterator[pd.DataFrame]:
        seen = self._seen.get()
        if seen is None:
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        first, at, event, text, count, counted_to, part, closed_at, timer, *held = seen
        if closed_at is not None:
            if closed_at + self._forget <= now:
                self._seen.clear()
            return
        end = self._end(first, at)
        if end > now:
            return
        answered = at is not None and at <= end
        message = None if at is None else (at, event, text)
        n = count + self._count(*(np.frombuffer(x, np.int64) for x in held), message, end)
        if part:
            n += self._fold(message, end, None)
        self._seen.update((first, None, None, None, 0, now, 0, end, None, b"", b""))
        self._handle.registerTimer(-(-(end + self._forget) // 1000))
        yield pd.DataFrame({
            "session_id": [key[0]], "response_event": pd.array([event if answered else None], "Int64"),
            "n_artefacts": [n], "status": ["success" if answered else "timeout"],
            "response": pd.array([text if answered else None], "string")})

    def close(self) -> None:
        pass


def session_response_stream(
    events: DataFrame, timeout: str, delay: str = "1 hour", forget: str = "30 days",
    text: str | None = None,
) -> DataFrame:
    """Final message of each session, with its text and the artefacts before it, or a timeout.

    The batch form is ``sessions.session_response`` with the same ``timeout``, counted from the
    session's first event. Events may be out of order by ``delay``; a session is told of
    once the watermark has passed its earliest message or its deadline, so that nothing older
    can follow. Repeated events, which have the same time, count once: their ids are in the
    state until the watermark has passed them. Of a session told of, one small row stays for
    ``forget`` longer than its end, against stragglers; then the id is free again.

    The session's state store must be RocksDB (``spark.sql.streaming.stateStore
    .providerClass``).
    """
    body = F.lit(None).cast("string") if text is None else F.col(text)
    id_type = events.schema["session_id"].dataType.simpleString()
    once = events.select(
        "session_id", "event_id", "ts", "kind",
        F.when(F.col("kind") == "message", body).alias("message"),
    ).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "event_id"])
    return once.withColumn("at", F.unix_micros("ts")).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Session(_micros(timeout), _micros(forget)),
        outputStructType=f"session_id {id_type}, response_event long, n_artefacts long, "
                         "status string, response string",
        outputMode="append", timeMode="EventTime")


def resume_stream(
    stream: DataFrame, path: str, checkpoint: str, key: str,
    work: Callable[[DataFrame], DataFrame] = lambda df: df, done: DataFrame | None = None,
    at: str | None = None, within: str = "30 days", every: str | None = None,
    until: Callable[[StreamingQuery], bool] | None = None,
) -> StreamingQuery:
    """Process ids not seen before and append them to the table at ``path``.

    Ids, compared as text, are in the stream's own state: a micro-batch looks up and adds those
    that it brings, whatever lies in the output, which is never read. Without ``at`` an id is
    known for good; with a ``timestamp`` column ``at`` an id is forgotten once the watermark,
    ``within`` behind the latest row, has passed it, and rows older than that are dropped.
    ``done`` names ids, under ``key``, that were processed before there was the stream.

    Each micro-batch owns one partition of the table and overwrites only that one, so a
    batch that is run again after a failure leaves no duplicates. State partitions are as many
    as shuffle partitions at the first start (``settings``); for many ids the state store
    should be RocksDB. ``every`` and ``until`` as for ``run_steadily``; without, what is there is
    processed and the stream ends.
    """
    named = stream.withColumn("__id", F.col(key).cast("string"))
    if done is not None:
        seen = F.col(key).cast("string").alias("__done")
        named = named.join(done.select(seen), F.col("__id") == F.col("__done"), "left_anti")
    if at is None:
        fresh = named.dropDuplicates(["__id"])
    else:
        fresh = named.withWatermark(at, within).dropDuplicatesWithinWatermark(["__id"])
    fresh = fresh.drop("__id")

    def write(df: DataFrame, batch_id: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    if every is None:
        return drain_batches(fresh, write, checkpoint)
    return run_steadily(fresh.writeStream.foreachBatch(write), checkpoint, every, until)


def status_counts_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running status counts: every micro-batch writes the counts it changed."""
    counts = stream.groupBy("status").agg(F.count("*").alias("n"))

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return drain_batches(counts, write, checkpoint, mode="update")


def task_status_stream(transitions: DataFrame, path: str, checkpoint: str, **options
                       ) -> StreamingQuery:
    """Running counts by status of ``transitions(task_id, status)``, in flight ones included.

    A row with status ``running`` starts a task, any other ends it in that status. A task counts
    as running from its start to its end and once in the status of its end; a transition
    that arrives again changes nothing. Every micro-batch writes the counts that it changed,
    for ``latest_counts``. Rows may come in any order; the state is two short rows per task.
    Options as for ``run_steadily``: ``every`` and ``until``; without, the stream is drained.
    """
    ends = F.col("status") != "running"
    once = transitions.withColumn("__ends", ends).dropDuplicates(["task_id", "__ends"])
    change = F.when(ends, F.array(
        F.struct(F.col("status").alias("status"), F.lit(1).alias("by")),
        F.struct(F.lit("running").alias("status"), F.lit(-1).alias("by")),
    )).otherwise(F.array(F.struct(F.lit("running").alias("status"), F.lit(1).alias("by"))))
    counts = once.select(F.inline(change)).groupBy("status").agg(F.sum("by").alias("n"))

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    if "every" not in options:
        return drain_batches(counts, write, checkpoint, mode="update")
    return run_steadily(
        counts.writeStream.foreachBatch(write).outputMode("update"), checkpoint, **options)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last value each status reached."""
    return spark.read.parquet(path).groupBy("status").agg(
        F.max_by("n", "batch_id").alias("n"))


def apply_stream(stream: DataFrame, fn: RowFunction, input_col: str = "flow_input",
                 vars_col: str | None = "variables") -> DataFrame:
    """The row function over arriving rows."""
    return apply_flow(stream, fn, input_col=input_col, vars_col=vars_col)


def event_time(column: str) -> Column:
    """A zone-free timestamp as the instant watermarks need."""
    return F.col(column).cast("timestamp")
