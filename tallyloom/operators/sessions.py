"""Final response of event sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordered import join_on


def _placed(events: DataFrame, timeout: Column | None, text: str | None) -> DataFrame:
    """Events, each once, with their session's final message, ``closed_at``, and ``deadline``."""
    body = F.lit(None).cast("string") if text is None else F.col(text)
    once = events.select("session_id", "event_id", "ts", "kind", body.alias("message")).distinct()
    moment = F.struct("ts", "event_id", "message")
    ends = once.groupBy("session_id").agg(
        F.min(F.when(F.col("kind") == "message", moment)).alias("closed_at"),
        F.min("ts").alias("first"))
    if timeout is not None:
        ends = ends.withColumn("deadline", F.col("first") + timeout).withColumn(
            "closed_at", F.when(F.col("closed_at.ts") <= F.col("deadline"), F.col("closed_at")))
    return join_on(once, ends.drop("first"), ["session_id"])


def _in_time(timeout: Column | None) -> Column:
    open_end = F.lit(True) if timeout is None else F.col("ts") <= F.col("deadline")
    closed = F.struct("closed_at.ts", "closed_at.event_id")
    return F.when(F.col("closed_at").isNull(), open_end)\
        .otherwise(F.struct("ts", "event_id") < closed)


def session_response(
    events: DataFrame, timeout: Column | None = None, text: str | None = None
) -> DataFrame:
    """First final message of every session and the number of artefacts up to it.

    ``events(session_id, event_id, ts, kind)`` with kinds ``message``, ``artefact`` and
    others; repeated event ids count once. A message later than ``timeout`` after the session's
    first event is no answer, nor do artefacts count after that; without it sessions wait
    forever. ``text`` names the messages' text, which comes along as ``response``. All folds
    keep a fixed-size state per session. Grouping by a wrapped id after the join lets adaptive
    execution split a hot session.
    """
    artefacts = F.count_if((F.col("kind") == "artefact") & _in_time(timeout))
    folded = _placed(events, timeout, text).groupBy(F.struct("session_id").alias("id")).agg(
        F.max("closed_at").alias("closed_at"), artefacts.alias("n_artefacts"))
    return folded.select(
        "id.session_id", F.col("closed_at.event_id").alias("response_event"), "n_artefacts",
        F.when(F.col("closed_at").isNull(), "timeout").otherwise("success").alias("status"),
        *([] if text is None else [F.col("closed_at.message").alias("response")]),
    )


def session_artefacts(
    events: DataFrame, timeout: Column | None = None, text: str | None = None
) -> DataFrame:
    """The artefacts themselves, one row each, seen before their session's final message."""
    found = _placed(events, timeout, text).where((F.col("kind") == "artefact") & _in_time(timeout))
    return found.select("session_id", "event_id", "ts",
                        *([] if text is None else [F.col("message").alias("artefact")]))
