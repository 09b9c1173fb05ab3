"""Whole runs: batches with resumption, evaluations, and the indexing of new tickets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.apply import JudgeFunction, RowFunction, apply_flow, call_judge
from tallyloom.operators.inputs import build_variables
from tallyloom.operators.outcomes import judged_results, skip_existing
from tallyloom.operators.tickets import CHECKPOINT_COLUMNS, index_tickets, scan_tickets
from tallyloom.session import durable
from tallyloom.sinks.tables import append_checkpoint
from tallyloom.sources.tables import read_checkpoint

CHECKPOINT_SCHEMA = ", ".join(
    f"{c} {'long' if c == 'flow_input_length' else 'string'}" for c in CHECKPOINT_COLUMNS)


def run_batch(
    tasks: DataFrame, fn: RowFunction | None = None, existing: DataFrame | None = None,
    overwrite: bool = False, setup: Callable[[], RowFunction] | None = None,
    parallelism: int | None = None, in_flight: int = 1, timeout: float | None = None,
) -> DataFrame:
    """Outcome of every task of a batch, in one pass.

    ``tasks(flow_input, filename, flow_variable, ...)``. Tasks whose file is among the
    ``existing`` ones stay in the table as ``skipped``; the function is not called for them.
    """
    marked = build_variables(tasks)
    if existing is not None:
        marked = skip_existing(marked, existing, overwrite)
    else:
        marked = marked.withColumn("status", F.lit("pending"))
    marked = marked.withColumnRenamed("status", "__before")
    skipped = F.col("__before") == "skipped"
    called = apply_flow(
        marked.withColumn("__input", F.when(~skipped, F.col("flow_input"))), fn, "__input",
        setup=setup, parallelism=parallelism, in_flight=in_flight, timeout=timeout)
    return called.withColumn("status", F.when(skipped, "skipped").otherwise(F.col("status")))\
        .withColumn("error", F.when(~skipped, F.col("error"))).drop("__input", "__before")


def evaluate(
    tasks: DataFrame, fn: RowFunction | None = None, judge: JudgeFunction | None = None,
    flow_id: str | None = None, judge_flow_id: str | None = None,
    setup: Callable[[], RowFunction] | None = None,
    judge_setup: Callable[[], JudgeFunction] | None = None,
    parallelism: int | None = None, in_flight: int = 1, timeout: float | None = None,
) -> DataFrame:
    """Answer every question, judge every answer, and classify what failed and where.

    ``tasks(task_id, question, expected_answer)``. Answer and verdict are made on the
    task's own row, so nothing is joined; an answer that failed is not judged. ``in_flight`` and
    ``timeout`` as for ``apply_flow``, for either function.
    """
    answered = apply_flow(tasks, fn, "question", None, setup=setup, parallelism=parallelism,
                          in_flight=in_flight, timeout=timeout)
    rows = answered.withColumn("answer", F.col("result")).withColumn(
        "answer_error", F.when(F.col("status") == "error", F.col("error")))
    verdict = call_judge(F.col("expected_answer"), F.col("answer"), judge, judge_setup, True,
                         in_flight, timeout)
    rows = rows.withColumn("__verdict", verdict).select(
        *tasks.columns,
        F.lit(flow_id).cast("string").alias("flow_id"),
        F.lit(judge_flow_id).cast("string").alias("judge_flow_id"),
        F.lit(True).alias("answered"), "answer", "answer_error",
        F.lit(True).alias("judged"), F.col("__verdict.result").alias("verdict"),
        F.col("__verdict.error").alias("verdict_error"),
    )
    return judged_results(rows)


def index_new_tickets(
    tickets: DataFrame, groups: DataFrame, fn: RowFunction, checkpoint: str,
    department: str | None = None, limit: int | None = None, tags: str | None = None,
    indexed_at: Column | None = None, run: str | None = None,
) -> DataFrame:
    """One run of the ticket job: the newest tickets that the ``checkpoint`` lacks are indexed and
    their rows appended to it. Returns the rows of this run.

    Tickets and outcomes are stored before the checkpoint grows: the function runs once per
    ticket, and a run that breaks off leaves the checkpoint as it was. A ``run`` by a name that the
    checkpoint has already adds nothing to it.
    """
    done = read_checkpoint(tickets.sparkSession, checkpoint, CHECKPOINT_SCHEMA)
    chosen = durable(scan_tickets(tickets, department, limit, done), "tickets")
    rows = durable(index_tickets(chosen, groups, fn, tags, indexed_at), "indexed")
    append_checkpoint(rows.select(*CHECKPOINT_COLUMNS), checkpoint, run)
    return rows
