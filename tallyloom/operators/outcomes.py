"""Statuses, failure stages and the joins between tasks and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.binding import let
from tallyloom.functions.verdicts import (
    NO_CONTENT, verdict_extras, verdict_field, verdict_map,
)


def has_content(text: Column) -> Column:
    return text.isNotNull() & (text != "") & (text != NO_CONTENT)


def classify_outcome(df: DataFrame, result: str = "result", error: str = "error") -> DataFrame:
    """Add ``status``: an exception is ``error``, no content is ``failed``.

    Only a success keeps its result, and only the others carry an error text.
    """
    raised = F.col(error).isNotNull()
    empty = ~has_content(F.col(result)) | F.col(result).isNull()
    status = F.when(raised, "error").when(empty, "failed").otherwise("success")
    return (
        df.withColumn("status", status)
        .withColumn(result, F.when(F.col("status") == "success", F.col(result)))
        .withColumn(
            error,
            F.when(F.col("status") == "failed", F.lit("No content returned"))
            .otherwise(F.col(error)),
        )
    )


def parse_verdict(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Judge JSON to score, correctness, reasoning and a map of the remaining fields.

    Text that is no JSON object becomes a ``parse_judge`` failure with score 0.
    """
    def fields(f: Column) -> Column:
        bad = f.isNull()
        broken = F.lit("Error parsing judge result")
        return F.struct(
            F.when(bad, "0").otherwise(verdict_field(f, "total_rating", "0")).alias("score"),
            F.when(bad, "Error").otherwise(verdict_field(f, "correctness", "Unknown"))
            .alias("correctness"),
            F.when(bad, broken)
            .otherwise(verdict_field(f, "reasoning", "No reasoning provided")).alias("reasoning"),
            verdict_extras(f).alias("extras"),
            F.when(bad, broken).alias("error"),
        )

    parsed = df.withColumn("__v", let(verdict_map(F.col(verdict)), fields))
    return parsed.select(
        *[c for c in df.columns],
        F.col("__v.score").alias("judge_score"),
        F.col("__v.correctness").alias("judge_correctness"),
        F.col("__v.reasoning").alias("judge_reasoning"),
        F.col("__v.extras").alias("extras"),
        F.col("__v.error").alias("error"),
    )


# Failure stage -> (reasoning, error) shown for it; {} takes the message.
STAGE_TEXT = {
    "schedule_flow": ("Error scheduling flow: {}", "{}"),
    "flow": ("Error during flow execution: {}", "{}"),
    "no_content": ("No content returned from flow", "No content"),
    "schedule_judge": ("Error scheduling judge: {}", "{}"),
    "judge": ("Error during flow execution: {}", "{}"),
    "no_judge_content": ("No content returned from judge", "No judge content"),
    "parse_judge": ("Error parsing judge result: {}", "{}"),
}


def _stage_text(which: int, message: Column) -> Column:
    out = F.lit(None).cast("string")
    for stage, texts in STAGE_TEXT.items():
        before, _, after = texts[which].partition("{}")
        text = F.lit(texts[which]) if "{}" not in texts[which] else F.concat(
            F.lit(before), F.coalesce(message, F.lit("unknown")), F.lit(after))
        out = F.when(F.col("stage") == stage, text).otherwise(out)
    return out


def attach_verdicts(tasks: DataFrame, answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every task with its answer and verdict; what is missing or broken becomes a stage error.

    ``tasks(task_id, question, expected_answer)``, ``answers(task_id, answer, answer_error)``
    and ``verdicts(task_id, verdict, verdict_error)`` are one row per task id. An absent
    answer or verdict row means the step could not be scheduled.
    """
    a = answers.select("task_id", "answer", "answer_error", F.lit(True).alias("answered"))
    v = verdicts.select("task_id", "verdict", "verdict_error", F.lit(True).alias("judged"))
    return judged_results(tasks.join(a, "task_id", "left").join(v, "task_id", "left"))


def judged_results(joined: DataFrame) -> DataFrame:
    """Results with their failure stage from rows that carry a task, answer and verdict.

    Columns: ``task_id, question, expected_answer``; ``answered`` (NULL if not submitted),
    ``answer``, ``answer_error``; ``judged``, ``verdict``, ``verdict_error``. Others stay.
    """
    steps = ("answered", "answer", "answer_error", "judged", "verdict", "verdict_error")
    others = [c for c in joined.columns
              if c not in (*steps, "task_id", "question", "expected_answer")]
    fields = verdict_map(F.col("verdict"))
    stage = (
        F.when(F.col("answered").isNull(), "schedule_flow")
        .when(F.col("answer_error").isNotNull(), "flow")
        .when(~has_content(F.col("answer")) | F.col("answer").isNull(), "no_content")
        .when(F.col("judged").isNull(), "schedule_judge")
        .when(F.col("verdict_error").isNotNull(), "judge")
        .when(~has_content(F.col("verdict")) | F.col("verdict").isNull(), "no_judge_content")
        .when(fields.isNull(), "parse_judge")
        .otherwise("success")
    )
    staged = joined.withColumn("stage", stage).withColumn("__fields", fields)
    ok = F.col("stage") == "success"
    f = F.col("__fields")
    message = (
        F.when(F.col("stage") == "flow", F.col("answer_error"))
        .when(F.col("stage") == "judge", F.col("verdict_error"))
        .when(F.col("stage") == "parse_judge", F.lit("not a JSON object"))
        .otherwise(F.lit("not submitted"))
    )
    answer = (
        F.when(F.col("stage").isin("schedule_flow", "flow"), F.concat(F.lit("ERROR: "), message))
        .when(F.col("stage") == "no_content", F.lit("ERROR: No content returned"))
        .otherwise(F.col("answer"))
    )
    return staged.select(
        "task_id", "question", "expected_answer", *others,
        answer.alias("actual_answer"), "stage",
        F.when(ok, verdict_field(f, "total_rating", "0")).otherwise("0").alias("judge_score"),
        F.when(ok, verdict_field(f, "correctness", "Unknown")).otherwise("Error")
        .alias("judge_correctness"),
        F.when(ok, verdict_field(f, "reasoning", "No reasoning provided"))
        .otherwise(_stage_text(0, message)).alias("judge_reasoning"),
        F.when(ok, verdict_extras(f)).alias("extras"),
        F.when(~ok, _stage_text(1, message)).alias("error"),
    )


def match_within(tasks: DataFrame, results: DataFrame, timeout: Column) -> DataFrame:
    """Each task with its earliest result inside the timeout, or a timeout failure.

    ``tasks(task_id, submitted_at)`` is unique by id, so the inner join yields at most one
    row per result. It is the inner join that sees hot ids. Grouping by a wrapped id keeps
    its output free of a partitioning demand, which lets adaptive execution split a hot id
    over tasks; what it joins to afterwards is one to one.
    """
    inside = (F.col("arrived_at") >= F.col("submitted_at")) & (
        F.col("arrived_at") <= F.col("submitted_at") + timeout
    )
    earliest = (
        results.select("task_id", "arrived_at")
        .join(tasks, "task_id").where(inside)
        .groupBy(F.struct("task_id").alias("id"))
        .agg(F.min("arrived_at").alias("completed_at"))
        .select("id.task_id", "completed_at")
    )
    done = F.col("completed_at").isNotNull()
    return tasks.join(earliest, "task_id", "left").select(
        "task_id", "submitted_at", "completed_at",
        F.when(done, "success").otherwise("failed").alias("status"),
        F.when(~done, F.lit("Timeout waiting for completion")).alias("error"),
    )


def combine_results(completed: DataFrame, failed: DataFrame) -> DataFrame:
    """Both result sets under the union of their columns."""
    return completed.unionByName(failed, allowMissingColumns=True)


def _distinct(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Distinct values, found under a wrapped key.

    A join on the values then shuffles both its sides itself, which is what lets adaptive
    execution split a hot key on the other side.
    """
    wrapped = df.select(F.struct(value.alias(name)).alias("__id")).distinct()
    return wrapped.select(f"__id.{name}")


def resume(df: DataFrame, done: DataFrame, key: str, done_key: str | None = None,
           retry_failed: bool = False) -> DataFrame:
    """Rows whose id is not in the checkpoint; ids compare as text.

    Failed ids are in the checkpoint too and are skipped unless ``retry_failed``.
    """
    if retry_failed:
        failed = F.coalesce(F.col("flow_process_id").startswith("ERROR: "), F.lit(False))
        done = done.where(~failed)
    seen = _distinct(done, F.col(done_key or key).cast("string"), "__seen")
    return df.join(seen, df[key].cast("string") == F.col("__seen"), "left_anti")


def skip_existing(df: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Mark tasks whose output file is there already as ``skipped``, the rest ``pending``.

    A task without a file name is never skipped. Keeping both in one table gives the kept
    rows and the skipped count from the same pass.
    """
    if overwrite:
        return df.withColumn("status", F.lit("pending"))
    names = _distinct(existing, F.col("filename"), "__name")
    found = names.withColumn("__found", F.lit(True))
    return (
        df.join(found, df["filename"] == F.col("__name"), "left")
        .withColumn("status", F.when(F.col("__found"), "skipped").otherwise("pending"))
        .drop("__name", "__found")
    )
