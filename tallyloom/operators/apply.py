"""Row functions over text: the place where a user's own code runs.

Only the text and its variables travel to the Python workers; every other column stays in
the JVM. A row that raises is recorded and never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import strip
from tallyloom.operators.calls import SLAB, Call, CallWindow, slabs
from tallyloom.operators.outcomes import classify_outcome, parse_verdict

RowFunction = Callable[[str, dict], str]
JudgeFunction = Callable[[str, str], str]

OUTCOME = pa.struct([("result", pa.string()), ("error", pa.string())])


def _guarded(load: Callable[[], Callable], calls: Iterator, in_flight: int, timeout: float | None
             ) -> Iterator[pa.Array]:
    """Outcomes of batches of argument tuples, in order; None stands for no call."""
    function = load()
    window = CallWindow(function, in_flight, timeout) if in_flight > 1 or timeout else None
    try:
        for batch in calls:
            if window:
                done = window.run(batch)
                outcomes = [(c.value, c.error) for c in done]
            else:
                outcomes = [(None, None) if a is None else Call(a).make(function) for a in batch]
            yield pa.array([{"result": None if value is None else str(value), "error": error}
                            for value, error in outcomes], OUTCOME)
    finally:
        if window:
            window.close()


def apply_flow(
    df: DataFrame,
    fn: RowFunction | None = None,
    input_col: str = "flow_input",
    vars_col: str | None = "variables",
    setup: Callable[[], RowFunction] | None = None,
    parallelism: int | None = None,
    in_flight: int = 1,
    timeout: float | None = None,
) -> DataFrame:
    """Call ``fn(text, variables)`` per row; adds ``result``, ``status`` and ``error``.

    A row without a text is not handed to the function and fails as having no content.

    ``setup`` builds the function once per task instead (open a connection, load a model).
    ``in_flight`` calls of a task run at a time, in threads, within each slab of a batch; the function
    must allow for that. ``parallelism`` bounds the tasks by the number of partitions, so that
    never more than the product of both is in flight. A call that takes longer than ``timeout``
    seconds fails its row, and the task goes on.

    The function is treated as non-deterministic, so the optimizer never runs it twice for
    one reference; a lost executor still re-runs its rows, so side effects must be safe to
    repeat. Write the outcome to a table before reading it more than once.
    """
    load = setup or (lambda: fn)

    @F.arrow_udf("result string, error string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _guarded(
            load,
            ([None if t is None else (t, dict(v or {})) for t, v in rows]
             for batch in batches for rows in slabs(batch, SLAB * in_flight)),
            in_flight, timeout,
        )

    if parallelism:
        df = df.repartition(parallelism)
    variables = F.col(vars_col) if vars_col else F.expr("cast(map() as map<string,string>)")
    called = df.withColumn("__out", run.asNondeterministic()(F.col(input_col), variables))
    return classify_outcome(
        called.withColumn("result", F.col("__out.result"))
        .withColumn("error", F.col("__out.error")).drop("__out")
    )


def call_judge(
    expected: Column, actual: Column, fn: JudgeFunction | None = None,
    setup: Callable[[], JudgeFunction] | None = None, skip_missing: bool = False,
    in_flight: int = 1, timeout: float | None = None,
) -> Column:
    """``struct<result, error>`` of calling the judge; optionally not for missing answers.

    ``in_flight`` and ``timeout`` as for ``apply_flow``.
    """
    load = setup or (lambda: fn)

    @F.arrow_udf("result string, error string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _guarded(load, (
            [None if skip_missing and y is None else (x, y) for x, y in rows]
            for batch in batches for rows in slabs(batch, SLAB * in_flight)), in_flight, timeout)

    return run.asNondeterministic()(expected, actual)


def apply_judge(
    df: DataFrame,
    fn: JudgeFunction | None = None,
    expected: str = "expected_answer",
    actual: str = "actual_answer",
    setup: Callable[[], JudgeFunction] | None = None,
    in_flight: int = 1,
    timeout: float | None = None,
) -> DataFrame:
    """Call ``fn(expected, actual)`` per row and parse the verdict JSON it returns."""
    called = df.withColumn("__out", call_judge(
        F.col(expected), F.col(actual), fn, setup, False, in_flight, timeout))
    judged = called.withColumn("verdict", F.col("__out.result"))
    parsed = parse_verdict(judged)
    raised = F.col("__out.error").isNotNull()
    return parsed.withColumn("error", F.coalesce(F.col("__out.error"), F.col("error")))\
        .withColumn("judge_reasoning", F.when(
            raised, F.concat(F.lit("Error during flow execution: "), F.col("__out.error")))
            .otherwise(F.col("judge_reasoning")))\
        .drop("__out")


def _words(text: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def exact_judge(df: DataFrame, expected: str = "expected_answer",
                actual: str = "actual_answer") -> DataFrame:
    """Score 10 for equal texts after strip and lower case, else 0. No Python."""
    same = F.coalesce(
        strip(F.lower(F.col(expected))) == strip(F.lower(F.col(actual))), F.lit(False))
    return df.withColumn("judge_score", F.when(same, 10.0).otherwise(0.0))\
        .withColumn("judge_correctness", F.when(same, "correct").otherwise("incorrect"))


def overlap_judge(df: DataFrame, expected: str = "expected_answer",
                  actual: str = "actual_answer", threshold: float = 7.0) -> DataFrame:
    """Shared over all distinct words of both texts, times 10. No Python."""
    e = F.coalesce(_words(F.col(expected)), F.array().cast("array<string>"))
    a = F.coalesce(_words(F.col(actual)), F.array().cast("array<string>"))
    shared = F.size(F.array_intersect(e, a))
    union = F.size(e) + F.size(a) - shared
    scored = df.withColumn(
        "judge_score", F.when(union > 0, shared * F.lit(10.0) / union).otherwise(F.lit(0.0)))
    return scored.withColumn(
        "judge_correctness",
        F.when(F.col("judge_score") >= threshold, "correct").otherwise("incorrect"))
