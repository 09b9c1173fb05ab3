"""Summaries, profiles and distributions over judged results.

Every statistic starts by folding the table to distinct values with counts. That fold
combines map-side, so a hot key or value costs no more than any other, and the shuffles
after it carry distinct values instead of rows. Where several figures come from the same
fold it is written once: the input is scanned, and its verdicts parsed, a single time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import percent, safe_double
from tallyloom.functions.verdicts import normalise_correctness, quality_band
from tallyloom.operators.ordered import weighted_summary
from tallyloom.session import durable

# Columns that are never profiled.
FIXED_COLUMNS = ("question", "expected_answer", "actual_answer", "flow_id", "judge_flow_id")

SUMMARY_COLUMNS = [
    "total_questions", "average_score", "median_score", "std_score", "min_score", "max_score",
    "q25_score", "q75_score", "pass_rate", "accuracy", "error_rate", "failure_rate", "quality",
]


def eval_summary_by(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score statistics and verdict rates per key; scores that are no number count as 0."""
    verdict = F.lower("judge_correctness")
    freq = results.groupBy(
        *keys, F.coalesce(safe_double(F.col("judge_score")), F.lit(0.0)).alias("value")
    ).agg(
        F.count("*").alias("n"),
        F.count_if(verdict == "correct").alias("n_correct"),
        F.count_if(verdict == "incorrect").alias("n_incorrect"),
        F.count_if(verdict == "error").alias("n_error"),
    )
    freq = durable(freq, "score-counts")
    verdicts = ["n_correct", "n_incorrect", "n_error"]
    scores = weighted_summary(freq, keys, totals=verdicts)
    n = F.col("count")
    return scores.select(
        *keys,
        n.alias("total_questions"),
        F.col("mean").alias("average_score"),
        *[F.col(c).alias(f"{c}_score") for c in ("median", "std", "min", "max", "q25", "q75")],
        percent(F.col("n_correct"), n).alias("pass_rate"),
        percent(F.col("n_correct"), n).alias("accuracy"),
        percent(F.col("n_incorrect"), n).alias("error_rate"),
        percent(F.col("n_error"), n).alias("failure_rate"),
        quality_band(percent(F.col("n_incorrect"), n)).alias("quality"),
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """One-row summary of a run; all zeroes for an empty run."""
    one = eval_summary_by(results.withColumn("__all", F.lit(1)), ["__all"])
    # The global aggregate always yields a row, which turns an empty run into zeroes.
    return one.agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("bigint" if c == "total_questions" else "double"))
          .alias(c) if c not in ("std_score", "quality") else F.max(c).alias(c)
          for c in SUMMARY_COLUMNS]
    ).withColumn(
        "std_score", F.when(F.col("total_questions") == 0, F.lit(0.0)).otherwise(F.col("std_score"))
    ).withColumn("quality", F.coalesce("quality", F.lit("excellent")))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count of every distinct value of every column, as (column_name, value, n).

    One scan, one unpivot and one shuffle for all columns together.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return durable(counts, "value-counts")


def infer_kind(freq: DataFrame) -> DataFrame:
    """Type and null counts per column: numerical if over 80% of its values are numbers."""
    present = F.col("value").isNotNull()
    numeric = safe_double(F.col("value")).isNotNull()
    counted = freq.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(F.when(numeric, F.col("n"))), F.lit(0)).alias("numeric_count"),
        F.count_if(present).alias("unique_count"),
    )
    kind = (
        F.when(F.col("count") == 0, F.lit("empty"))
        .when(F.col("numeric_count") * 100 > F.col("count") * 80, F.lit("numerical"))
        .otherwise(F.lit("categorical"))
    )
    return counted.withColumn("kind", kind)


def profile_numeric(freq: DataFrame) -> DataFrame:
    """Statistics of the numerical columns over their number cells only."""
    kinds = infer_kind(freq).where(F.col("kind") == "numerical").drop("unique_count", "kind")
    numbers = freq.select(
        "column_name", safe_double(F.col("value")).alias("value"), "n"
    ).where(F.col("value").isNotNull())
    stats = weighted_summary(numbers, ["column_name"]).drop("count")
    return kinds.join(stats, "column_name")


def _top_values(freq: DataFrame, k: int) -> DataFrame:
    by_count = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return (
        freq.where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(by_count))
        .where(F.col("rank") <= k)
    )


def profile_categorical(freq: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values of each categorical column with count and share.

    Row-number ranking with a bound: Spark cuts every input partition to ``k`` rows per
    column before the shuffle.
    """
    kinds = infer_kind(freq).where(F.col("kind") == "categorical")
    return (
        kinds.select("column_name", "count", "null_count", "unique_count")
        .join(_top_values(freq, k), "column_name")
        .withColumn("pct", F.round(percent(F.col("n"), F.col("count")), 2))
        .select("column_name", "count", "null_count", "unique_count", "rank", "value", "n", "pct")
    )


def profile(df: DataFrame, exclude: Sequence[str] = FIXED_COLUMNS) -> DataFrame:
    """One row per analysed column: kind, counts, number statistics or the mode."""
    freq = value_counts(df, [c for c in df.columns if c not in exclude])
    kinds = infer_kind(freq)
    numeric = profile_numeric(freq).drop("count", "null_count", "numeric_count")
    mode = _top_values(freq, 1).select(
        "column_name", F.col("value").alias("most_common"), F.col("n").alias("most_common_count")
    )
    joined = kinds.join(numeric, "column_name", "left").join(mode, "column_name", "left")
    categorical = F.col("kind") == "categorical"
    return joined.select(
        "column_name", "kind", "count", "null_count",
        F.when(F.col("kind") == "numerical", F.col("numeric_count")).alias("numeric_count"),
        "mean", "median", "std", "min", "max", "q25", "q75",
        F.when(categorical, F.col("unique_count")).alias("unique_count"),
        F.when(categorical, F.col("most_common")).alias("most_common"),
        F.when(categorical, F.col("most_common_count")).alias("most_common_count"),
    )


def correctness_counts(results: DataFrame) -> DataFrame:
    return (
        results.groupBy(normalise_correctness(F.col("judge_correctness")).alias("correctness"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "correctness")
    )


def score_distribution(results: DataFrame) -> DataFrame:
    """Count per distinct score, ascending; cells that are no number are left out."""
    freq = (
        results.groupBy(safe_double(F.col("judge_score")).alias("score"))
        .agg(F.count("*").alias("n"))
    )
    freq = durable(freq, "score-counts").where(F.col("score").isNotNull())
    mean = freq.agg(F.sum(F.col("n") * F.col("score")) / F.sum("n")).scalar()
    score = F.col("score")
    whole = score == F.floor(score)
    return freq.select(
        "score",
        F.when(whole, score.try_cast("bigint").cast("string")).otherwise(score.cast("string"))
        .alias("label"),
        "n",
        (F.abs(score - mean) < 0.1).alias("has_mean"),
    ).orderBy("score")


def length_histogram(results: DataFrame, text: str = "actual_answer") -> DataFrame:
    """Histogram of answer lengths, the bin width following the range of the lengths."""
    freq = (
        results.groupBy(F.char_length(text).alias("length")).agg(F.count("*").alias("n"))
    )
    freq = durable(freq, "length-counts").where(F.col("length").isNotNull())
    span = freq.agg(
        F.struct(
            (F.max("length") - F.min("length")).alias("range"),
            (F.sum(F.col("n") * F.col("length")) / F.sum("n")).alias("mean"),
        )
    ).scalar()
    reach = span.getField("range")
    width = (
        F.when(reach <= 50, 5).when(reach <= 200, 10).when(reach <= 500, 25).otherwise(50)
    )
    mean = span.getField("mean")
    start = F.floor(F.col("length") / width) * width
    return (
        freq.select(start.cast("bigint").alias("bin_start"), width.alias("w"),
                    mean.alias("mean"), "n")
        .groupBy("bin_start")
        .agg(F.sum("n").alias("n"), F.max("w").alias("w"), F.max("mean").alias("mean"))
        .withColumn("bin_end", F.col("bin_start") + F.col("w") - 1)
        .select(
            F.format_string("%d-%d", "bin_start", "bin_end").alias("label"),
            "bin_start", "bin_end", "n",
            F.col("mean").between(F.col("bin_start"), F.col("bin_end")).alias("has_mean"),
        )
        .orderBy("bin_start")
    )


def report_cards(results: DataFrame) -> DataFrame:
    """The headline figures of a report in one pass."""
    score = F.coalesce(safe_double(F.col("judge_score")), F.lit(0.0))
    verdict = F.lower("judge_correctness")
    return results.agg(
        F.count("*").alias("total_questions"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("average_score"),
        percent(F.count_if(verdict == "correct"), F.count("*")).alias("accuracy"),
        percent(F.count_if(verdict == "incorrect"), F.count("*")).alias("error_rate"),
        percent(F.count_if(verdict == "error"), F.count("*")).alias("failure_rate"),
        F.coalesce(F.avg(F.char_length("actual_answer")), F.lit(0.0)).alias("average_length"),
    ).withColumn("quality", quality_band(F.col("error_rate")))


def top_answers(
    results: DataFrame, k: int = 10, lowest: bool = True, order: str = "input_index"
) -> DataFrame:
    """The ``k`` answers with the lowest or highest score; ties keep input order.

    Scores that are no number sort last and are dropped from what is left, which spares
    every row the filter and gives the same rows.
    """
    scored = results.withColumn("score", safe_double(F.col("judge_score")))
    by_score = F.asc_nulls_last("score") if lowest else F.desc_nulls_last("score")
    return scored.orderBy(by_score, order).limit(k).where(F.col("score").isNotNull()).withColumn(
        "score_label", F.format_string("%.1f", "score")
    )


def batch_stats(outcomes: DataFrame, skipped: Column | None = None) -> DataFrame:
    """Completed, failed and skipped counts with their shares, from a ``status`` column."""
    status = F.col("status")
    done = F.count_if(status == "success")
    failed = F.count_if(status.isin("failed", "error"))
    left_out = F.count_if(status == "skipped") if skipped is None else F.max(skipped)
    return (
        outcomes.agg(done.alias("completed"), failed.alias("failed"),
                     F.coalesce(left_out, F.lit(0)).cast("bigint").alias("skipped"))
        .withColumn("total", F.col("completed") + F.col("failed") + F.col("skipped"))
        .withColumn("success_pct",
                    percent(F.col("completed"), F.col("completed") + F.col("failed")))
        .withColumn("skipped_pct", percent(F.col("skipped"), F.col("total")))
    )


def throughput(events: DataFrame, ts: str, width: str = "1 hour") -> DataFrame:
    """Items and items per second in each tumbling window.

    Local (zone-free) timestamps stay as they are: windows are cut on the wall clock.
    """
    return (
        events.groupBy(F.window(ts, width).alias("w"))
        .agg(F.count("*").alias("items"))
        .select(
            F.col("w.start").alias("window_start"), "items",
            (F.col("items") / (F.unix_seconds(F.col("w.end").cast("timestamp"))
                               - F.unix_seconds(F.col("w.start").cast("timestamp"))))
            .alias("per_second"),
        )
    )


def report_tables(
    results: DataFrame, k: int = 10, order: str = "input_index"
) -> dict[str, DataFrame]:
    """Everything a report shows, by name. Store the results before: each table reads them."""
    return {
        "cards": report_cards(results),
        "correctness": correctness_counts(results),
        "scores": score_distribution(results),
        "lengths": length_histogram(results),
        "lowest": top_answers(results, k, True, order),
        "highest": top_answers(results, k, False, order),
    }
