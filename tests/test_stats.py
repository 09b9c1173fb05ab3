import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import stats
from tallyloom.operators.ordered import weighted_summary, with_positions

SCHEMA = "judge_score string, judge_correctness string, actual_answer string"


def test_summary_of_nothing_is_zero(spark):
    row = stats.eval_summary(spark.createDataFrame([], SCHEMA)).first()
    assert row.total_questions == 0
    assert row.average_score == row.std_score == row.pass_rate == row.q75_score == 0.0


def test_summary_of_one_row_has_no_deviation(spark):
    row = stats.eval_summary(spark.createDataFrame([("7", "CORRECT", "a")], SCHEMA)).first()
    assert (row.average_score, row.std_score, row.pass_rate) == (7.0, None, 100.0)


def test_summary_matches_pandas(spark):
    scores = ["8", "oops", None, "3.5", "10", "3.5", "9"]
    verdicts = ["correct", "Incorrect", "Error", "correct", "CORRECT", None, "unknown"]
    df = spark.createDataFrame(list(zip(scores, verdicts, scores)), SCHEMA)
    row = stats.eval_summary(df).first()
    expected = pd.to_numeric(pd.Series(scores), errors="coerce").fillna(0.0)
    assert row.average_score == pytest.approx(expected.mean())
    assert row.std_score == pytest.approx(expected.std())
    assert row.median_score == expected.median()
    assert row.q25_score == expected.quantile(0.25)
    assert row.q75_score == expected.quantile(0.75)
    assert row.pass_rate == pytest.approx(300 / 7)
    assert row.failure_rate == pytest.approx(100 / 7)


@pytest.mark.parametrize("n", [1, 2, 5, 5000])
def test_quartiles_are_exact_over_many_distinct_values_of_a_hot_key(spark, n):
    rng = np.random.default_rng(n)
    values = np.exp(rng.normal(0, 3, n)).tolist()
    rows = [("hot", v, int(1 + i % 3)) for i, v in enumerate(values)] + [(None, 2.0, 4)]
    freq = spark.createDataFrame(rows, "key string, value double, n long")
    summary = weighted_summary(freq, ["key"])
    got = {r["key"]: r for r in summary.collect()}
    whole = np.repeat(values, [1 + i % 3 for i in range(n)])
    for name, p in (("q25", 25), ("median", 50), ("q75", 75)):
        assert got["hot"][name] == pytest.approx(np.percentile(whole, p))
    assert got["hot"]["count"] == len(whole)
    if len(whole) > 1:
        assert got["hot"]["std"] == pytest.approx(np.std(whole, ddof=1))
    assert (got[None]["count"], got[None]["median"], got[None]["std"]) == (4, 2.0, 0.0)


def test_profile_kinds(spark):
    rows = [("1", "x", None), ("2", "x", None), ("3", "y", None), ("4", None, None),
            ("five", "z", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = {r.column_name: r for r in stats.profile(df).collect()}
    # Exactly 80% numbers is not more than 80%.
    assert got["a"].kind == "categorical"
    assert (got["b"].kind, got["b"].most_common, got["b"].null_count) == ("categorical", "x", 1)
    assert (got["c"].kind, got["c"]["count"], got["c"].null_count) == ("empty", 0, 5)
    for row in got.values():
        assert row["count"] + row.null_count == len(rows)


def test_top_values_are_cut_at_k(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("string").alias("v"),
                                  F.lit("x").alias("w"))
    text = df.select(F.concat(F.lit("n"), "v").alias("v"), "w")
    top = stats.profile_categorical(stats.value_counts(text, ["v", "w"]), 5)
    assert top.where("column_name = 'v'").count() == 5
    assert top.where("column_name = 'w'").first().n == 1000


@pytest.mark.parametrize("lengths,width", [([1, 51], 5), ([1, 52], 10), ([1, 202], 25),
                                           ([1, 502], 50)])
def test_bin_width_follows_the_range(spark, lengths, width):
    df = spark.createDataFrame([("a" * n,) for n in lengths] + [(None,)], "actual_answer string")
    bins = stats.length_histogram(df).collect()
    assert sum(b.n for b in bins) == 2
    assert all(b.bin_end - b.bin_start + 1 == width for b in bins)


def test_top_answers_keep_input_order_on_ties(spark):
    rows = [(i, str(s)) for i, s in enumerate([5, 1, 5, 1, "bad", 9])]
    df = spark.createDataFrame(rows, "input_index long, judge_score string")
    assert [r.input_index for r in stats.top_answers(df, 3).collect()] == [1, 3, 0]
    assert [r.input_index for r in stats.top_answers(df, 3, False).collect()] == [5, 0, 2]


def test_batch_stats_of_nothing(spark):
    row = stats.batch_stats(spark.createDataFrame([], "status string")).first()
    assert (row.total, row.success_pct, row.skipped_pct) == (0, 0.0, 0.0)


def test_positions_within_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"), (F.col("id") * 7919 % 3001).alias("at"))
    got = with_positions(df, ["at"], ["key"], index="i", total="n", start=1).toPandas()
    for _, group in got.groupby("key"):
        ordered = group.sort_values("at")
        assert ordered["i"].tolist() == list(range(1, len(group) + 1))
        assert set(group["n"]) == {len(group)}


def test_positions_over_the_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("at"))
    got = with_positions(df, ["at"]).orderBy("at").collect()
    assert [r.input_index for r in got] == list(range(1000))


def test_report_tables(spark):
    rows = [(i, str(i % 11), "correct", "a" * i) for i in range(30)]
    df = spark.createDataFrame(rows, "input_index long, judge_score string, "
                                     "judge_correctness string, actual_answer string")
    tables = stats.report_tables(df, k=3)
    assert tables["cards"].first().total_questions == 30
    assert tables["lowest"].count() == tables["highest"].count() == 3
    for name in ("correctness", "scores", "lengths"):
        assert sum(r.n for r in tables[name].collect()) == 30
