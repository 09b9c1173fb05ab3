"""Queries over judged results."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import format_executed
from tallyloom.functions.verdicts import extract_output
from tallyloom.operators import outcomes, runs, sessions, stats
from tallyloom.operators.apply import apply_judge, exact_judge, overlap_judge
from tallyloom.plans.common import (
    SQL, query, rounded, sql_number, sql_stamp, sql_strip, stamp, table,
)
from tallyloom.session import durable


# Verdict text made from an event; the same expression serves Spark and the check.
VERDICT_CASE = """
CASE WHEN k < 3 THEN '{"total_rating": ' || k
     WHEN k < 6 THEN '{"total_rating":"n/a","correctness":"incorrect","k":"' || k || '"}'
     WHEN event_type = 'signup' THEN '{"total_rating":' || (k % 11) || ',"k":"' || k || '"}'
     ELSE '{"total_rating":' || (k % 11) || ',"correctness":"' ||
       CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'view' THEN 'Correct'
            WHEN 'click' THEN 'incorrect' ELSE 'Error' END ||
       '","reasoning":"' || event_type || ' ' || (k % 7) || '","k":"' || k || '"}' END
"""

VERDICTS_SQL = f"""
verdicts AS (
  SELECT event_id AS input_index, 'flow-' || (user_id % 4) AS flow_id,
         'Question ' || event_id AS question, event_type || ' ' || props AS actual_answer,
         {VERDICT_CASE} AS verdict
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
results AS (
  SELECT input_index, flow_id, question, actual_answer,
    CASE WHEN NOT json_valid(verdict) THEN '0'
         ELSE coalesce(json_extract_string(verdict, '$.total_rating'), '0') END AS judge_score,
    CASE WHEN NOT json_valid(verdict) THEN 'Error'
         ELSE coalesce(json_extract_string(verdict, '$.correctness'), 'Unknown')
    END AS judge_correctness,
    CASE WHEN NOT json_valid(verdict) THEN 'Error parsing judge result'
         ELSE coalesce(json_extract_string(verdict, '$.reasoning'), 'No reasoning provided')
    END AS judge_reasoning,
    CASE WHEN json_valid(verdict) THEN json_extract_string(verdict, '$.k') END AS k,
    CASE WHEN NOT json_valid(verdict) THEN 'Error parsing judge result' END AS error
  FROM verdicts),
scored AS (SELECT *, {sql_number('judge_score')} AS num FROM results)
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged results made from the events."""
    stored = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    events = stored.withColumn(
        "k", F.get_json_object("props", "$.k").try_cast("bigint"))
    verdicts = events.select(
        F.col("event_id").alias("input_index"),
        F.expr("'flow-' || (user_id % 4)").alias("flow_id"),
        F.expr("'Question ' || event_id").alias("question"),
        F.expr("event_type || ' ' || props").alias("actual_answer"),
        F.expr(VERDICT_CASE).alias("verdict"),
    )
    parsed = outcomes.parse_verdict(verdicts)
    return parsed.withColumn("k", F.col("extras")["k"]).drop("verdict", "extras")


@query("parse_verdict", f"""WITH {VERDICTS_SQL}
SELECT input_index, judge_score, judge_correctness, judge_reasoning, k, error FROM results""")
def parse_verdict(spark, sf_dir):
    return results(spark, sf_dir).select(
        "input_index", "judge_score", "judge_correctness", "judge_reasoning", "k", "error")


def summary_sql(keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    share = "100.0 * count(*) FILTER (lower(judge_correctness) = '{}') / count(*)"
    bad = share.format("incorrect")
    return f"""WITH {VERDICTS_SQL},
    s AS (SELECT {lead}coalesce(num, 0.0) AS score, judge_correctness FROM scored)
    SELECT {lead}count(*) AS total_questions, round(avg(score), 6) AS average_score,
      round(median(score), 6) AS median_score, round(stddev_samp(score), 6) AS std_score,
      min(score) AS min_score, max(score) AS max_score,
      round(quantile_cont(score, 0.25), 6) AS q25_score,
      round(quantile_cont(score, 0.75), 6) AS q75_score,
      round({share.format('correct')}, 6) AS pass_rate,
      round({share.format('correct')}, 6) AS accuracy,
      round({bad}, 6) AS error_rate, round({share.format('error')}, 6) AS failure_rate,
      CASE WHEN {bad} < 5 THEN 'excellent' WHEN {bad} < 15 THEN 'good' ELSE 'moderate'
      END AS quality
    FROM s {tail}"""


@query("eval_summary", summary_sql())
def eval_summary(spark, sf_dir):
    return rounded(stats.eval_summary(results(spark, sf_dir)))


@query("eval_summary_by", summary_sql("flow_id"))
def eval_summary_by(spark, sf_dir):
    return rounded(stats.eval_summary_by(results(spark, sf_dir), ["flow_id"]))


PROFILED = ["judge_score", "judge_correctness", "judge_reasoning", "k", "error"]

PROFILE_SQL = f"""WITH {VERDICTS_SQL},
cells AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS column_name, {c} AS value FROM results" for c in PROFILED)}),
nums AS (SELECT *, {sql_number('value')} AS num FROM cells),
kinds AS (
  SELECT column_name, count(value) AS count, count(*) - count(value) AS null_count,
         count(num) AS numeric_count, count(DISTINCT value) AS unique_count,
         CASE WHEN count(value) = 0 THEN 'empty'
              WHEN count(num) * 100 > count(value) * 80 THEN 'numerical'
              ELSE 'categorical' END AS kind
  FROM nums GROUP BY column_name),
numeric_stats AS (
  SELECT column_name, round(avg(num), 6) AS mean, round(median(num), 6) AS median,
         round(stddev_samp(num), 6) AS std, min(num) AS min, max(num) AS max,
         round(quantile_cont(num, 0.25), 6) AS q25, round(quantile_cont(num, 0.75), 6) AS q75
  FROM nums WHERE num IS NOT NULL GROUP BY column_name),
freq AS (SELECT column_name, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank
           FROM freq)
"""


def _profiled(spark, sf_dir) -> DataFrame:
    return results(spark, sf_dir).select(*PROFILED)


@query("infer_kind", PROFILE_SQL + """
SELECT column_name, count, null_count, numeric_count, unique_count, kind FROM kinds""")
def infer_kind(spark, sf_dir):
    return stats.infer_kind(stats.value_counts(_profiled(spark, sf_dir), PROFILED))


@query("profile_numeric", PROFILE_SQL + """
SELECT column_name, count, null_count, numeric_count, mean, median, std, min, max, q25, q75
FROM kinds JOIN numeric_stats USING (column_name) WHERE kind = 'numerical'""")
def profile_numeric(spark, sf_dir):
    return rounded(stats.profile_numeric(stats.value_counts(_profiled(spark, sf_dir), PROFILED)))


@query("profile_categorical", PROFILE_SQL + """
SELECT column_name, count, null_count, unique_count, CAST(rank AS INTEGER) AS rank, value, n,
       round(100.0 * n / count, 2) AS pct
FROM kinds JOIN ranked USING (column_name) WHERE kind = 'categorical' AND rank <= 20""")
def profile_categorical(spark, sf_dir):
    return stats.profile_categorical(stats.value_counts(_profiled(spark, sf_dir), PROFILED))


@query("profile_table", PROFILE_SQL + """
SELECT k.column_name, kind, count, null_count,
  CASE WHEN kind = 'numerical' THEN numeric_count END AS numeric_count,
  CASE WHEN kind = 'numerical' THEN mean END AS mean,
  CASE WHEN kind = 'numerical' THEN median END AS median,
  CASE WHEN kind = 'numerical' THEN std END AS std,
  CASE WHEN kind = 'numerical' THEN min END AS min,
  CASE WHEN kind = 'numerical' THEN max END AS max,
  CASE WHEN kind = 'numerical' THEN q25 END AS q25,
  CASE WHEN kind = 'numerical' THEN q75 END AS q75,
  CASE WHEN kind = 'categorical' THEN unique_count END AS unique_count,
  CASE WHEN kind = 'categorical' THEN value END AS most_common,
  CASE WHEN kind = 'categorical' THEN n END AS most_common_count
FROM kinds k LEFT JOIN numeric_stats USING (column_name)
LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.column_name = k.column_name""")
def profile_table(spark, sf_dir):
    judged = results(spark, sf_dir).drop("input_index")
    return rounded(stats.profile(judged))


@query("correctness_counts", f"""WITH {VERDICTS_SQL}
SELECT CASE WHEN judge_correctness IN ('correct', 'Correct', 'true', '1') THEN 'Correct'
            WHEN judge_correctness IN ('incorrect', 'Incorrect', 'false', '0') THEN 'Incorrect'
            ELSE 'Unknown' END AS correctness, count(*) AS n
FROM results GROUP BY 1""")
def correctness_counts(spark, sf_dir):
    return stats.correctness_counts(results(spark, sf_dir))


@query("score_distribution", f"""WITH {VERDICTS_SQL},
m AS (SELECT avg(num) AS mean FROM scored)
SELECT num AS score, CAST(CAST(num AS BIGINT) AS VARCHAR) AS label, count(*) AS n,
       abs(num - (SELECT mean FROM m)) < 0.1 AS has_mean
FROM scored WHERE num IS NOT NULL GROUP BY num""")
def score_distribution(spark, sf_dir):
    return stats.score_distribution(results(spark, sf_dir))


@query("length_histogram", """
WITH lengths AS (SELECT length(text) AS len FROM documents WHERE text IS NOT NULL),
span AS (SELECT CASE WHEN max(len) - min(len) <= 50 THEN 5 WHEN max(len) - min(len) <= 200 THEN 10
                     WHEN max(len) - min(len) <= 500 THEN 25 ELSE 50 END AS w,
                avg(len) AS mean FROM lengths),
bins AS (SELECT (len // w) * w AS bin_start, w, mean FROM lengths, span)
SELECT bin_start || '-' || (bin_start + w - 1) AS label, CAST(bin_start AS BIGINT) AS bin_start,
       CAST(bin_start + w - 1 AS BIGINT) AS bin_end, count(*) AS n,
       mean BETWEEN bin_start AND bin_start + w - 1 AS has_mean
FROM bins GROUP BY bin_start, w, mean""")
def length_histogram(spark, sf_dir):
    return stats.length_histogram(table(spark, sf_dir, "documents"), "text")


@query("report_cards", f"""WITH {VERDICTS_SQL},
c AS (SELECT count(*) AS n, avg(coalesce(num, 0.0)) AS score, avg(length(actual_answer)) AS len,
        100.0 * count(*) FILTER (lower(judge_correctness) = 'correct') / count(*) AS good,
        100.0 * count(*) FILTER (lower(judge_correctness) = 'incorrect') / count(*) AS bad,
        100.0 * count(*) FILTER (lower(judge_correctness) = 'error') / count(*) AS broken
      FROM scored)
SELECT n AS total_questions, round(score, 6) AS average_score, round(good, 6) AS accuracy,
       round(bad, 6) AS error_rate, round(broken, 6) AS failure_rate,
       round(len, 6) AS average_length,
       CASE WHEN bad < 5 THEN 'excellent' WHEN bad < 15 THEN 'good' ELSE 'moderate' END AS quality
FROM c""")
def report_cards(spark, sf_dir):
    return rounded(stats.report_cards(results(spark, sf_dir)))


def top_sql(direction: str) -> str:
    return f"""WITH {VERDICTS_SQL}
    SELECT input_index, question, actual_answer, num AS score,
           format('{{:.1f}}', num) AS score_label
    FROM scored WHERE num IS NOT NULL ORDER BY num {direction}, input_index LIMIT 10"""


def _top(spark, sf_dir, lowest):
    top = stats.top_answers(results(spark, sf_dir), 10, lowest)
    return top.select("input_index", "question", "actual_answer", "score", "score_label")


@query("lowest_scores", top_sql("ASC"))
def lowest_scores(spark, sf_dir):
    return _top(spark, sf_dir, True)


@query("highest_scores", top_sql("DESC"))
def highest_scores(spark, sf_dir):
    return _top(spark, sf_dir, False)


ANSWER_LENGTHS_SQL = SQL["length_histogram"].replace(
    "WITH lengths AS (SELECT length(text) AS len FROM documents WHERE text IS NOT NULL)",
    f"WITH {VERDICTS_SQL}, lengths AS (SELECT length(actual_answer) AS len FROM results "
    "WHERE actual_answer IS NOT NULL)")


@query("report_tables", f"""
SELECT 'correctness' AS report, correctness AS label, n FROM ({SQL['correctness_counts']})
UNION ALL SELECT 'scores', label, n FROM ({SQL['score_distribution']})
UNION ALL SELECT 'lengths', label, n FROM ({ANSWER_LENGTHS_SQL})
UNION ALL SELECT 'lowest', score_label, input_index FROM ({SQL['lowest_scores']})
UNION ALL SELECT 'highest', score_label, input_index FROM ({SQL['highest_scores']})
UNION ALL SELECT 'cards', quality, total_questions FROM ({SQL['report_cards']})""")
def report_tables(spark, sf_dir):
    """All tables of a report over results that were stored once."""
    tables = stats.report_tables(durable(results(spark, sf_dir), "results"))
    shown = {"correctness": ("correctness", "n"), "scores": ("label", "n"),
             "lengths": ("label", "n"), "lowest": ("score_label", "input_index"),
             "highest": ("score_label", "input_index"), "cards": ("quality", "total_questions")}
    return reduce(DataFrame.unionByName, [
        tables[name].select(F.lit(name).alias("report"), F.col(label).alias("label"),
                            F.col(value).cast("long").alias("n"))
        for name, (label, value) in shown.items()])


@query("combine_results", f"""WITH {VERDICTS_SQL}
SELECT input_index, judge_score, k, NULL AS error FROM results WHERE error IS NULL
UNION ALL SELECT input_index, judge_score, NULL, error FROM results WHERE error IS NOT NULL""")
def combine_results(spark, sf_dir):
    judged = results(spark, sf_dir)
    done = judged.where(F.col("error").isNull()).select("input_index", "judge_score", "k")
    failed = judged.where(F.col("error").isNotNull()).select("input_index", "judge_score", "error")
    return outcomes.combine_results(done, failed)


# Answer and verdict of a user turn, with every way in which they can be missing or broken.
ANSWER_ERROR = "CASE WHEN len % 13 = 0 THEN 'flow broke' END"
VERDICT_ERROR = "CASE WHEN len % 7 = 0 THEN 'judge broke' END"
VERDICT_TEXT = """CASE WHEN len % 5 = 0 THEN 'NOCONTENT' WHEN len % 11 = 0 THEN 'fine'
 WHEN len % 3 = 0 THEN '{"total_rating":' || (len % 10) || ',"correctness":"correct"}'
 ELSE '{"total_rating":' || (len % 10) || ',"reasoning":"r"}' END"""

ATTACH_SQL = f"""
WITH tasks AS (SELECT conv_id, turn, conv_id || '-' || turn AS task_id, text AS question
               FROM conversations WHERE role = 'user'),
answers AS (SELECT conv_id || '-' || (turn - 1) AS task_id, length(text) AS len,
                   CASE WHEN length(text) % 17 = 0 THEN '' ELSE text END AS answer
            FROM conversations WHERE role = 'assistant'),
a AS (SELECT *, {ANSWER_ERROR} AS answer_error, {VERDICT_ERROR} AS verdict_error,
             {VERDICT_TEXT} AS verdict FROM answers),
j AS (SELECT t.task_id, t.question, a.*  EXCLUDE (task_id), a.task_id IS NOT NULL AS answered,
             a.task_id IS NOT NULL AND a.len > 200 AS judged
      FROM tasks t LEFT JOIN a ON a.task_id = t.task_id),
s AS (SELECT *, CASE WHEN NOT answered THEN 'schedule_flow'
   WHEN answer_error IS NOT NULL THEN 'flow' WHEN answer = '' THEN 'no_content'
   WHEN NOT judged THEN 'schedule_judge' WHEN verdict_error IS NOT NULL THEN 'judge'
   WHEN verdict = 'NOCONTENT' THEN 'no_judge_content'
   WHEN NOT json_valid(verdict) THEN 'parse_judge' ELSE 'success' END AS stage FROM j)
SELECT task_id, question,
  CASE stage WHEN 'schedule_flow' THEN 'ERROR: not submitted' WHEN 'flow' THEN 'ERROR: flow broke'
     WHEN 'no_content' THEN 'ERROR: No content returned' ELSE answer END AS actual_answer,
  stage,
  CASE stage WHEN 'success' THEN json_extract_string(verdict, '$.total_rating') ELSE '0'
  END AS judge_score,
  CASE stage WHEN 'success' THEN coalesce(json_extract_string(verdict, '$.correctness'), 'Unknown')
     ELSE 'Error' END AS judge_correctness,
  CASE stage WHEN 'success' THEN coalesce(json_extract_string(verdict, '$.reasoning'),
                                          'No reasoning provided')
     WHEN 'schedule_flow' THEN 'Error scheduling flow: not submitted'
     WHEN 'flow' THEN 'Error during flow execution: flow broke'
     WHEN 'no_content' THEN 'No content returned from flow'
     WHEN 'schedule_judge' THEN 'Error scheduling judge: not submitted'
     WHEN 'judge' THEN 'Error during flow execution: judge broke'
     WHEN 'no_judge_content' THEN 'No content returned from judge'
     ELSE 'Error parsing judge result: not a JSON object' END AS judge_reasoning,
  CASE stage WHEN 'success' THEN NULL WHEN 'schedule_flow' THEN 'not submitted'
     WHEN 'flow' THEN 'flow broke' WHEN 'no_content' THEN 'No content'
     WHEN 'schedule_judge' THEN 'not submitted' WHEN 'judge' THEN 'judge broke'
     WHEN 'no_judge_content' THEN 'No judge content' ELSE 'not a JSON object' END AS error
FROM s"""


@query("attach_verdicts", ATTACH_SQL)
def attach_verdicts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    tasks = turns.where("role = 'user'").select(
        F.expr("conv_id || '-' || turn").alias("task_id"), F.col("text").alias("question"),
        F.lit(None).cast("string").alias("expected_answer"))
    said = turns.where("role = 'assistant'").select(
        F.expr("conv_id || '-' || (turn - 1)").alias("task_id"),
        F.char_length("text").alias("len"), "text")
    answers = said.select(
        "task_id", F.expr("CASE WHEN len % 17 = 0 THEN '' ELSE text END").alias("answer"),
        F.expr(ANSWER_ERROR).alias("answer_error"))
    verdicts = said.where("len > 200").select(
        "task_id", F.expr(VERDICT_TEXT).alias("verdict"),
        F.expr(VERDICT_ERROR).alias("verdict_error"))
    return outcomes.attach_verdicts(tasks, answers, verdicts).drop("expected_answer", "extras")


def _length_judge(expected: str, actual: str | None) -> str:
    if actual is None:
        raise ValueError("no answer to judge")
    if len(actual) % 13 == 0:
        return "not json"
    verdict = "correct" if len(actual) > len(expected) else "incorrect"
    return json.dumps({"total_rating": len(actual) % 11, "correctness": verdict})


def _pairs(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("expected_answer"))
    said = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual_answer"))
    return asked.join(said, ["conv_id", "turn"], "left")


PAIRS_SQL = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS expected_answer, a.text AS actual_answer
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


@query("apply_judge", f"""WITH {PAIRS_SQL},
p AS (SELECT *, length(actual_answer) AS len FROM pairs)
SELECT conv_id, turn,
  CASE WHEN len IS NULL OR len % 13 = 0 THEN '0' ELSE CAST(len % 11 AS VARCHAR) END AS judge_score,
  CASE WHEN len IS NULL OR len % 13 = 0 THEN 'Error' WHEN len > length(expected_answer)
       THEN 'correct' ELSE 'incorrect' END AS judge_correctness,
  CASE WHEN len IS NULL THEN 'Error during flow execution: no answer to judge'
       WHEN len % 13 = 0 THEN 'Error parsing judge result' ELSE 'No reasoning provided'
  END AS judge_reasoning,
  CASE WHEN len IS NULL THEN 'no answer to judge'
       WHEN len % 13 = 0 THEN 'Error parsing judge result' END AS error
FROM p""")
def apply_judge_query(spark, sf_dir):
    return apply_judge(_pairs(spark, sf_dir), _length_judge).select(
        "conv_id", "turn", "judge_score", "judge_correctness", "judge_reasoning", "error")


def _answer(text: str, variables: dict) -> str:
    if len(text) % 13 == 0:
        raise ValueError("flow broke")
    return "" if len(text) % 17 == 0 else f"{len(text)} characters"


def _verdict(expected: str | None, actual: str) -> str:
    if expected is None:
        raise ValueError("nothing expected")
    if len(expected) % 5 == 0:
        return "NOCONTENT"
    if len(expected) % 11 == 0:
        return "fine"
    return json.dumps({"total_rating": len(expected) % 10, "correctness": "correct", "a": actual})


@query("evaluate", f"""WITH {PAIRS_SQL},
p AS (SELECT *, length(expected_answer) AS q, length(actual_answer) AS e FROM pairs),
s AS (SELECT *, CASE WHEN q % 13 = 0 THEN 'flow' WHEN q % 17 = 0 THEN 'no_content'
   WHEN e IS NULL THEN 'judge' WHEN e % 5 = 0 THEN 'no_judge_content'
   WHEN e % 11 = 0 THEN 'parse_judge' ELSE 'success' END AS stage FROM p)
SELECT conv_id || '-' || turn AS task_id, expected_answer AS question, 'flow-1' AS flow_id,
  'judge-1' AS judge_flow_id,
  CASE stage WHEN 'flow' THEN 'ERROR: flow broke' WHEN 'no_content'
    THEN 'ERROR: No content returned' ELSE q || ' characters' END AS actual_answer, stage,
  CASE stage WHEN 'success' THEN CAST(e % 10 AS VARCHAR) ELSE '0' END AS judge_score,
  CASE stage WHEN 'success' THEN 'correct' ELSE 'Error' END AS judge_correctness,
  CASE stage WHEN 'success' THEN 'No reasoning provided'
    WHEN 'flow' THEN 'Error during flow execution: flow broke'
    WHEN 'no_content' THEN 'No content returned from flow'
    WHEN 'judge' THEN 'Error during flow execution: nothing expected'
    WHEN 'no_judge_content' THEN 'No content returned from judge'
    ELSE 'Error parsing judge result: not a JSON object' END AS judge_reasoning,
  CASE stage WHEN 'success' THEN q || ' characters' END AS extra_a,
  CASE stage WHEN 'flow' THEN 'flow broke' WHEN 'no_content' THEN 'No content'
    WHEN 'judge' THEN 'nothing expected' WHEN 'no_judge_content' THEN 'No judge content'
    WHEN 'parse_judge' THEN 'not a JSON object' END AS error
FROM s""")
def evaluate(spark, sf_dir):
    tasks = _pairs(spark, sf_dir).select(
        F.expr("conv_id || '-' || turn").alias("task_id"),
        F.col("expected_answer").alias("question"),
        F.col("actual_answer").alias("expected_answer"))
    judged = runs.evaluate(tasks, _answer, _verdict, "flow-1", "judge-1")
    return judged.withColumn("extra_a", F.col("extras")["a"]).drop("expected_answer", "extras")


ACTUAL_CASE = """CASE WHEN event_id % 3 = 0 THEN '  ' || upper(event_type) || ' '
 WHEN event_id % 3 = 1 THEN 'view' ELSE NULL END"""


@query("judge_exact", f"""
WITH e AS (SELECT event_id, event_type AS expected, {ACTUAL_CASE} AS actual FROM events),
j AS (SELECT event_id, coalesce({sql_strip('lower(expected)')} = {sql_strip('lower(actual)')},
                                false) AS same FROM e)
SELECT event_id, CASE WHEN same THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS judge_score,
       CASE WHEN same THEN 'correct' ELSE 'incorrect' END AS judge_correctness FROM j""")
def judge_exact(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("expected_answer"),
        F.expr(ACTUAL_CASE).alias("actual_answer"))
    return exact_judge(pairs).select("event_id", "judge_score", "judge_correctness")


@query("judge_overlap", f"""WITH {PAIRS_SQL},
w AS (SELECT conv_id, turn,
   list_distinct(regexp_extract_all(lower(expected_answer), '[\\p{{L}}\\p{{N}}]+')) AS e,
   coalesce(list_distinct(regexp_extract_all(lower(actual_answer), '[\\p{{L}}\\p{{N}}]+')), [])
   AS a FROM pairs),
s AS (SELECT conv_id, turn, len(list_intersect(e, a)) AS shared, len(e) + len(a) AS sizes FROM w),
j AS (SELECT conv_id, turn,
   CASE WHEN sizes > 0 THEN shared * 10.0 / (sizes - shared) ELSE 0.0 END AS score FROM s)
SELECT conv_id, turn, round(CAST(score AS DOUBLE), 6) AS judge_score,
       CASE WHEN score >= 0.5 THEN 'correct' ELSE 'incorrect' END AS judge_correctness FROM j""")
def judge_overlap(spark, sf_dir):
    judged = overlap_judge(_pairs(spark, sf_dir), threshold=0.5)
    return rounded(judged.select("conv_id", "turn", "judge_score", "judge_correctness"))


@query("throughput", f"""
SELECT {sql_stamp("date_trunc('hour', ts)")} AS window_start, count(*) AS items,
       round(count(*) / 3600.0, 6) AS per_second
FROM events GROUP BY 1""")
def throughput(spark, sf_dir):
    counted = stats.throughput(table(spark, sf_dir, "events"), "ts")
    return rounded(counted.withColumn("window_start", stamp("window_start")))


@query("format_executed", """
SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'N/A'
  WHEN o_orderstatus = 'P' THEN substr(o_orderpriority || ' on ' ||
       strftime(o_orderdate, '%Y-%m-%d'), 1, 19)
  WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M')
  ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS executed FROM orders""")
def format_executed_query(spark, sf_dir):
    text = F.expr("""CASE WHEN o_totalprice < 20000 THEN NULL
      WHEN o_orderstatus = 'P' THEN o_orderpriority || ' on ' ||
           date_format(o_orderdate, 'yyyy-MM-dd')
      WHEN o_orderstatus = 'O' THEN date_format(o_orderdate, 'yyyy-MM-dd')
      ELSE date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") || 'Z' END""")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", format_executed(text).alias("executed"))


OUTCOME_RESULT = """CASE event_type WHEN 'signup' THEN '' WHEN 'view' THEN 'NOCONTENT'
 WHEN 'error' THEN NULL ELSE props END"""
OUTCOME_ERROR = "CASE event_type WHEN 'error' THEN 'raised for ' || user_id END"

OUTCOME_SQL = f"""outcomes AS (
  SELECT event_id, event_type, r, e,
    CASE WHEN e IS NOT NULL THEN 'error' WHEN r IS NULL OR r IN ('', 'NOCONTENT') THEN 'failed'
         ELSE 'success' END AS status
  FROM (SELECT *, {OUTCOME_RESULT} AS r, {OUTCOME_ERROR} AS e FROM events))"""


def outcome_rows(spark, sf_dir) -> DataFrame:
    """Outcomes of all three kinds made from the events."""
    raw = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "ts", F.expr(OUTCOME_RESULT).alias("result"),
        F.expr(OUTCOME_ERROR).alias("error"))
    return outcomes.classify_outcome(raw)


@query("classify_outcome", f"""WITH {OUTCOME_SQL}
SELECT event_id, status, CASE WHEN status = 'success' THEN r END AS result,
  CASE status WHEN 'failed' THEN 'No content returned' WHEN 'error' THEN e END AS error
FROM outcomes""")
def classify_outcome(spark, sf_dir):
    return outcome_rows(spark, sf_dir).select("event_id", "status", "result", "error")


@query("extract_output", f"""
SELECT conv_id, turn, CASE WHEN role = 'user' AND turn = 0 THEN 'NOCONTENT'
  WHEN role = 'user' THEN {sql_strip('text')} WHEN role = 'system' THEN 'system'
  ELSE {sql_strip('text')} || chr(10) || role END AS output FROM conversations""")
def extract_output_query(spark, sf_dir):
    first = F.expr("""CASE WHEN role = 'user' AND turn = 0 THEN '```\n```'
      WHEN role = 'system' THEN '' ELSE '```text\n' || text || '\n``` ' END""")
    second = F.expr("CASE WHEN role = 'user' THEN '  ' ELSE role END")

    def part(text):
        return F.struct(F.struct(F.struct(text.alias("result")).alias("message")).alias("results"))

    payload = F.to_json(F.struct(F.array(
        F.struct(F.array(part(first), part(second)).alias("outputs"))).alias("outputs")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", extract_output(payload).alias("output"))


@query("match_within", f"""
WITH m AS (SELECT o_orderkey, min(l_shipdate) AS done FROM orders JOIN lineitem
  ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY
  GROUP BY o_orderkey)
SELECT o_orderkey AS task_id, {sql_stamp('done')} AS completed_at,
       CASE WHEN done IS NULL THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN done IS NULL THEN 'Timeout waiting for completion' END AS error
FROM orders LEFT JOIN m USING (o_orderkey)""")
def match_within(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("submitted_at"))
    arrived = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("arrived_at"))
    matched = outcomes.match_within(tasks, arrived, F.expr("INTERVAL 90 DAYS"))
    return matched.select("task_id", stamp("completed_at").alias("completed_at"), "status", "error")


SESSION_SQL = """
WITH final AS (SELECT user_id, min((ts, event_id)) AS m FROM events
               WHERE event_type = 'purchase' GROUP BY user_id),
c AS (SELECT e.user_id, any_value(m) AS m,
        count(*) FILTER (event_type = 'view' AND (m IS NULL OR (ts, event_id) < m)) AS n
      FROM events e LEFT JOIN final USING (user_id) GROUP BY e.user_id)
"""

SESSION_KIND = "CASE event_type WHEN 'purchase' THEN 'message' WHEN 'view' THEN 'artefact' " \
               "ELSE event_type END"


def session_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts",
        F.expr(SESSION_KIND).alias("kind"), F.col("props").alias("text"))


@query("session_response", SESSION_SQL + """
SELECT user_id AS session_id, m[2] AS response_event, n AS n_artefacts,
       CASE WHEN m IS NULL THEN 'timeout' ELSE 'success' END AS status FROM c""")
def session_response(spark, sf_dir):
    polled = session_events(spark, sf_dir)
    return sessions.session_response(polled.unionAll(polled))


WAIT_HOURS = 48

# Sessions that end: a purchase counts up to a deadline after the user's first event.
TIMED_SQL = f"""
WITH spans AS (SELECT user_id, min(ts) + INTERVAL {WAIT_HOURS} HOUR AS deadline
               FROM events GROUP BY user_id),
timely AS (SELECT e.* FROM events e JOIN spans USING (user_id) WHERE ts <= deadline),
answers AS (SELECT user_id, event_id AS answer, ts AS answered, props AS response FROM timely
            WHERE event_type = 'purchase'
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
views AS (SELECT t.user_id, t.event_id, t.ts, t.props FROM timely t LEFT JOIN answers a
          USING (user_id) WHERE event_type = 'view'
          AND (answer IS NULL OR ts < answered OR (ts = answered AND event_id < answer)))"""

TIMED_RESPONSE_SQL = TIMED_SQL + """
SELECT s.user_id AS session_id, answer AS response_event, response,
       (SELECT count(*) FROM views v WHERE v.user_id = s.user_id) AS n_artefacts,
       CASE WHEN answer IS NULL THEN 'timeout' ELSE 'success' END AS status
FROM spans s LEFT JOIN answers USING (user_id)"""


@query("session_timeout", TIMED_RESPONSE_SQL)
def session_timeout(spark, sf_dir):
    polled = session_events(spark, sf_dir)
    return sessions.session_response(
        polled.unionAll(polled), F.expr(f"INTERVAL {WAIT_HOURS} HOURS"), "text")


@query("session_artefacts", TIMED_SQL + f"""
SELECT user_id AS session_id, event_id, {sql_stamp('ts')} AS ts, props AS artefact FROM views""")
def session_artefacts(spark, sf_dir):
    polled = session_events(spark, sf_dir)
    found = sessions.session_artefacts(
        polled.unionAll(polled), F.expr(f"INTERVAL {WAIT_HOURS} HOURS"), "text")
    return found.withColumn("ts", stamp("ts"))
