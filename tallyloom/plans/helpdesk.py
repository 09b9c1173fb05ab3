"""Queries over support tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import runs
from tallyloom.operators import tickets as tk
from tallyloom.plans.common import query, sql_stamp, sql_strip, stamp, table
from tallyloom.session import scratch_path
from tallyloom.sources.tables import read_checkpoint

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'P' THEN 'L' ELSE 'N' END"
CHANNEL = "CASE WHEN o_orderpriority = '5-LOW' THEN 'C' ELSE 'M' END"


@query("ticket_scan", f"""
SELECT o_orderkey AS ticket_id, {sql_stamp('o_orderdate')} AS date_created, {STATUS} AS status,
       c_mktsegment AS department_id
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE {STATUS} IN ('R', 'L') AND {CHANNEL} = 'M' AND c_mktsegment = 'BUILDING'
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""")
def ticket_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"))
    tickets = orders.select(
        F.col("o_orderkey").alias("ticket_id"), F.col("o_orderdate").alias("date_created"),
        F.expr(STATUS).alias("status"), F.expr(CHANNEL).alias("channel"),
        F.col("c_mktsegment").alias("department_id"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    found = tk.scan_tickets(tickets, "BUILDING", 100, done, "l_orderkey")
    return found.drop("channel").withColumn("date_created", stamp("date_created"))


def conversations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tickets, one per conversation, and their message groups, one per turn."""
    turns = table(spark, sf_dir, "conversations")
    tickets = turns.groupBy(F.col("conv_id").alias("ticket_id")).agg(
        F.count_if(F.col("role") == "user").alias("asked"))
    tickets = tickets.select(
        "ticket_id", F.expr("'C-' || ticket_id").alias("code"),
        F.expr("'Conversation ' || ticket_id").alias("subject"), F.lit("R").alias("status"),
        F.lit("D1").alias("department_id"),
        F.expr("CASE WHEN asked > 2 THEN 'Support' END").alias("department_name"),
        F.lit(None).cast("string").alias("date_created"),
        F.expr("ticket_id || '@example.com'").alias("customer_email"),
        F.lit(None).cast("string").alias("customer_name"))
    message = "named_struct('type', {}, 'message', {})"
    groups = turns.select(
        F.col("conv_id").alias("ticket_id"), F.col("turn").cast("bigint").alias("position"),
        F.expr("'turn ' || turn").alias("datecreated"),
        F.expr("CASE role WHEN 'system' THEN 'system00' ELSE role END").alias("userid"),
        F.expr("CASE role WHEN 'assistant' THEN 'Helper ' || turn ELSE '' END")
        .alias("user_full_name"),
        F.lit("M").alias("type"),
        F.expr("array(" + ", ".join([
            message.format("'H'", "'From: user' || conv_id"),
            message.format("'N'", "'a note'"),
            message.format("'H'", "CASE WHEN turn > 2 THEN 'Subject: Re: ' || conv_id "
                                  "ELSE 'Subject: Conversation ' || conv_id END"),
            message.format("'M'", "CASE WHEN role = 'user' AND turn = 4 THEN '<br>' "
                                  "WHEN role = 'assistant' AND turn = 5 THEN '' "
                                  "ELSE '<p>' || text || ' &amp;lt;</p>' END"),
        ]) + ")").alias("messages"))
    return tickets, groups


THREAD_SQL = f"""
t AS (SELECT conv_id, '=== TICKET #C-' || conv_id || ' ===' || chr(10) || 'Subject: Conversation '
        || conv_id || chr(10) || 'Status: R' || chr(10) || 'Department: ' ||
        CASE WHEN count(*) FILTER (role = 'user') > 2 THEN 'Support' ELSE 'N/A' END || chr(10) ||
        'Created: N/A' || chr(10) || 'Customer: ' || conv_id || '@example.com (N/A)' || chr(10) ||
        chr(10) || '=== CONVERSATION ===' AS header,
        CASE WHEN count(*) FILTER (role = 'user') > 2 THEN 'Support' END AS department_name
      FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, turn, chr(10) || '--- turn ' || turn || ' ---' || chr(10) || 'From: ' ||
        CASE role WHEN 'system' THEN 'System/Agent' WHEN 'assistant'
          THEN 'Agent (Helper ' || turn || ')' ELSE 'Customer (user' || conv_id || ')' END ||
        CASE WHEN turn > 2 THEN chr(10) || 'Subject: Re: ' || conv_id ELSE '' END || chr(10) ||
        CASE WHEN role = 'user' AND turn = 4 THEN 'Message: [Empty message]'
             WHEN role = 'assistant' AND turn = 5 THEN 'Message: [No content]'
             ELSE 'Message:' || chr(10) || {sql_strip('''replace(replace(replace(
                regexp_replace(text, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;',
                '>') || ' &lt;' ''')} END AS block
      FROM conversations),
blocks AS (SELECT conv_id, -1 AS pos, header AS block FROM t
           UNION ALL SELECT conv_id, turn, block FROM b)"""


@query("ticket_thread", "WITH " + THREAD_SQL + """
SELECT conv_id AS ticket_id,
       string_agg(block, chr(10) ORDER BY pos) AS thread_text FROM blocks GROUP BY conv_id""")
def ticket_thread(spark, sf_dir):
    tickets, groups = conversations(spark, sf_dir)
    return tk.ticket_threads(tickets, groups)


def count_words(text: str, variables: dict) -> str:
    """A row function over ticket texts that turns short ones down."""
    if len(text) < 1000:
        raise ValueError("too little to index")
    return str(len(text.split()))


TICKET_INDEX_SQL = "WITH " + THREAD_SQL + """,
x AS (SELECT conv_id, length(string_agg(block, chr(10) ORDER BY pos)) AS len
      FROM blocks GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS ticket_id, 'C-' || conv_id AS ticket_code,
  'Conversation ' || conv_id AS ticket_subject, 'D1' AS department_id, department_name,
  CAST(NULL AS VARCHAR) AS created_at, 'R' AS status, conv_id || '@example.com' AS customer_email,
  CASE WHEN len < 1000 THEN 0 ELSE len END AS flow_input_length,
  CASE WHEN len < 1000 THEN 'ERROR: too little to index' ELSE md5(CAST(conv_id AS VARCHAR))
  END AS flow_process_id, '2024-06-01 00:00:00' AS indexed_at
FROM t JOIN x USING (conv_id)"""


@query("ticket_index", TICKET_INDEX_SQL)
def ticket_index(spark, sf_dir):
    tickets, groups = conversations(spark, sf_dir)
    return tk.index_tickets(
        tickets, groups, count_words, indexed_at=F.lit("2024-06-01 00:00:00"))


@query("ticket_runs", TICKET_INDEX_SQL.replace(
    "'2024-06-01 00:00:00'",
    "CASE WHEN department_name IS NULL THEN '2024-06-02 00:00:00' ELSE '2024-06-01 00:00:00' END"))
def ticket_runs(spark, sf_dir):
    """The checkpoint after a run over some of the tickets and another over all of them."""
    tickets, groups = conversations(spark, sf_dir)
    tickets = tickets.withColumn("channel", F.lit("M"))
    checkpoint = scratch_path(spark, "ticket-checkpoint")
    for day, found in (("01", tickets.where("department_name IS NOT NULL")), ("02", tickets)):
        runs.index_new_tickets(found, groups, count_words, checkpoint,
                               indexed_at=F.lit(f"2024-06-{day} 00:00:00"), run=day)
    return read_checkpoint(spark, checkpoint, runs.CHECKPOINT_SCHEMA)
