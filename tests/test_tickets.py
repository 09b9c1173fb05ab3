import pytest
from pyspark.sql import functions as F

from tallyloom.operators import tickets as tk

TICKET = ("ticket_id long, code string, subject string, status string, department_id string, "
          "department_name string, date_created string, customer_email string, "
          "customer_name string, channel string, tags array<string>")
GROUP = ("ticket_id long, position long, datecreated string, userid string, "
         "user_full_name string, type string, messages array<struct<type: string, message: string>>")


@pytest.fixture(scope="module")
def data(spark):
    tickets = spark.createDataFrame([
        (1, "ABC", "Help", "R", "d", "Sales", "2024-01-02", "c@x.org", "Cy", "M", ["a", "b"]),
        (2, None, None, "L", None, None, None, None, None, "M", []),
    ], TICKET)
    groups = spark.createDataFrame([
        (1, 0, "t0", "u1", "", "M", [("H", " From: cy@x.org "), ("H", "Subject: Help"),
                                     ("M", "first"), ("M", "<p>Hi&nbsp;there &amp;lt;</p>")]),
        (1, 1, "t1", "system00", "", "M", [("N", "internal")]),
        (1, 2, "t2", "u9", "Ann", "M", [("H", "Subject: Re: Help"), ("M", "<br>")]),
        (1, 3, "t3", "x", "", "I", [("M", "noted")]),
        (1, 4, None, "u7", "", "M", [("T", "track")]),
        (1, 5, "t5", "u7", "", "M", []),
    ], GROUP)
    return tickets, groups


FIRST = """=== TICKET #ABC ===
Subject: Help
Status: R
Department: Sales
Created: 2024-01-02
Customer: c@x.org (Cy)
Tags: a, b

=== CONVERSATION ===

--- t0 ---
From: Customer (cy@x.org)
Message:
Hi there &lt;

--- t2 ---
From: Agent (Ann)
Subject: Re: Help
Message: [Empty message]

--- t3 ---
From: System/Agent
Message:
noted

--- N/A ---
From: User (u7)
Message: [No content]"""

SECOND = """=== TICKET #N/A ===
Subject: No subject
Status: L
Department: N/A
Created: N/A
Customer: N/A (N/A)

=== CONVERSATION ==="""


def test_thread_text(data):
    got = {r.ticket_id: r.thread_text for r in tk.ticket_threads(*data, tags="tags").collect()}
    assert got == {1: FIRST, 2: SECOND}


def test_index_rows(data):
    def answer(text, variables):
        if "TICKET #N/A" in text:
            raise ValueError("unknown ticket")
        return variables["ticket_id"]

    rows = tk.index_tickets(*data, answer, tags="tags")
    assert rows.columns == tk.CHECKPOINT_COLUMNS
    got = {r.ticket_id: r for r in rows.collect()}
    assert got["1"].flow_input_length == len(FIRST)
    assert (got["2"].flow_input_length, got["2"].flow_process_id) == (0, "ERROR: unknown ticket")


def test_scan_skips_before_the_limit(spark):
    rows = [(i, "R" if i % 2 else "N", "M", "d", f"2024-01-{1 + i // 4:02d}") for i in range(20)]
    tickets = spark.createDataFrame(
        rows, "ticket_id long, status string, channel string, department_id string, "
              "date_created string")
    skip = spark.createDataFrame([("19",), ("15",)], "ticket_id string")
    got = [r.ticket_id for r in tk.scan_tickets(tickets, "d", 3, skip).collect()]
    assert got == [17, 13, 11]
    assert tk.scan_tickets(tickets, "other").count() == 0
    assert tk.scan_tickets(tickets).count() == 10


def test_failed_tickets_can_be_retried(spark):
    from tallyloom.operators.outcomes import resume

    df = spark.createDataFrame([(1,), (2,), (3,)], "ticket_id long")
    done = spark.createDataFrame(
        [("1", "p"), ("2", "ERROR: x")], "ticket_id string, flow_process_id string")
    assert [r[0] for r in resume(df, done, "ticket_id").collect()] == [3]
    again = resume(df, done, "ticket_id", retry_failed=True)
    assert sorted(r[0] for r in again.collect()) == [2, 3]


@pytest.mark.parametrize("n", [1, 1001, 5000])
def test_a_long_ticket_is_one_text_and_one_call(spark, n):
    tickets = spark.createDataFrame(
        [(7, "H", "s", "R", None, None, None, None, None, "M", [])], TICKET)
    groups = spark.range(n).select(
        F.lit(7).cast("long").alias("ticket_id"), F.col("id").alias("position"),
        F.lit("t").alias("datecreated"), F.lit("u").alias("userid"),
        F.lit("A").alias("user_full_name"), F.lit("M").alias("type"),
        F.array(F.struct(F.lit("M").alias("type"), F.col("id").cast("string").alias("message")))
        .alias("messages"))
    row = tk.ticket_threads(tickets, groups).collect()
    assert len(row) == 1
    said = [int(x.split()[0]) for x in row[0].thread_text.split("Message:\n")[1:]]
    assert said == list(range(n))
    calls = spark.sparkContext.accumulator(0)

    def count(text, variables):
        calls.add(1)
        return variables["ticket_code"]

    assert tk.index_tickets(tickets, groups, count).first().flow_process_id
    assert calls.value == 1
