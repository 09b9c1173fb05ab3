"""Support tickets: selection, thread text, and the job that indexes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.binding import let
from tallyloom.functions.text import plain_message, strip
from tallyloom.operators.apply import RowFunction, apply_flow
from tallyloom.operators.indexing import process_id
from tallyloom.operators.outcomes import resume

# Ticket states and channel that are fetched.
OPEN_TO_INDEX = ("R", "L")
CHANNEL = "M"

# How many groups are joined at a time; the text does not depend on it.
FOLD = 1000

# The columns of a checkpoint file.
CHECKPOINT_COLUMNS = [
    "ticket_id", "ticket_code", "ticket_subject", "department_id", "department_name",
    "created_at", "status", "customer_email", "flow_input_length", "flow_process_id",
    "indexed_at",
]


def scan_tickets(
    tickets: DataFrame,
    department: str | None = None,
    limit: int | None = None,
    skip: DataFrame | None = None,
    skip_key: str = "ticket_id",
) -> DataFrame:
    """Newest tickets first; ids to skip are removed before the limit counts."""
    chosen = tickets.where(F.col("status").isin(*OPEN_TO_INDEX) & (F.col("channel") == CHANNEL))
    if department is not None:
        chosen = chosen.where(F.col("department_id") == department)
    if skip is not None:
        chosen = resume(chosen, skip, "ticket_id", skip_key)
    ordered = chosen.orderBy(F.desc("date_created"), F.desc("ticket_id"))
    return ordered if limit is None else ordered.limit(limit)


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def ticket_header(tags: str | None = None) -> Column:
    """Opening lines of a ticket text."""
    lines = [
        F.concat(F.lit("=== TICKET #"), _or(F.col("code"), "N/A"), F.lit(" ===")),
        F.concat(F.lit("Subject: "), _or(F.col("subject"), "No subject")),
        F.concat(F.lit("Status: "), _or(F.col("status"), "Unknown")),
        F.concat(F.lit("Department: "), _or(F.col("department_name"), "N/A")),
        F.concat(F.lit("Created: "), _or(F.col("date_created").cast("string"), "N/A")),
        F.concat(F.lit("Customer: "), _or(F.col("customer_email"), "N/A"),
                 F.lit(" ("), _or(F.col("customer_name"), "N/A"), F.lit(")")),
    ]
    if tags:
        lines.append(F.when(
            F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))))
    lines.append(F.lit("\n=== CONVERSATION ==="))
    return F.concat_ws("\n", *lines)


def _last(messages: Column, kind: str, label: str | None = None) -> Column:
    """The last message of a type, for headers the last one with the label, without it."""
    texts = F.transform(
        F.filter(messages, lambda m: m["type"] == kind), lambda m: strip(_or(m["message"], "")))
    if label:
        texts = F.transform(
            F.filter(texts, lambda t: t.startswith(label)),
            lambda t: strip(F.replace(t, F.lit(label), F.lit(""))))
    return F.try_element_at(texts, F.lit(-1))


def render_groups(groups: DataFrame) -> DataFrame:
    """Text block of every message group that has something to show.

    ``groups(ticket_id, position, datecreated, userid, user_full_name, type, messages,
    ticket_subject)``; the block is built from the row alone.
    """
    said = let(F.col("messages"), lambda m: F.struct(
        _last(m, "M").alias("body"), _last(m, "H", "Subject:").alias("subject"),
        _last(m, "H", "From:").alias("sender")))
    parsed = groups.where(F.size("messages") > 0).withColumn("__said", said)\
        .withColumn("__body", F.col("__said.body"))\
        .withColumn("__subject", F.col("__said.subject"))\
        .withColumn("__from", F.col("__said.sender"))
    system = _or(F.col("userid"), "").eqNullSafe("system00") | _or(F.col("type"), "")\
        .eqNullSafe("I")
    no_body = _or(F.col("__body"), "") == ""
    full_name = _or(F.col("user_full_name"), "")
    from_header = _or(F.col("__from"), "")
    sender = (
        F.when(system, F.lit("System/Agent"))
        .when(full_name != "", F.concat(F.lit("Agent ("), full_name, F.lit(")")))
        .when(from_header != "", F.concat(F.lit("Customer ("), from_header, F.lit(")")))
        .otherwise(F.concat(F.lit("User ("), _or(F.col("userid"), ""), F.lit(")")))
    )
    subject = _or(F.col("__subject"), "")
    changed = (subject != "") & ~subject.eqNullSafe(F.col("ticket_subject"))
    shown = let(plain_message(F.col("__body")), lambda plain: F.when(
        plain == "", F.lit("Message: [Empty message]")
    ).otherwise(F.concat(F.lit("Message:\n"), plain)))
    message = F.when(no_body, F.lit("Message: [No content]")).otherwise(shown)
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("\n--- "), _or(F.col("datecreated").cast("string"), "N/A"), F.lit(" ---")),
        F.concat(F.lit("From: "), sender),
        F.when(changed, F.concat(F.lit("Subject: "), subject)),
        message,
    )
    return parsed.where(~(system & no_body)).select(
        "ticket_id", "position", block.alias("block"))


def ticket_threads(tickets: DataFrame, groups: DataFrame, tags: str | None = None) -> DataFrame:
    """Text of each ticket as ``(ticket_id, thread_text)``.

    ``position`` counts the groups of a ticket from 0. Blocks are rendered and joined a few at
    a time wherever they lie; only those joined texts of a ticket meet, to become its cell,
    which is as long as the one ticket. Grouping by a wrapped id leaves adaptive execution
    free to split a hot ticket in the join before it. Tickets without groups keep their header.
    """
    subjects = tickets.select("ticket_id", F.col("subject").alias("ticket_subject"))
    blocks = render_groups(groups.join(subjects, "ticket_id")).select(
        F.struct("ticket_id").alias("id"),
        F.floor(F.col("position") / FOLD).cast("bigint").alias("part"),
        F.col("position").cast("bigint").alias("position"), "block",
    )
    headers = tickets.select(
        F.struct("ticket_id").alias("id"), F.lit(-1).cast("bigint").alias("part"),
        F.lit(-1).cast("bigint").alias("position"), ticket_header(tags).alias("block"),
    )

    def joined(order: str, text: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.array_join(F.transform(ordered, lambda b: b[text]), "\n")

    parts = blocks.groupBy("id", "part").agg(joined("position", "block").alias("block"))
    return headers.drop("position").unionByName(parts).groupBy("id").agg(
        joined("part", "block").alias("thread_text")).select("id.ticket_id", "thread_text")


def index_tickets(
    tickets: DataFrame, groups: DataFrame, fn: RowFunction, tags: str | None = None,
    indexed_at: Column | None = None,
) -> DataFrame:
    """Checkpoint rows for the tickets after ``fn`` has run once over each one's text.

    ``indexed_at`` is the moment written to the rows, by default that of the run.
    """
    threads = ticket_threads(tickets, groups, tags)
    told = tickets.select(
        F.col("ticket_id").alias("__id"), F.create_map(
            F.lit("ticket_id"), F.col("ticket_id").cast("string"),
            F.lit("ticket_code"), F.col("code"),
            F.lit("department_id"), F.col("department_id"),
            F.lit("source"), F.lit("ticket")).alias("variables"))
    asked = threads.join(told, F.col("ticket_id") == F.col("__id")).drop("__id")
    outcomes = apply_flow(asked, fn, input_col="thread_text").select(
        "ticket_id", F.char_length("thread_text").alias("length"),
        F.when(F.col("status") != "success", F.col("error")).alias("error"))
    ok = F.col("error").isNull()
    moment = F.current_timestamp() if indexed_at is None else indexed_at
    return tickets.join(outcomes, "ticket_id").select(
        F.col("ticket_id").cast("string").alias("ticket_id"),
        F.col("code").alias("ticket_code"),
        F.col("subject").alias("ticket_subject"),
        "department_id", "department_name",
        F.col("date_created").cast("string").alias("created_at"),
        "status", "customer_email",
        F.when(ok, F.col("length")).otherwise(0).cast("bigint").alias("flow_input_length"),
        F.when(ok, process_id("ticket_id"))
        .otherwise(F.concat(F.lit("ERROR: "), F.col("error"))).alias("flow_process_id"),
        moment.cast("string").alias("indexed_at"),
    )
