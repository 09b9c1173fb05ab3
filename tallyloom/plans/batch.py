"""Queries over batch inputs, their sources and sinks."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import inputs, outcomes, runs, stats
from tallyloom.operators.apply import apply_flow
from tallyloom.operators.ordered import with_positions
from tallyloom.plans.common import query, rounded, sql_strip, table
from tallyloom.plans.evaluation import OUTCOME_SQL, VERDICTS_SQL, outcome_rows, results
from tallyloom.session import durable, scratch_path
from tallyloom.sinks import tables as sinks
from tallyloom.sources import tables as sources

PADDED = "CASE WHEN lang = 'de' THEN '  ' ELSE '  ' || text || ' ' END"
FILE_NAME = "CASE WHEN lang = 'es' THEN NULL ELSE source || '/' || doc_id || '.txt' END"
PADDED_SQL = PADDED.replace("text || ' '", "text || chr(9)")


def documents(spark, sf_dir) -> DataFrame:
    """Documents as batch tasks: padded input, file name, variables."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "text",
        F.expr(PADDED.replace("text || ' '", "text || '\t'")).alias("flow_input"),
        F.expr(FILE_NAME).alias("filename"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
        .alias("flow_variable"),
    )


@query("clean_inputs", f"""
SELECT doc_id, flow_input FROM (SELECT doc_id, {sql_strip(PADDED_SQL)} AS flow_input FROM documents)
WHERE flow_input <> ''""")
def clean_inputs(spark, sf_dir):
    return inputs.clean_inputs(documents(spark, sf_dir)).select("doc_id", "flow_input")


@query("build_variables", f"""
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'own.txt' ELSE {FILE_NAME} END AS filename,
       lang, source FROM documents""")
def build_variables(spark, sf_dir):
    own = F.when(F.col("lang") == "fr", F.map_concat(
        "flow_variable", F.create_map(F.lit("filename"), F.lit("own.txt")))
    ).otherwise(F.col("flow_variable"))
    built = inputs.build_variables(documents(spark, sf_dir).withColumn("flow_variable", own))
    return built.select("doc_id", *[
        F.col("variables")[k].alias(k) for k in ("filename", "lang", "source")])


@query("split_record", """
SELECT p_name AS flow_input, CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand,
       CAST(p_size AS VARCHAR) AS p_size, 3 AS n_variables FROM part""")
def split_record(spark, sf_dir):
    records = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("flow_input"), "p_partkey", "p_brand", "p_size")
    split = inputs.split_record(records)
    return split.select(
        "flow_input",
        *[F.col("flow_variable")[k].alias(k) for k in ("p_partkey", "p_brand", "p_size")],
        F.size("flow_variable").alias("n_variables"))


@query("json_roundtrip", """
SELECT doc_id, CAST(to_json({'lang': lang, 'source': source}) AS VARCHAR) AS encoded, lang, source
FROM documents""")
def json_roundtrip(spark, sf_dir):
    coded = documents(spark, sf_dir).select(
        "doc_id", inputs.encode_variables(F.col("flow_variable")).alias("encoded"))
    back = coded.withColumn("back", inputs.decode_variables(F.col("encoded")))
    return back.select("doc_id", "encoded", F.col("back")["lang"].alias("lang"),
                       F.col("back")["source"].alias("source"))


@query("widen_map", f"""WITH {VERDICTS_SQL}
SELECT input_index, CASE WHEN flow_id = 'flow-0' THEN k END AS "x_flow-0",
  CASE WHEN flow_id = 'flow-1' THEN k END AS "x_flow-1",
  CASE WHEN flow_id = 'flow-2' THEN k END AS "x_flow-2",
  CASE WHEN flow_id = 'flow-3' THEN k END AS "x_flow-3" FROM results""")
def widen_map(spark, sf_dir):
    extras = results(spark, sf_dir).select(
        "input_index", F.create_map(F.col("flow_id"), F.col("k")).alias("extras"))
    return inputs.widen_map(extras, "extras", "x_")


FLAT_RESULT = "CASE lang WHEN 'de' THEN NULL WHEN 'es' THEN '' ELSE source || ':' || text END"
FLAT_ERROR = "CASE WHEN lang = 'de' THEN 'bad language' END"
FLAT_STATUS = "CASE lang WHEN 'de' THEN 'error' WHEN 'es' THEN 'failed' ELSE 'success' END"


@query("flatten_results", f"""
SELECT doc_id AS input_index, text AS flow_input, {FLAT_STATUS} AS status,
  CAST(to_json({{'lang': lang, 'source': source}}) AS VARCHAR) AS flow_variable,
  CASE WHEN lang NOT IN ('de', 'es') THEN source || ':' || text END AS result,
  CASE lang WHEN 'de' THEN 'bad language' WHEN 'es' THEN 'No content returned' END AS error,
  lang AS var_lang, source AS var_source FROM documents""")
def flatten_results(spark, sf_dir):
    raw = documents(spark, sf_dir).select(
        F.col("doc_id").alias("input_index"), F.col("text").alias("flow_input"),
        "flow_variable", F.expr(FLAT_RESULT).alias("result"), F.expr(FLAT_ERROR).alias("error"))
    return inputs.flatten_results(outcomes.classify_outcome(raw))


def _with_existing(spark, sf_dir) -> DataFrame:
    tasks = documents(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").join(
        tasks.select("doc_id", "filename"), "doc_id")
    return outcomes.skip_existing(tasks, labelled.select("filename"))


@query("skip_existing", f"""
SELECT d.doc_id, {FILE_NAME.replace('doc_id', 'd.doc_id')} AS filename,
  CASE WHEN d.lang <> 'es' AND l.doc_id IS NOT NULL THEN 'skipped' ELSE 'pending' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def skip_existing(spark, sf_dir):
    return _with_existing(spark, sf_dir).select("doc_id", "filename", "status")


@query("batch_stats", f"""
WITH s AS (SELECT CASE WHEN d.lang <> 'es' AND l.doc_id IS NOT NULL THEN 'skipped'
                  ELSE {FLAT_STATUS} END AS status
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),
c AS (SELECT count(*) FILTER (status = 'success') AS completed,
             count(*) FILTER (status IN ('failed', 'error')) AS failed,
             count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total FROM s)
SELECT *, round(100.0 * completed / (completed + failed), 6) AS success_pct,
       round(100.0 * skipped / total, 6) AS skipped_pct FROM c""")
def batch_stats(spark, sf_dir):
    tasks = _with_existing(spark, sf_dir)
    status = F.when(F.col("status") == "skipped", "skipped").otherwise(F.expr(FLAT_STATUS))
    return rounded(stats.batch_stats(tasks.select(status.alias("status"))))


@query("resume_anti", """
SELECT o_orderkey, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return outcomes.resume(orders, done, "o_orderkey", "l_orderkey")


@query("input_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS input_index
FROM orders""")
def input_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return inputs.with_input_index(orders, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("index_total", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)
  AS item_index, count(*) OVER (PARTITION BY event_type) AS total FROM events""")
def index_total(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return with_positions(events, ["ts", "event_id"], ["event_type"], index="item_index",
                          total="total", start=1).drop("ts")


def checked_digest(text: str, variables: dict) -> str:
    """A row function that fails, returns nothing or answers, by language."""
    if variables["lang"] == "de":
        raise ValueError(f"unsupported language of {variables['source']}")
    if variables["lang"] == "es":
        return ""
    return f"{variables['lang']}:{hashlib.md5(text.encode()).hexdigest()}"


APPLIED_SQL = """
SELECT doc_id, CASE lang WHEN 'de' THEN 'error' WHEN 'es' THEN 'failed' ELSE 'success'
  END AS status,
  CASE WHEN lang NOT IN ('de', 'es') THEN lang || ':' || md5(text) END AS result,
  CASE lang WHEN 'de' THEN 'unsupported language of ' || source
            WHEN 'es' THEN 'No content returned' END AS error FROM documents"""


@query("apply_flow", APPLIED_SQL)
def apply_flow_query(spark, sf_dir):
    applied = apply_flow(documents(spark, sf_dir), checked_digest, input_col="text",
                         vars_col="flow_variable")
    return applied.select("doc_id", "status", "result", "error")


@query("run_batch", f"""
WITH a AS ({APPLIED_SQL})
SELECT d.doc_id, {FILE_NAME.replace('doc_id', 'd.doc_id')} AS filename,
  CASE WHEN d.lang <> 'es' AND l.doc_id IS NOT NULL THEN 'skipped' ELSE status END AS status,
  CASE WHEN d.lang = 'es' OR l.doc_id IS NULL THEN result END AS result,
  CASE WHEN d.lang = 'es' OR l.doc_id IS NULL THEN error END AS error
FROM documents d JOIN a ON a.doc_id = d.doc_id
LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def run_batch(spark, sf_dir):
    tasks = documents(spark, sf_dir).withColumn("flow_input", F.col("text"))
    labelled = table(spark, sf_dir, "labels").join(
        tasks.select("doc_id", "filename"), "doc_id")
    ran = runs.run_batch(tasks, checked_digest, labelled.select("filename"))
    return ran.select("doc_id", "filename", "status", "result", "error")


HANGS, DEADLINE = 7, 3


def hanging_digest(text: str, variables: dict) -> str:
    """A row function that does not return in time for some lengths of text."""
    if len(text) % 211 == HANGS:
        time.sleep(10 * DEADLINE)
    return hashlib.md5(text.encode()).hexdigest()


@query("apply_deadline", f"""
SELECT doc_id, CASE WHEN len(text) % 211 = {HANGS} THEN 'error' ELSE 'success' END AS status,
  CASE WHEN len(text) % 211 <> {HANGS} THEN md5(text) END AS result,
  CASE WHEN len(text) % 211 = {HANGS} THEN 'Flow execution timed out after {DEADLINE} seconds'
  END AS error FROM documents""")
def apply_deadline(spark, sf_dir):
    """Fifty calls in flight in every task, each with a deadline."""
    applied = apply_flow(table(spark, sf_dir, "documents"), hanging_digest, "text", None,
                         in_flight=50, timeout=DEADLINE)
    return applied.select("doc_id", "status", "result", "error")


# Round trips: write the stand-in to a fresh folder, read it back through the operator.

def _in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Part files that follow the order of the columns."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


@query("read_eval_csv", "SELECT text AS flow_input, source AS expected_output, lang FROM documents")
def read_eval_csv(spark, sf_dir):
    path = scratch_path(spark, "eval-csv")
    sinks.write_csv(table(spark, sf_dir, "documents").select(
        F.col("text").alias("flow_input"), F.col("source").alias("expected_output"), "lang"), path)
    return sources.read_eval_csv(spark, path)


@query("read_batch_csv", f"""
WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS input_index,
                  {sql_strip(PADDED_SQL)} AS flow_input FROM documents)
SELECT input_index, flow_input, {FILE_NAME} AS filename, lang AS var_lang, source AS var_source
FROM d WHERE flow_input <> ''""")
def read_batch_csv(spark, sf_dir):
    path = scratch_path(spark, "batch-csv")
    tasks = _in_order(documents(spark, sf_dir), "doc_id").select(
        "flow_input", F.concat(F.lit(" "), "filename").alias("filename"),
        inputs.encode_variables(F.col("flow_variable")).alias("flow_variable"))
    tasks.write.options(header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False,
                        ignoreTrailingWhiteSpace=False).csv(path)
    read = sources.read_batch_csv(spark, path)
    return read.select(
        "input_index", "flow_input", "filename",
        F.col("flow_variable")["lang"].alias("var_lang"),
        F.col("flow_variable")["source"].alias("var_source"))


RECORDS_PER_FILE = 100


@query("read_json_inputs", "SELECT text AS flow_input, lang AS var1, source AS var2 FROM documents")
def read_json_inputs(spark, sf_dir):
    path = scratch_path(spark, "json-inputs")
    record = F.struct(F.col("text").alias("flow_input"), F.col("lang").alias("var1"),
                      F.col("source").alias("var2"))
    files = table(spark, sf_dir, "documents").groupBy(
        F.floor(F.col("doc_id") / RECORDS_PER_FILE).alias("part")
    ).agg(F.to_json(F.collect_list(record)).alias("body"))
    sinks.write_row_files(
        files.withColumn("filename", F.concat(F.col("part").cast("string"), F.lit(".json"))),
        path, "filename", "body")
    return sources.read_json_inputs(spark, path, "flow_input string, var1 string, var2 string")


@query("read_text_inputs", f"""
SELECT flow_input FROM (
  SELECT {sql_strip("unnest(string_split(text, chr(10)))")} AS flow_input FROM documents)
WHERE flow_input <> ''""")
def read_text_inputs(spark, sf_dir):
    path = scratch_path(spark, "text-inputs")
    lines = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("  "), "text", F.lit("\n \n")).alias("value"))
    lines.write.text(path)
    return sources.read_text_inputs(spark, path)


@query("read_records_csv", """
SELECT p_name AS flow_input, CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, p_type FROM part""")
def read_records_csv(spark, sf_dir):
    path = scratch_path(spark, "records-csv")
    sinks.write_csv(table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("flow_input"), "p_brand", "p_type"), path)
    read = sources.read_records_csv(spark, path)
    return read.select("flow_input", *[
        F.col("flow_variable")[k].alias(k) for k in ("p_partkey", "p_brand", "p_type")])


@query("scan_folder", """
WITH f AS (SELECT CASE lang WHEN 'en' THEN doc_id || '.pdf' WHEN 'fr' THEN doc_id || '.DOCX'
                  WHEN 'de' THEN '~$' || doc_id || '.docx' ELSE doc_id || '.txt' END AS filename,
             CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'docx' END AS file_type,
             octet_length(encode(text)) AS length FROM documents)
SELECT filename, file_type, length, row_number() OVER (ORDER BY file_type DESC, filename)
         AS file_index, count(*) OVER () AS total_files
FROM f WHERE file_type IS NOT NULL""")
def scan_folder(spark, sf_dir):
    path = scratch_path(spark, "folder")
    name = F.expr("""CASE lang WHEN 'en' THEN doc_id || '.pdf' WHEN 'fr' THEN doc_id || '.DOCX'
       WHEN 'de' THEN '~$' || doc_id || '.docx' ELSE doc_id || '.txt' END""")
    sinks.write_row_files(
        table(spark, sf_dir, "documents").select(name.alias("filename"), "text"), path,
        "filename", "text")
    return sources.scan_folder(spark, path).drop("path")


@query("file_type_counts", """
SELECT CASE lang WHEN 'en' THEN 'pdf' ELSE 'docx' END AS file_type, count(*) AS n
FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1""")
def file_type_counts(spark, sf_dir):
    return sources.file_type_counts(scan_folder(spark, sf_dir))


@query("batch_files", f"""
WITH a AS ({APPLIED_SQL}),
d AS (SELECT doc_id, {FILE_NAME} AS filename, lang FROM documents)
SELECT filename, 'first' AS run, status, CASE WHEN status = 'success' THEN result END AS stored
FROM d JOIN a USING (doc_id) WHERE lang IN ('en', 'fr')
UNION ALL
SELECT filename, 'second', CASE WHEN lang IN ('en', 'fr') AND status = 'success'
    THEN 'skipped' ELSE status END, CASE WHEN status = 'success' THEN result END
FROM d JOIN a USING (doc_id)""")
def batch_files(spark, sf_dir):
    """A batch run that writes a file per answer, and a second, larger one that takes it up."""
    folder = scratch_path(spark, "batch-files")
    tasks = documents(spark, sf_dir).withColumn("flow_input", F.col("text"))

    def one_run(batch: DataFrame, name: str) -> DataFrame:
        ran = durable(
            runs.run_batch(batch, checked_digest, sources.list_outputs(spark, folder)), name)
        written = sinks.write_row_files(ran.where("status = 'success'"), folder)
        stored = sources.in_fewer_tasks(
            spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), written)
        answers = stored.select(
            F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("filename"),
            F.decode("content", "UTF-8").alias("stored"))
        return durable(ran.join(answers, "filename", "left").select(
            "filename", F.lit(name).alias("run"), "status", "stored"), name)

    first = one_run(tasks.where("lang IN ('en', 'fr')"), "first")
    return first.unionByName(one_run(tasks, "second"))


@query("write_results", f"""WITH {OUTCOME_SQL}
SELECT event_id, status, CASE WHEN status = 'success' THEN r END AS result, form
FROM outcomes, (VALUES ('csv'), ('json'), ('array')) f(form)""")
def write_results(spark, sf_dir):
    rows = outcome_rows(spark, sf_dir).select("event_id", "status", "result")
    csv, js, arrays = (f"{scratch_path(spark, 'results')}.{x}" for x in ("CSV", "json", "arrays"))
    sinks.write_results(rows, csv)
    sinks.write_results(rows, js)
    sinks.write_json_arrays(rows, arrays)
    schema = "event_id long, status string, result string"
    back = sources.read_csv(spark, csv, schema=schema).withColumn("form", F.lit("csv"))
    lines = spark.read.schema(schema).json(js).withColumn("form", F.lit("json"))
    whole = sources.read_json_inputs(spark, arrays, schema).withColumn("form", F.lit("array"))
    return back.unionByName(lines).unionByName(whole)


@query("write_row_files", """
SELECT source || '/' || doc_id || '.md' AS filename, text AS content FROM documents""")
def write_row_files(spark, sf_dir):
    path = scratch_path(spark, "row-files")
    rows = table(spark, sf_dir, "documents").select(
        F.expr("source || '/' || doc_id || '.md'").alias("filename"), "text")
    written = sinks.write_row_files(rows, path, "filename", "text")
    # As bytes: the text reader copies the whole configuration for every file.
    read = sources.in_fewer_tasks(
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), written)
    return read.select(
        F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("filename"),
        F.col("content").cast("string").alias("content"))


CHECKPOINT = "ticket_id long, status string, flow_process_id string"


def _checkpoint(spark, sf_dir, name: str) -> str:
    """Three runs' rows appended to one checkpoint, one run per order status.

    One run is repeated, and one breaks off before its rows count.
    """
    path = scratch_path(spark, name)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ticket_id"), F.col("o_orderstatus").alias("status"),
        F.expr("CASE WHEN o_totalprice < 20000 THEN 'ERROR: too small' "
               "ELSE md5(CAST(o_orderkey AS STRING)) END").alias("flow_process_id"))
    for status in ("F", "P", "F", "O"):
        sinks.append_checkpoint(rows.where(F.col("status") == status), path, f"status-{status}")
    sinks.checkpoint_attempt(rows.where("status = 'F'"), path, "broken")
    return path


@query("append_checkpoint", """
SELECT o_orderkey AS ticket_id, o_orderstatus AS status, CASE WHEN o_totalprice < 20000
  THEN 'ERROR: too small' ELSE md5(CAST(o_orderkey AS VARCHAR)) END AS flow_process_id
FROM orders""")
def append_checkpoint(spark, sf_dir):
    return sources.read_checkpoint(spark, _checkpoint(spark, sf_dir, "appended"), CHECKPOINT)


@query("checkpoint_overlap", """
SELECT o_orderkey AS ticket_id, CASE WHEN o_orderstatus <> 'O' THEN 'closed' ELSE 'all' END AS status
FROM orders""")
def checkpoint_overlap(spark, sf_dir):
    """Two runs that took up some of the same tickets; the earlier run's rows stay."""
    path = scratch_path(spark, "overlap")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ticket_id"), F.col("o_orderstatus").alias("status"))
    closed = rows.where("status <> 'O'").withColumn("status", F.lit("closed"))
    late = sinks.checkpoint_attempt(rows.withColumn("status", F.lit("all")), path, "all")
    sinks.append_checkpoint(closed, path, "closed")
    sinks.commit_checkpoint(spark, path, "all", late)
    return sources.read_checkpoint(spark, path, "ticket_id long, status string", key="ticket_id")


@query("read_checkpoint", """
SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id FROM orders""")
def read_checkpoint(spark, sf_dir):
    rows = sources.read_checkpoint(spark, _checkpoint(spark, sf_dir, "checkpoint"), CHECKPOINT)
    return sources.processed_ids(rows.unionAll(rows))
