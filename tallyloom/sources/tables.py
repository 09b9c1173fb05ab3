"""Readers for the input shapes: CSV, JSON, text lines, matrices, folders, checkpoints."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import strip
from tallyloom.operators.inputs import split_record
from tallyloom.operators.ordered import with_positions
from tallyloom.session import durable, store
from tallyloom.sources.records import csv_records

# Delimiters tried, in the order that settles a tie; the last is the fallback.
DELIMITERS = (",", ";", "\t")
FALLBACK_DELIMITER = ";"


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", multiline: bool = True,
    schema: str | None = None, index: str | None = None,
) -> DataFrame:
    """CSV with a header, every cell as text; ``index`` adds the 0-based position of each row.

    Cells may hold line breaks. Files longer than a split are still read by many tasks (see
    ``records``); of those that a task takes whole Spark's own reader does the same. For files
    known to have no such cells ``multiline=False`` takes each line for a record.
    """
    options = {"sep": sep, "quote": '"', "escape": '"'}
    reader = spark.read.options(header=True, multiLine=multiline, encoding="UTF-8", **options)
    if not multiline or not _has_long_file(spark, path):
        rows = (reader.schema(schema) if schema else reader).csv(path)
        return with_file_positions(rows, index).select(index, *rows.columns) if index else rows
    if schema is None:
        # The names alone: the start of one file is read.
        head = reader.csv(path)
        if not head.columns:
            return head.withColumn(index, F.lit(0).cast("long")) if index else head
        schema = ", ".join("`" + name.replace("`", "``") + "` string" for name in head.columns)
    rows = csv_records(spark, path).select(
        *([F.col("position").alias(index)] if index else []),
        F.from_csv("record", schema, options).alias("__cells"))
    return rows.select(*([index] if index else []), "__cells.*")


def _has_long_file(spark: SparkSession, path: str) -> bool:
    """Whether a file is longer than the splits that scans are cut into; lengths alone are read."""
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    listed = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return listed is not None and listed > most


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def read_eval_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Questions with expected answers; further columns are kept."""
    return require(read_csv(spark, path, **options), ["flow_input", "expected_output"])


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that is most frequent in the first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"].strip() if first else ""
    best = max(DELIMITERS, key=line.count)
    return best if line.count(best) else FALLBACK_DELIMITER


def with_file_positions(df: DataFrame, index: str = "input_index") -> DataFrame:
    """0-based row position over the files of a scan, in path order.

    A counter numbers the rows of each input split; one row per split then gives the
    offsets. No row is sorted or moved for it. That table is as long as the list of splits
    the driver made to plan the scan.
    """
    located = durable(df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"),
    ), "located")
    runs = located.groupBy("__file", "__block").agg(
        F.min("__row").alias("__first"), F.count("*").alias("__n"))
    in_file = Window.partitionBy("__file").orderBy("__block")
    over_files = Window.partitionBy(F.lit(0)).orderBy("__path")

    def before(column: str, window) -> Column:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    files = runs.groupBy(F.col("__file").alias("__path")).agg(F.sum("__n").alias("__size"))
    offsets = files.select("__path", before("__size", over_files).alias("__skip"))
    ladder = runs.select("__file", "__block", "__first", before("__n", in_file).alias("__off"))\
        .join(offsets, F.col("__file") == F.col("__path")).drop("__path")
    position = F.col("__skip") + F.col("__off") + F.col("__row") - F.col("__first")
    return located.join(ladder, ["__file", "__block"]).withColumn(index, position).drop(
        "__file", "__block", "__row", "__first", "__off", "__skip")


def read_batch_csv(spark: SparkSession, path: str, sep: str = "auto", **options) -> DataFrame:
    """Batch tasks: position before blank inputs are dropped, file name, variables.

    A ``flow_variable`` cell that is no JSON fails the job and names its row.
    """
    if sep == "auto":
        sep = detect_delimiter(spark, path)
    rows = require(read_csv(spark, path, sep, index="input_index", **options), ["flow_input"])
    rows = rows.withColumn("flow_input", strip(F.col("flow_input")))
    name = strip(F.col("filename")) if "filename" in rows.columns else F.lit(None)
    if "flow_variable" in rows.columns:
        cell = F.nullif(strip(F.col("flow_variable")), F.lit(""))
        broken = cell.isNotNull() & F.try_parse_json(cell).isNull()
        variables = F.when(broken, F.raise_error(F.concat(
            F.lit("invalid JSON in flow_variable of row "), F.col("input_index").cast("string"),
            F.lit(" with flow_input "), F.col("flow_input"),
        ))).otherwise(F.from_json(cell, "map<string,string>"))
    else:
        variables = F.lit(None)
    return rows.where(F.col("flow_input") != "").select(
        "input_index", "flow_input",
        F.nullif(name.cast("string"), F.lit("")).alias("filename"),
        variables.cast("map<string,string>").alias("flow_variable"),
    )


def read_json_inputs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records from files that hold an array of objects or a single object.

    Give a ``schema`` for large inputs; without one Spark reads them once more to find it.
    """
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_text_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is not blank, stripped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("flow_input"))
    return lines.where(F.col("flow_input") != "")


def read_records_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Any CSV as inputs with variables."""
    return split_record(read_csv(spark, path, **options))


def read_matrix_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A matrix with its row position; the first column is the input, the rest variants."""
    df = read_csv(spark, path, index="row_idx", **options)
    if len(df.columns) < 3:
        raise ValueError("a matrix needs an input column and at least one variant column")
    if df.isEmpty():
        raise ValueError("the matrix is empty")
    return df.select("row_idx", *[c for c in df.columns if c != "row_idx"])


#: Short files that a task reads one after the other.
FILES_A_TASK = 1000


def in_fewer_tasks(scan: DataFrame, files: int) -> DataFrame:
    """A scan of so many short files in a task for every ``FILES_A_TASK``, at least one a core.

    Spark's reader counts a file as some megabytes at least, which makes a task of a few dozen
    files however short they are. Nothing is moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.coalesce(max(cores, -(-files // FILES_A_TASK)))


#: Files of a folder that are told of at a time.
FILES_A_BATCH = 10_000


def _hidden(name: str, folder: bool) -> bool:
    """Whether Spark's readers take no notice of a file or folder of that name."""
    kept = folder and name.startswith(("_metadata", "_common_metadata"))
    return not kept and (name.startswith(".") or name.endswith("._COPYING_")
                         or (name.startswith("_") and "=" not in name))


def _files(root: str, below: bool) -> Iterator[tuple[str, int]]:
    """Path and length of the files in a mounted folder, as the system tells of them."""
    folders = [root]
    while folders:
        with os.scandir(folders.pop()) as entries:
            for entry in entries:
                try:
                    found = entry.stat()
                except FileNotFoundError:  # taken away meanwhile, or a link to nothing
                    continue
                inner = stat.S_ISDIR(found.st_mode)
                if _hidden(entry.name, inner):
                    continue
                if inner and below:
                    folders.append(entry.path)
                elif not inner and found.st_size:
                    yield entry.path, found.st_size


def _listed(spark: SparkSession, folder: str, below: bool) -> DataFrame:
    """Path and length of the files in a folder, gone through once; hidden and empty ones left out.

    A folder that the workers mount is listed by one task, which holds a batch of files. Spark's
    reader, which other stores need, holds the list of all files on the driver.
    """
    system, root = store(spark, folder)
    if system.getScheme() == "file" and system.exists(root) and system.getFileStatus(root).isDirectory():
        top = root.toUri().getPath()

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = _files(top, below)
                    while part := list(islice(found, FILES_A_BATCH)):
                        paths = [os.fsencode(f"file:{path}").decode(errors="replace") for path, _ in part]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(paths, pa.string()), pa.array([n for _, n in part], pa.int64())],
                            ["path", "length"])

        listing = spark.range(0, 1, 1, 1).mapInArrow(walk, "path string, length long")
        return durable(listing, "listed")
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", below).load(folder)
    found = scan.select("path", "length")
    # Files as the scan's splits count them; no file is opened, so their length is no matter.
    return durable(in_fewer_tasks(found, 32 * found.rdd.getNumPartitions()), "listed")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """PDF and DOCX files of a folder, not below it: PDF first, each kind in path order.

    Only path and length are read, never file contents.
    """
    listed = _listed(spark, folder, False)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split("filename", r"\."), -1))
    files = (
        listed.withColumn("filename", name)
        .withColumn("file_type", kind)
        .where(F.col("file_type").isin("pdf", "docx") & F.col("filename").contains("."))
        .where(~((F.col("file_type") == "docx") & F.col("filename").startswith("~$")))
        .withColumn("__kind", F.when(F.col("file_type") == "pdf", 0).otherwise(1))
    )
    return with_positions(
        files, ["__kind", "path"], index="file_index", start=1
    ).withColumn("total_files", files.agg(F.count("*")).scalar()).drop("__kind")


def file_type_counts(files: DataFrame) -> DataFrame:
    """Number of files of each kind in a folder scan."""
    return files.groupBy("file_type").agg(F.count("*").alias("n"))


def list_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Names, relative to the folder, of the files in and below it; none if it is absent."""
    try:
        listed = _listed(spark, folder, True)
    except AnalysisException as raised:
        if raised.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "filename string")
    root = re.sub("^file:/*", "/", folder.rstrip("/"))
    if "://" not in root and not root.startswith("/"):
        root = os.path.abspath(root)
    start = F.instr("path", f"{root}/") + len(root) + 1
    return listed.select("path").select(F.substr("path", start).alias("filename"))


def committed_runs(spark: SparkSession, path: str) -> list[dict]:
    """``run``, ``attempt`` and ``at`` (nanoseconds) of a checkpoint's commits, earliest first.

    One short file a run is read.
    """
    try:
        markers = spark.read.text(f"{path.rstrip('/')}/_commits/*").select(
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("run"),
            F.split("value", " ").alias("parts")).collect()
    except AnalysisException as raised:
        if raised.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    found = [{"run": m["run"], "at": int(m["parts"][0]), "attempt": m["parts"][1]} for m in markers]
    return sorted(found, key=lambda c: (c["at"], c["run"]))


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str | None = None
                    ) -> DataFrame:
    """Committed rows of earlier runs, or none if there was no run yet.

    Rows of a run that has no commit marker are left out. With a ``key`` an id that several
    runs took up has the row of the earliest commit alone. Plain Parquet files right in
    the folder count as committed before all runs.
    """
    folder = path.rstrip("/")
    runs = committed_runs(spark, folder)
    tables = [(n, f"{folder}/run={c['run']}/attempt={c['attempt']}") for n, c in enumerate(runs)]
    system, root = store(spark, folder)
    if system.exists(root) and any(
            f.isFile() and not f.getPath().getName().startswith(("_", "."))
            for f in system.listStatus(root)):
        tables.insert(0, (-1, f"{folder}/*.parquet"))
    if not tables:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[t for _, t in tables])
    if key is None:
        return rows
    order = F.create_map(*[F.lit(x) for n, c in enumerate(runs) for x in (c["attempt"], n)]) \
        if runs else F.lit(None).cast("map<string,int>")
    attempt = F.regexp_extract(F.col("_metadata.file_path"), "/attempt=([0-9a-f]+)/[^/]*$", 1)
    placed = rows.select(F.struct(*rows.columns).alias("row"), F.struct(
        F.coalesce(F.try_element_at(order, attempt), F.lit(-1)),
        F.monotonically_increasing_id()).alias("at"))
    return placed.groupBy(F.col(f"row.{key}").alias("__key")).agg(
        F.min_by("row", "at").alias("row")).select("row.*")


def processed_ids(checkpoint: DataFrame, key: str = "ticket_id") -> DataFrame:
    """The distinct ids of a checkpoint as text."""
    return checkpoint.select(F.col(key).cast("string").alias(key)).distinct()
