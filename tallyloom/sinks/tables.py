"""Writers for result tables, per-row files and checkpoints."""

from __future__ import annotations

import os
import posixpath
import re
import time
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import durable, spread, store
from tallyloom.sources.tables import committed_runs


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that have no nesting."""
    nested = (T.MapType, T.StructType, T.ArrayType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV that reads back cell for cell: empty text and NULL stay apart, space is kept."""
    _flat(df).write.mode(mode).options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """Write a result table in the format its suffix names: CSV, or JSON with an object a line.

    ``write_json_arrays`` writes arrays of objects.
    """
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".json":
        df.write.json(path)
    elif suffix == ".csv":
        write_csv(df, path)
    else:
        raise ValueError(f"unsupported output format: {suffix or 'none'}")


def write_json_arrays(df: DataFrame, path: str) -> int:
    """Write a new folder of JSON files, each one array of objects; returns their number.

    A task streams its rows into one file, an object a line between the brackets; keys stand in
    the order of the columns, missing values are null. ``coalesce(1)`` gives one array for a
    small table, an empty table one empty array.
    """
    objects = df.select(
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    stored = durable(objects, "objects")

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            values = batch.column("value").to_pylist()
            if values:
                lines = ["[" + values[0] if last is None else values[0], *values[1:]]
                ready = [] if last is None else [last]
                ready += lines[:-1]
                last = lines[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([line + "," for line in ready], pa.string())], ["value"])
        if last is not None or TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([(last or "[") + "]"])], ["value"])

    if stored.isEmpty():
        lines = df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
    else:
        lines = stored.mapInArrow(bracketed, "value string")
    lines.write.text(path)
    system, folder = store(df.sparkSession, path)
    written = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName().endswith(".txt")]
    for part in written:
        system.rename(part, part.suffix(".json"))
    return len(written)


def _file_system(folder: str) -> tuple[FileSystem, str]:
    """The file system that a URI or local path names, and the path there."""
    local = re.sub("^file:/+", "/", folder)
    uri = local if "://" in local else os.path.abspath(local)
    system, root = FileSystem.from_uri(uri)
    return system, root.rstrip("/")


def write_row_files(df: DataFrame, folder: str, filename: str = "filename",
                    text: str = "result") -> int:
    """Write each row's text to ``folder/filename``; returns the number of files.

    ``folder`` is a URI of any store that Arrow's file systems reach, or a path that all
    executors mount. Names must be unique and not null. The rows are stored first, so that what makes them
    runs once, however often a task is repeated. A file appears under its name only when
    complete, and a repeated task leaves the same files.
    """
    rows = durable(df.select(F.col(filename).alias("name"), F.col(text).alias("body")), "files")
    twice = rows.groupBy("name").count().where("count > 1 OR name IS NULL").limit(1).collect()
    if twice and twice[0]["name"] is None:
        raise ValueError("a row has no file name")
    if twice:
        raise ValueError(f"more than one row writes {twice[0]['name']}")
    if "://" not in folder:
        folder = os.path.abspath(re.sub("^file:/+", "/", folder))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(folder)
        made = set()
        for batch in batches:
            for name, body in zip(batch["name"], batch["body"], strict=True):
                target = posixpath.normpath(posixpath.join(root, name))
                if not target.startswith(f"{root}/"):
                    raise ValueError(f"file name {name} leaves the output folder")
                parent = posixpath.dirname(target)
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write((body or "").encode())
                system.move(part, target)
            yield pd.DataFrame({"n": [len(batch)]})

    # Each row costs a file: few splits are dealt out to all cores.
    written = spread(rows, "name").mapInPandas(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


COMMITS = "_commits"
RUN_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"


def checkpoint_attempt(df: DataFrame, path: str, run: str) -> str:
    """Write the rows of a run to a folder of their own and return its name.

    Readers of the checkpoint do not see them before ``commit_checkpoint``.
    """
    if not re.fullmatch(RUN_NAME, run):
        raise ValueError(f"no name for a run: {run!r}")
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}/run={run}/attempt={attempt}")
    return attempt


def commit_checkpoint(spark: SparkSession, path: str, run: str, attempt: str) -> bool:
    """Make an attempt's rows part of the checkpoint, unless its run has some already.

    The marker is complete when it gets its name, and only one can get it: by a hard link in a
    local or mounted folder, elsewhere by a rename that replaces nothing.
    """
    system, folder = store(spark, f"{path.rstrip('/')}/{COMMITS}")
    system.mkdirs(folder)
    marker, draft = (f"{folder}/{name}" for name in (run, f".{uuid.uuid4().hex}"))
    jvm = spark._jvm
    target, made = jvm.org.apache.hadoop.fs.Path(marker), jvm.org.apache.hadoop.fs.Path(draft)
    if system.exists(target):
        return False
    out = system.create(made)
    out.writeBytes(f"{time.time_ns()} {attempt}\n")
    out.close()
    try:
        if system.getScheme() == "file":
            local = [jvm.java.io.File(x.toUri().getPath()).toPath() for x in (target, made)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                target.toUri(), spark._jsc.hadoopConfiguration()).rename(made, target, none)
        return True
    except Py4JJavaError as raised:
        if "FileAlreadyExists" not in raised.java_exception.getClass().getName():
            raise
        return False
    finally:
        system.delete(made, False)


def append_checkpoint(df: DataFrame, path: str, run: str | None = None) -> bool:
    """Add the rows of a run to a checkpoint table; earlier rows are never rewritten.

    Rows count once a marker names them, so a run that breaks off adds nothing. A ``run`` by the
    same name adds its rows once, whether it is repeated or runs twice at a time; the result
    tells whether this call added them. Without a name every call is a run of its own. Runs of
    different names that take up the same ids leave a row each: ``read_checkpoint`` with a
    ``key`` keeps the earliest.
    """
    name = run or f"run-{uuid.uuid4().hex}"
    spark = df.sparkSession
    if run is not None and any(c["run"] == run for c in committed_runs(spark, path)):
        return False
    return commit_checkpoint(spark, path, name, checkpoint_attempt(df, path, name))
