"""Input-by-variant matrices: wide to one row per cell, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import percent
from tallyloom.functions.text import strip
from tallyloom.operators.apply import RowFunction, apply_flow
from tallyloom.operators.inputs import merge_maps


def expand_matrix(
    df: DataFrame, row_id: str, input_col: str, variants: Sequence[str],
    var_name: str = "col_name",
) -> DataFrame:
    """One row per cell of every row that has an input; the variant's name is a variable."""
    text = strip(F.col(input_col).cast("string"))
    rows = df.select(F.col(row_id).alias("row_idx"), text.alias("flow_input"))\
        .where(F.col("flow_input") != "")
    return rows.select(
        "row_idx", F.explode(F.array(*[F.lit(v) for v in variants])).alias("col_name"),
        "flow_input",
    ).withColumn("variables", F.create_map(F.lit(var_name), F.col("col_name")))


def cell_text(status: Column, result: Column, error: Column) -> Column:
    """What a finished cell shows."""
    return F.when(status == "success", result).otherwise(F.concat(F.lit("ERROR: "), error))


def collapse_matrix(
    base: DataFrame, cells: DataFrame, row_id: str, input_col: str, variants: Sequence[str]
) -> DataFrame:
    """Cells back to the shape of ``base``; rows without an input keep empty cells.

    The variant list is given, so the pivot needs no discovery pass, and a row's group is
    never larger than that list.
    """
    wide = cells.groupBy("row_idx").pivot("col_name", list(variants)).agg(F.first("cell"))
    names = {v: f"__cell_{i}" for i, v in enumerate(variants)}
    wide = wide.select("row_idx", *[F.col(f"`{v}`").alias(n) for v, n in names.items()])
    kept = base.select(row_id, input_col)
    return kept.join(wide, kept[row_id] == wide["row_idx"], "left").select(
        row_id, input_col, *[F.coalesce(F.col(n), F.lit("")).alias(v) for v, n in names.items()]
    )


def run_cells(
    df: DataFrame, fn: RowFunction, row_id: str, input_col: str, variants: Sequence[str],
    var_name: str = "col_name", extra_vars: str | None = None,
) -> DataFrame:
    """Expand and apply; one outcome row per cell."""
    cells = expand_matrix(df, row_id, input_col, variants, var_name)
    if extra_vars:
        extra = df.select(F.col(row_id).alias("row_idx"), F.col(extra_vars).alias("__extra"))
        cells = cells.join(extra, "row_idx")\
            .withColumn("variables", merge_maps(F.col("__extra"), F.col("variables")))\
            .drop("__extra")
    outcomes = apply_flow(cells, fn)
    return outcomes.withColumn(
        "cell", cell_text(F.col("status"), F.col("result"), F.col("error")))


def matrix_run(
    df: DataFrame, fn: RowFunction, row_id: str, input_col: str, variants: Sequence[str],
    var_name: str = "col_name",
) -> DataFrame:
    """Apply ``fn`` to every cell and return the filled matrix."""
    cells = run_cells(df, fn, row_id, input_col, variants, var_name)
    return collapse_matrix(df, cells, row_id, input_col, variants)


def matrix_stats(base: DataFrame, outcomes: DataFrame, variants: Sequence[str],
                 input_col: str) -> DataFrame:
    """Cell counts; a matrix with no input at all reports every cell as skipped."""
    cells = outcomes.agg(
        F.count_if(F.col("status") == "success").alias("completed"),
        F.count_if(F.col("status") != "success").alias("failed"),
    )
    every = base.agg(F.count("*")).scalar() * (len(variants) + 1)
    ran = F.col("completed") + F.col("failed")
    return cells.select(
        "completed", "failed",
        F.when(ran == 0, every).otherwise(F.lit(0)).cast("bigint").alias("skipped"),
        F.when(ran == 0, every).otherwise(ran).cast("bigint").alias("total"),
        percent(F.col("completed"), ran).alias("success_pct"),
    )
