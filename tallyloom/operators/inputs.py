"""Cleaning and shaping of inputs before a row function sees them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import strip
from tallyloom.operators.ordered import with_positions


def clean_inputs(df: DataFrame, column: str = "flow_input") -> DataFrame:
    """Strip the input and drop rows left without one."""
    return df.withColumn(column, strip(F.col(column))).where(F.col(column) != "")


def with_input_index(df: DataFrame, order: Sequence[str], index: str = "input_index") -> DataFrame:
    """0-based position in ``order``, to be taken before anything is filtered."""
    return with_positions(df, order, index=index)


def validate_columns(
    df: DataFrame,
    required: Sequence[str] = ("flow_input",),
    optional: Sequence[str] = ("filename", "flow_variable"),
    output_dir: str | None = None,
) -> DataFrame:
    """Check column names while planning; returns ``df`` unchanged."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    allowed = sorted({*required, *optional})
    extra = sorted(set(df.columns) - set(allowed))
    if extra:
        raise ValueError(
            f"unexpected columns: {', '.join(extra)}; allowed: {', '.join(allowed)}"
        )
    if "filename" in optional and ("filename" in df.columns) != bool(output_dir):
        raise ValueError("an output directory goes with a filename column, and only with one")
    return df


def merge_maps(first: Column, second: Column) -> Column:
    """Union of two maps in which the second wins, whatever the session's dedup policy."""
    first = F.coalesce(first, F.expr("cast(map() as map<string,string>)"))
    second = F.coalesce(second, F.expr("cast(map() as map<string,string>)"))
    kept = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def build_variables(df: DataFrame, filename: str = "filename",
                    flow_variable: str = "flow_variable") -> DataFrame:
    """Variables handed to the row function: the file name, overridden by the row's own map."""
    named = F.when(
        F.col(filename).isNotNull() & (F.col(filename) != ""),
        F.create_map(F.lit("filename"), F.col(filename)),
    )
    return df.withColumn("variables", merge_maps(named, F.col(flow_variable)))


def split_record(df: DataFrame, sequential: bool = False) -> DataFrame:
    """Any record to an input and variables.

    ``flow_input`` (for ``sequential`` also ``human_input``) is the input and the other
    columns are variables; without such a column the whole record is both.
    """
    def as_map(columns: Sequence[str]) -> Column:
        if not columns:
            return F.expr("cast(map() as map<string,string>)")
        pairs = F.map_from_arrays(
            F.array(*[F.lit(c) for c in columns]),
            F.array(*[F.col(c).cast("string") for c in columns]),
        )
        return F.map_filter(pairs, lambda k, v: v.isNotNull())

    names = ["flow_input"] + (["human_input"] if sequential else [])
    chosen = next((n for n in names if n in df.columns), None)
    if chosen:
        text = F.col(chosen).cast("string")
    elif sequential:
        text = F.lit("")
    else:
        text = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    rest = [c for c in df.columns if c != chosen]
    return df.select(text.alias("flow_input"), as_map(rest).alias("flow_variable"))


def encode_variables(variables: Column) -> Column:
    """Variables as a JSON text cell."""
    return F.to_json(variables)


def decode_variables(text: Column) -> Column:
    """Variables from a JSON text cell; NULL when it is no JSON object."""
    return F.from_json(text, "map<string,string>")


def widen_map(df: DataFrame, column: str, prefix: str = "",
              keys: Sequence[str] | None = None) -> DataFrame:
    """Every key seen in a map column becomes a column of its own.

    Column names must be known when the plan is made, so the distinct keys, one for each
    column of the result, are fetched first, unless they are given.
    """
    if keys is not None:
        return _widened(df, column, prefix, keys)
    found = df.select(F.explode(F.map_keys(column)).alias("key")).distinct().collect()
    return _widened(df, column, prefix, sorted(row["key"] for row in found))


def _widened(df: DataFrame, column: str, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != column],
        *[F.col(column)[k].alias(f"{prefix}{k}") for k in keys],
    )


def flatten_results(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Result table with one ``var_`` column per variable and result or error by status.

    ``keys`` names the variables where they are known, which saves the pass to find them.
    """
    success = F.col("status") == "success"
    shaped = df.select(
        "input_index", "flow_input", "status",
        F.to_json("flow_variable").alias("flow_variable"),
        F.when(success, F.col("result")).alias("result"),
        F.when(~success, F.col("error")).alias("error"),
        F.col("flow_variable").alias("__vars"),
    )
    return widen_map(shaped, "__vars", "var_", keys=keys)
