"""Queries over input-by-variant matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import matrix
from tallyloom.plans.common import query, rounded, sql_strip, table
from tallyloom.session import scratch_path
from tallyloom.sinks import tables as sinks
from tallyloom.sources import tables as sources

VARIANTS = ["p_brand", "p_type", "p_size"]
INPUT = "CASE WHEN p_size < 5 THEN '  ' ELSE ' ' || p_name || ' ' END"


def base(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(INPUT).alias("input"), *VARIANTS)


CELLS_SQL = f"""cells AS (
  SELECT p_partkey AS row_idx, col_name, {sql_strip(INPUT)} AS flow_input, p_size
  FROM part, (VALUES ('p_brand'), ('p_type'), ('p_size')) v(col_name) WHERE p_size >= 5)"""


@query("matrix_expand", f"""WITH {CELLS_SQL}
SELECT row_idx, col_name, flow_input, col_name AS variant FROM cells""")
def matrix_expand(spark, sf_dir):
    cells = matrix.expand_matrix(base(spark, sf_dir), "p_partkey", "input", VARIANTS, "variant")
    return cells.withColumn("variant", F.col("variables")["variant"]).drop("variables")


def wide_sql(cell: str) -> str:
    return f"""WITH {CELLS_SQL}, filled AS (SELECT *, {cell} AS cell FROM cells)
    SELECT p_partkey, {INPUT} AS input,
      coalesce((SELECT cell FROM filled WHERE row_idx = p_partkey AND col_name = 'p_brand'), '')
        AS p_brand,
      coalesce((SELECT cell FROM filled WHERE row_idx = p_partkey AND col_name = 'p_type'), '')
        AS p_type,
      coalesce((SELECT cell FROM filled WHERE row_idx = p_partkey AND col_name = 'p_size'), '')
        AS p_size
    FROM part"""


COLLAPSE_CELL = """CASE WHEN col_name = 'p_type' AND p_size > 40 THEN 'ERROR: too large'
  ELSE flow_input || '/' || col_name END"""


@query("matrix_collapse", wide_sql(COLLAPSE_CELL))
def matrix_collapse(spark, sf_dir):
    rows = base(spark, sf_dir)
    sizes = rows.select(F.col("p_partkey").alias("row_idx"), "p_size")
    cells = matrix.expand_matrix(rows, "p_partkey", "input", VARIANTS).join(sizes, "row_idx")
    broken = (F.col("col_name") == "p_type") & (F.col("p_size") > 40)
    cells = cells.withColumn("cell", matrix.cell_text(
        F.when(broken, "error").otherwise("success"),
        F.concat_ws("/", "flow_input", "col_name"), F.lit("too large")))
    return matrix.collapse_matrix(rows, cells, "p_partkey", "input", VARIANTS)


def fill_cell(text: str, variables: dict) -> str:
    """A row function that fails for some inputs and answers nothing for others."""
    if text.startswith("red") and variables["col_name"] == "p_type":
        raise ValueError(f"no type for {text}")
    if text.startswith("small"):
        return "NOCONTENT"
    return f"{text} as {variables['col_name']}"


RUN_CELL = """CASE WHEN flow_input LIKE 'red%' AND col_name = 'p_type'
    THEN 'ERROR: no type for ' || flow_input
  WHEN flow_input LIKE 'small%' THEN 'ERROR: No content returned'
  ELSE flow_input || ' as ' || col_name END"""


@query("matrix_run", wide_sql(RUN_CELL))
def matrix_run(spark, sf_dir):
    return matrix.matrix_run(base(spark, sf_dir), fill_cell, "p_partkey", "input", VARIANTS)


@query("matrix_stats", f"""WITH {CELLS_SQL}, filled AS (SELECT {RUN_CELL} AS cell FROM cells),
c AS (SELECT count(*) FILTER (cell NOT LIKE 'ERROR: %') AS completed,
             count(*) FILTER (cell LIKE 'ERROR: %') AS failed, count(*) AS total FROM filled)
SELECT completed, failed, CAST(0 AS BIGINT) AS skipped, total,
       round(100.0 * completed / total, 6) AS success_pct FROM c""")
def matrix_stats(spark, sf_dir):
    rows = base(spark, sf_dir)
    cells = matrix.run_cells(rows, fill_cell, "p_partkey", "input", VARIANTS)
    return rounded(matrix.matrix_stats(rows, cells, VARIANTS, "input"))


@query("read_matrix_csv", """
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_name AS input, p_brand,
       CAST(p_size AS VARCHAR) AS p_size FROM part""")
def read_matrix_csv(spark, sf_dir):
    path = scratch_path(spark, "matrix-csv")
    wide = table(spark, sf_dir, "part").repartitionByRange("p_partkey")\
        .sortWithinPartitions("p_partkey")
    sinks.write_csv(wide.select(F.col("p_name").alias("input"), "p_brand", "p_size"), path)
    return sources.read_matrix_csv(spark, path)
