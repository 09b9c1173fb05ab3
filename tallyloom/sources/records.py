"""Records of CSV files whose cells may hold line breaks, read by many tasks a file.

Files are read line by line in splits. A line break ends a record where the number of quotes
before it in the file is even. Each split counts its quotes and, for both cases of what lies
before it, its records; one small row per split then tells which case holds and what number its
first record has. Only lines that are a part of a longer record are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with what each split knows by itself: quotes so far, and records ended so far.

    ``__ends0`` counts the records if the split begins outside a quoted cell, ``__ends1`` if
    inside. Empty lines between records are none.
    """
    here = F.char_length("value") - F.char_length(F.replace("value", F.lit('"')))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"), here.alias("__here"),
        F.col("value").isin("", "\r").alias("__blank"),
        F.endswith("value", F.lit("\r")).alias("__return"))
    # A split is one group: what a task reads at once.
    along = Window.partitionBy("__file", "__block").orderBy("__row")
    counted = lines.withColumn("__quotes", F.sum("__here").over(along))
    before, after = (F.col("__quotes") - F.col("__here")) % 2, F.col("__quotes") % 2

    def ends(start: int) -> Column:
        ended = (after == start) & ~((before == start) & F.col("__blank"))
        return F.sum(ended.cast("long")).over(along)

    return counted.withColumn("__ends0", ends(0)).withColumn("__ends1", ends(1))


def _ladder(lines: DataFrame) -> DataFrame:
    """Per split: whether it begins in a quoted cell, its first record's number, the file's
    first row number, and whether the file's lines end in a carriage return."""
    splits = lines.groupBy("__file", "__block").agg(
        F.max("__quotes").alias("__n"), F.max("__ends0").alias("__n0"),
        F.max("__ends1").alias("__n1"),
        F.min_by("__return", "__row").alias("__return"))
    in_file = Window.partitionBy("__file").orderBy("__block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    over_files = Window.partitionBy(F.lit(0)).orderBy("__path").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begun = splits.withColumn("__inside", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) % 2)
    begun = begun.withColumn(
        "__ended", F.when(F.col("__inside") == 0, F.col("__n0")).otherwise(F.col("__n1")))
    numbered = begun.select(
        "__file", "__block", "__inside", F.coalesce(F.sum("__ended").over(earlier), F.lit(0)).alias("__first"),
        # A quote left open at the end of a file closes with it.
        (F.sum("__ended").over(whole) + F.sum("__n").over(whole) % 2).alias("__records"),
        F.first("__return").over(whole).alias("__return"))
    files = numbered.groupBy(F.col("__file").alias("__path")).agg(F.max("__records").alias("__size"))
    # The first record of every file is its header.
    skipped = files.select("__path", F.coalesce(F.sum(
        F.greatest(F.col("__size") - 1, F.lit(0))).over(over_files), F.lit(0)).alias("__skip"))
    return numbered.join(skipped, F.col("__file") == F.col("__path")).drop("__path", "__records")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``position``, ``record``: the records of CSV files without their headers, unparsed.

    ``position`` counts from 0 over the files in path order. Quotes are doubled inside quoted
    cells, and cells with quotes are quoted. Line breaks are line feeds, with or without a
    carriage return as the file's first line has it; those inside a cell become line feeds.
    """
    lines = _lines(spark, path)
    placed = lines.drop("__return").join(_ladder(lines), ["__file", "__block"])
    inside = F.col("__inside")
    before = (inside + F.col("__quotes") - F.col("__here")) % 2 == 1
    after = (inside + F.col("__quotes")) % 2 == 1
    ends = F.when(inside == 0, F.col("__ends0")).otherwise(F.col("__ends1"))
    blank = F.col("__blank") & ~before
    number = F.col("__first") + ends - F.when(after, 0).otherwise(1)
    placed = placed.where(~blank).select(
        "__file", "__block", "__row", "__skip", "__return", "value", number.alias("__number"),
        (~before & ~after).alias("__whole")).where("__number > 0")
    position = (F.col("__skip") + F.col("__number") - 1).alias("position")
    single = placed.where("__whole").select(position, "__return", F.col("value").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("__block", "__row", "value")))
    joined = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    longer = placed.where("NOT __whole").groupBy("__file", "__number", "__skip", "__return").agg(
        joined.alias("record")).select(position, "__return", "record")
    record = F.regexp_replace("record", r"\r\z", "")
    return single.unionByName(longer).select("position", F.when(
        F.col("__return"), F.replace(record, F.lit("\r\n"), F.lit("\n"))).otherwise(record).alias("record"))
