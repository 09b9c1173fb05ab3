"""Sitemap expansion over captured sitemap documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordered import with_positions
from tallyloom.session import durable


def expand_sitemaps(sitemaps: DataFrame, root: str) -> DataFrame:
    """Page URLs below ``root`` in document order, as ``(url_index, url)`` from 1.

    The documents are parsed once. An index document is replaced by what its children hold,
    level by level: one join per level, until no index is left to open. Repeated URLs and
    repeated children stay repeated. A path of zero-padded positions keeps the order of the
    walk. A document that lists itself, directly or through others, is an error.
    """
    spark = sitemaps.sparkSession
    parsed = durable(sitemaps.select(
        "sitemap_url",
        F.xpath("xml", F.lit("//sitemap/loc/text()")).alias("__children"),
        F.xpath("xml", F.lit("//url/loc/text()")).alias("__urls"),
    ), "sitemaps")
    frontier = spark.range(1).select(
        F.lit(root).alias("loc"), F.lit("").alias("path"),
        F.array().cast("array<string>").alias("above"))
    found = []
    while True:
        # An outer join shows what is missing in the pass that fetches the rest.
        here = durable(
            frontier.join(parsed, F.col("sitemap_url") == F.col("loc"), "left"), "sitemap-level")
        wrong = here.agg(
            F.count_if(F.col("sitemap_url").isNull()).alias("lost"),
            F.count_if(F.array_contains("above", F.col("loc"))).alias("cycles"),
            F.count_if(F.size("__children") > 0).alias("open")).first()
        if wrong["lost"]:
            raise ValueError("a sitemap that is referred to is not among the documents")
        if wrong["cycles"]:
            raise ValueError("a sitemap lists itself")
        is_index = F.size("__children") > 0
        found.append(
            here.where(~is_index).select("path", F.posexplode("__urls").alias("pos", "url")))
        if not wrong["open"]:
            break
        children = here.where(is_index).select(
            "path", F.array_append("above", F.col("loc")).alias("above"),
            F.posexplode("__children").alias("pos", "loc"))
        frontier = children.select(
            "loc", F.concat("path", F.lpad(F.col("pos").cast("string"), 10, "0"), F.lit("/"))
            .alias("path"), "above")
    urls = reduce(DataFrame.unionAll, found)
    numbered = with_positions(urls, ["path", "pos"], index="url_index", start=1)
    # Stored, because a run reads the list several times and plans its joins by its size.
    return durable(numbered.select("url_index", "url"), "sitemap-urls")


def limit_urls(urls: DataFrame, n: int) -> DataFrame:
    """The first ``n`` URLs in document order."""
    return urls.where(F.col("url_index") <= n)
