"""Result tables of indexing runs and the runs themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import html_to_markdown, result_preview
from tallyloom.operators.apply import RowFunction, apply_flow
from tallyloom.operators.chunking import (
    MAX_TOKENS, OVERLAP_TOKENS, chunk_documents, with_provenance,
)

INDEX_COLUMNS = [
    "chunk_index", "token_count", "chunk_preview", "flow_process_id", "status", "result", "error",
]


def process_id(*parts: str) -> Column:
    """An id that names the same unit of work in every run."""
    return F.md5(F.concat_ws("#", *[F.col(p).cast("string") for p in parts]))


def index_results(
    outcomes: DataFrame,
    source_columns: list[str],
    source_failures: DataFrame | None = None,
    indexed_at: Column | None = None,
) -> DataFrame:
    """One row per chunk outcome, and one with index 0 for each source that failed whole."""
    failed = F.col("status") != "success"
    rows = outcomes.select(
        *source_columns,
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("token_count").cast("int").alias("token_count"),
        "chunk_preview",
        F.when(failed, F.concat(F.lit("ERROR: "), F.col("error")))
        .otherwise(process_id(*source_columns, "chunk_index")).alias("flow_process_id"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(~failed, result_preview(F.col("result"))).alias("result"),
        F.when(failed, F.col("error")).alias("error"),
    )
    if source_failures is not None:
        rows = rows.unionByName(source_failures.select(
            *source_columns,
            F.lit(0).alias("chunk_index"), F.lit(0).alias("token_count"),
            F.lit("").alias("chunk_preview"),
            F.concat(F.lit("ERROR: "), F.col("error")).alias("flow_process_id"),
            F.lit("failed").alias("status"),
            F.lit(None).cast("string").alias("result"), F.col("error"),
        ))
    return rows if indexed_at is None else rows.withColumn("indexed_at", indexed_at)


def index_rollup(results: DataFrame, source: str) -> DataFrame:
    """Totals of an indexing run.

    A source counts as done once it was chunked, even if some of its chunks failed; those
    are reported beside it.
    """
    is_chunk = F.col("chunk_index") > 0
    per_source = results.groupBy(source).agg(
        F.count_if(~is_chunk).alias("broken"),
        F.count_if(is_chunk & (F.col("status") == "success")).alias("ok"),
        F.count_if(is_chunk & (F.col("status") != "success")).alias("bad"),
    )
    return per_source.agg(
        F.count("*").alias("total_sources"),
        F.count_if(F.col("broken") == 0).alias("sources_ok"),
        F.count_if(F.col("broken") > 0).alias("sources_failed"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("chunks_ok"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("chunks_failed"),
    )


def index_sources(
    sources: DataFrame, fn: RowFunction, id_col: str, text: str, header: str, kind: str,
    columns: list[str], variables: dict[str, str],
    max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS,
    missing: str = "No content extracted",
) -> DataFrame:
    """Texts to index results: chunk, tag with where it comes from, apply, tabulate.

    One pass over the sources. One without text stays among the rows with index 0, is not
    handed to the row function, and is reported as failed as a whole.
    """
    carried = [c for c in dict.fromkeys([*columns, *variables.values()]) if c in sources.columns]
    chunks = chunk_documents(
        sources, id_col, text, header, max_tokens, overlap, keep_empty=True, carry=carried)
    outcomes = apply_flow(
        with_provenance(chunks, kind, **variables), fn, input_col="chunk_text")
    empty = F.col("chunk_index") == 0
    outcomes = outcomes.withColumn(
        "error", F.when(empty, F.lit(missing)).otherwise(F.col("error"))
    ).withColumn("token_count", F.coalesce("token_count", F.lit(0)))\
        .withColumn("chunk_preview", F.coalesce("chunk_preview", F.lit("")))
    return index_results(outcomes, columns)


def index_pages(
    pages: DataFrame, fn: RowFunction, id_col: str = "page_id", url: str = "url",
    html: str = "html", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Captured pages to index results."""
    texts = pages.select(id_col, url, html_to_markdown(F.col(html)).alias("__text"))
    return index_sources(texts, fn, id_col, "__text", url, "url", [id_col, url], {"url": url},
                         max_tokens, overlap)


def index_sitemap(
    urls: DataFrame, pages: DataFrame, fn: RowFunction,
    max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """The captured pages of an expanded sitemap, ``urls(url_index, url)``, in its order.

    A URL listed twice is indexed twice; one without a captured page fails as a source.
    """
    captured = pages.select(F.col("url").alias("__url"), "html")
    same = F.col("url") == F.col("__url")
    # An inner join, so that a short list of URLs can go to the pages instead of the pages
    # being shuffled to it; what it leaves out is told by the URL column alone.
    found = captured.join(urls, same).select(
        "url_index", "url", html_to_markdown(F.col("html")).alias("__text"))
    lost = urls.join(captured.select("__url"), same, "left_anti").select(
        "url_index", "url", F.lit(None).cast("string").alias("__text"))
    texts = found.unionByName(lost).withColumn("total_urls", urls.agg(F.count("*")).scalar())
    return index_sources(
        texts, fn, "url_index", "__text", "url", "sitemap", ["url_index", "url"],
        {"url_index": "url_index", "total_urls": "total_urls", "url": "url"},
        max_tokens, overlap, missing="Page not captured")


def index_folder(
    files: DataFrame, texts: DataFrame, fn: RowFunction,
    max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """The files of a folder scan with their extracted ``texts(filename, text)``."""
    extracted = texts.select(F.col("filename").alias("__name"), F.col("text").alias("__text"))
    joined = files.join(extracted, F.col("filename") == F.col("__name"), "left").drop("__name")
    return index_sources(
        joined, fn, "file_index", "__text", "filename", "folder",
        ["file_index", "filename", "file_type"],
        {"file_index": "file_index", "total_files": "total_files", "filename": "filename",
         "file_path": "path", "file_type": "file_type"},
        max_tokens, overlap)
