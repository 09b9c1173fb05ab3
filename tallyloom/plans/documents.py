"""Queries over documents, web pages and sitemaps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions.binding import explode_once
from tallyloom.operators import chunking, encoding, indexing, sitemaps
from tallyloom.plans.common import (
    SQL_TOKEN, query, sql_heading_list, sql_last_tokens, sql_markdown, sql_sections, sql_strip,
    sql_tokens, table,
)
from tallyloom.session import scratch_path, spread
from tallyloom.sinks import tables as sinks
from tallyloom.sources import tables as sources

# Every paragraph of a page gets a second-level heading of its first word.
WITH_H2 = r"<p>(?:<b>)?([\p{L}\p{N}]+)"
PACK_TOKENS = 200
OVERLAP = 20

HEADER_SQL = "('# ' || url || chr(10) || chr(10))"
SECTIONS_SQL = f"""web AS (
  SELECT page_id, url, {sql_markdown(
      f"regexp_replace(html, '{WITH_H2}', '<h2>{chr(92)}1</h2><p>{chr(92)}1', 'g')")} AS md
  FROM pages),
docs AS (SELECT page_id, url, {sql_tokens(HEADER_SQL)} AS head,
         list_filter({sql_sections(f"{HEADER_SQL} || md")}, lambda s: s <> '# ' || url) AS sections
  FROM web)"""

# In these pages the source heading is a section of its own or is followed by page text.
CLEAN_SQL = f"""{SECTIONS_SQL.split('docs AS')[0]}
docs AS (
  SELECT page_id, url, {sql_tokens(HEADER_SQL)} AS head,
    list_filter(list_transform({sql_sections(f"{HEADER_SQL} || md")}, lambda s:
      CASE WHEN split_part(s, chr(10), 1) = '# ' || url
           THEN {sql_strip("regexp_replace(substr(s, length('# ' || url) + 1), '\\n[ \\t]*\\n', chr(10))")}
           ELSE s END), lambda s: s <> '') AS sections
  FROM web)"""

SECTION_ROWS = f"""secs AS (SELECT page_id, url, head, unnest(sections) AS section,
                unnest(range(1, len(sections) + 1)) AS idx, len(sections) AS total FROM docs),
toks AS (SELECT *, {sql_tokens('section')} AS t FROM secs)"""
ROWS_SQL = f"""{CLEAN_SQL},
{SECTION_ROWS}"""


def sql_packed(budget: int) -> str:
    """Table expressions from ``docs`` to ``units``, the groups of sections within a budget."""
    return f"""{SECTION_ROWS},
fold AS (
  SELECT page_id, 0::BIGINT AS idx, 0 AS unit, head::BIGINT AS used, false AS is_open,
         false AS oversize FROM docs
  UNION ALL
  SELECT f.page_id, k.idx,
    CASE WHEN k.t > {budget} - k.head OR NOT f.is_open
              OR f.used + k.t + 2 > {budget} THEN f.unit + 1 ELSE f.unit END,
    CASE WHEN k.t > {budget} - k.head THEN k.head
         WHEN NOT f.is_open OR f.used + k.t + 2 > {budget} THEN k.head + k.t
         ELSE f.used + k.t + 2 END,
    k.t <= {budget} - k.head, k.t > {budget} - k.head
  FROM fold f JOIN toks k ON k.page_id = f.page_id AND k.idx = f.idx + 1),
units AS (
  SELECT f.page_id, f.unit, min(f.idx) AS start, count(*) AS size, bool_or(oversize) AS oversize,
         string_agg(section, chr(10) || chr(10) ORDER BY f.idx) AS body
  FROM fold f JOIN toks k ON k.page_id = f.page_id AND k.idx = f.idx WHERE f.idx > 0
  GROUP BY f.page_id, f.unit)"""


PACKED_SQL = f"WITH RECURSIVE {CLEAN_SQL},\n{sql_packed(PACK_TOKENS)}"


def pages(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def web(spark, sf_dir) -> DataFrame:
    """Pages as markdown with a heading per paragraph."""
    html = F.regexp_replace("html", WITH_H2, "<h2>$1</h2><p>$1")
    return pages(spark, sf_dir).select(
        "page_id", "url", tx.html_to_markdown(html).alias("md"))


def _sections(spark, sf_dir) -> DataFrame:
    return chunking.section_arrays(web(spark, sf_dir), "md", "url")


@query("html_to_markdown", f"SELECT page_id, {sql_markdown('html')} AS markdown FROM pages")
def html_to_markdown(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", tx.html_to_markdown(F.col("html")).alias("markdown"))


@query("clean_message", f"""
SELECT page_id, CASE WHEN m = '' THEN '[Empty message]' ELSE m END AS message FROM (
  SELECT page_id, {sql_strip('''replace(replace(replace(replace(
    regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
    '&amp;', '&')''')} AS m FROM pages)""")
def clean_message(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", tx.clean_message(F.col("html")).alias("message"))


@query("site_name", """
SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', '_') AS site
FROM pages""")
def site_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.site_name(F.col("url")).alias("site"))


def three_by_three() -> Callable[[str], list]:
    """An encoder whose tokens are up to three characters of a piece."""
    return lambda piece: [piece[i:i + 3] for i in range(0, len(piece), 3)]


@query("encoder_counts", """
SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, ' ?\\pL+| ?\\pN+| ?[^\\s\\pL\\pN]+|\\s+'),
  lambda p: (length(p) + 2) // 3)), 0)::BIGINT AS n_tokens FROM documents""")
def encoder_counts(spark, sf_dir):
    return encoding.encoder_counts(
        documents(spark, sf_dir), "text", three_by_three).select("doc_id", "n_tokens")


@query("token_count", f"SELECT doc_id, CAST({sql_tokens('text')} AS INTEGER) AS n FROM documents")
def token_count(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", tx.token_count(F.col("text")).alias("n"))


@query("split_sections", f"""WITH {SECTIONS_SQL.split('docs AS')[0]}
s AS (SELECT page_id, {sql_sections('md')} AS sections FROM web)
SELECT page_id, unnest(sections) AS section,
       CAST(unnest(range(len(sections))) AS INTEGER) AS section_index FROM s""")
def split_sections(spark, sf_dir):
    cut = web(spark, sf_dir).select(
        "page_id", chunking.split_sections(F.col("md")).alias("sections"))
    return explode_once(cut, "sections", "section_index", "section")


@query("source_header", f"""WITH {ROWS_SQL}
SELECT page_id, CAST(idx AS INTEGER) AS section_index, section FROM toks""")
def source_header(spark, sf_dir):
    named = web(spark, sf_dir).withColumn(
        "md", F.when(F.startswith("url", F.lit("https")),
                     F.concat(chunking.source_header(F.col("url")), "md")).otherwise(F.col("md")))
    arrays = chunking.section_arrays(named, "md", "url")
    return explode_once(
        arrays.select("page_id", "__sections"), "__sections", "section_index", "section"
    ).withColumn("section_index", F.col("section_index") + 1)


@query("heading_list", f"""WITH {CLEAN_SQL}
SELECT page_id, {sql_heading_list('sections')} AS headings FROM docs""")
def heading_list(spark, sf_dir):
    return _sections(spark, sf_dir).select(
        "page_id", chunking.heading_list(F.col("__sections")).alias("headings"))


def _packed(spark, sf_dir) -> DataFrame:
    return _sections(spark, sf_dir).withColumn("units", chunking.pack_sections(
        F.col("__tokens"), PACK_TOKENS, F.col("__head_tokens")))


@query("pack_sections", PACKED_SQL + """
SELECT page_id, CAST(unit AS INTEGER) AS unit, CAST(start AS INTEGER) AS start,
       CAST(size AS INTEGER) AS size, oversize FROM units""")
def pack_sections(spark, sf_dir):
    packed = explode_once(_packed(spark, sf_dir).select("page_id", "units"), "units", "pos", "u")
    return packed.select("page_id", (F.col("pos") + 1).alias("unit"), "u.start", "u.size",
                         "u.oversize")


@query("chunk_overlap", PACKED_SQL + f""",
linked AS (
  SELECT u.page_id, unit, {HEADER_SQL} || body AS text
  FROM units u JOIN docs USING (page_id) WHERE unit = 1
  UNION ALL
  SELECT u.page_id, u.unit, {HEADER_SQL} || {sql_last_tokens('l.text', OVERLAP)}
         || chr(10) || chr(10) || u.body
  FROM linked l JOIN units u ON u.page_id = l.page_id AND u.unit = l.unit + 1
  JOIN docs d ON d.page_id = u.page_id)
SELECT page_id, CAST(unit AS INTEGER) AS chunk_index, text AS chunk_text,
       CAST({sql_tokens('text')} AS INTEGER) AS token_count FROM linked""")
def chunk_overlap(spark, sf_dir):
    parts = F.transform("units", lambda u: F.struct(
        F.col("__head").alias("prefix"),
        F.array_join(F.slice("__sections", u["start"], u["size"]), "\n\n").alias("body"),
        F.lit(True).alias("linked"),
        F.aggregate(F.slice("__tokens", u["start"], u["size"]), F.lit(0), lambda a, b: a + b)
        .alias("tokens")))
    packed = _packed(spark, sf_dir).select("page_id", parts.alias("parts"))
    chunks = explode_once(packed.select("page_id", chunking.assemble_chunks(
        F.col("parts"), OVERLAP).alias("chunks")), "chunks", "pos", "chunk")
    return chunks.select("page_id", (F.col("pos") + 1).alias("chunk_index"),
                         F.col("chunk.text").alias("chunk_text"),
                         F.col("chunk.tokens").alias("token_count"))


def sql_split(source: str, name: str, overlap: int) -> str:
    """Table expressions that cut ``source(key, room, text)`` into ``name(key, no, piece)``.

    One expression per separator, coarse to fine, each cutting what is over ``room`` after every
    separator; then words over ``room`` at every ``room`` tokens. The atoms have running token
    counts, from which each possible first atom of a piece knows where the piece ends and where
    the next one begins; following these from atom 1 gives the pieces.
    """
    levels = [f"{name}_0 AS (SELECT key, greatest(room, 1) AS room, [1] AS path, text AS t, "
              f"{sql_tokens('text')} AS n FROM {source})"]
    for i, separator in enumerate(("chr(10) || chr(10)", "chr(10)", "'. '", "' '"), 1):
        levels.append(f"""{name}_{i} AS (
  SELECT key, room, list_append(path, j) AS path, t, {sql_tokens('t')} AS n FROM (
    SELECT key, room, path, j, CASE WHEN j < len(parts) THEN parts[j] || sep ELSE parts[j] END AS t
    FROM (SELECT key, room, path, parts, sep, unnest(range(1, len(parts) + 1)) AS j FROM (
      SELECT key, room, path, {separator} AS sep, CASE WHEN n > room
        THEN string_split(t, {separator}) ELSE [t] END AS parts FROM {name}_{i - 1})))
  WHERE t <> '')""")
    runs = f"regexp_extract_all(t, '(?:^\\s+)?{SQL_TOKEN}\\s*')"
    piece = sql_strip("CASE WHEN h.stop IS NULL THEN substr(o.text, f.at + 1) "
                      "ELSE substr(o.text, f.at + 1, z.at - f.at) END")
    return ",\n".join(levels) + f""",
{name}_5 AS (
  SELECT key, room, list_append(path, j) AS path, parts[j] AS t, least(n - (j - 1) * room, room) AS n
  FROM (SELECT key, room, path, n, parts, unnest(range(1, len(parts) + 1)) AS j FROM (
    SELECT key, room, path, n, CASE WHEN n > room THEN list_transform(
        range(0, CAST(ceil(n / room) AS BIGINT)),
        lambda k: array_to_string({runs}[k * room + 1:(k + 1) * room], ''))
      ELSE [t] END AS parts FROM {name}_4))),
{name}_atoms AS (
  SELECT key, room, row_number() OVER w AS i, n, coalesce(sum(n) OVER before, 0)::BIGINT AS c,
         coalesce(sum(length(t)) OVER before, 0)::BIGINT AS at
  FROM {name}_5 WINDOW w AS (PARTITION BY key ORDER BY path),
    before AS (PARTITION BY key ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_ends AS (SELECT key, c + n AS reach, min(i) AS i FROM {name}_atoms GROUP BY 1, 2),
{name}_begins AS (SELECT key, c, min(i) AS i FROM {name}_atoms GROUP BY 1, 2),
{name}_cut AS (
  SELECT a.key, a.i, e.i AS stop
  FROM {name}_atoms a ASOF JOIN {name}_ends e ON a.key = e.key AND a.c + a.room < e.reach),
{name}_kept AS (
  SELECT x.key, x.i, x.stop, s.c - least({overlap}, s.room - s.n) AS least_c
  FROM {name}_cut x JOIN {name}_atoms s ON s.key = x.key AND s.i = x.stop),
{name}_hop AS (
  SELECT k.key, k.i, k.stop, greatest(k.i, b.i) AS next
  FROM {name}_kept k ASOF JOIN {name}_begins b ON k.key = b.key AND k.least_c <= b.c),
{name}_walk AS (
  SELECT key, 1::BIGINT AS i, 1 AS no FROM {name}_0
  UNION ALL
  SELECT w.key, h.next, w.no + 1 FROM {name}_walk w JOIN {name}_hop h ON h.key = w.key AND h.i = w.i),
{name} AS (
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY no) AS no, piece FROM (
    SELECT w.key, w.no, {piece} AS piece
    FROM {name}_walk w JOIN {source} o ON o.key = w.key
    JOIN {name}_atoms f ON f.key = w.key AND f.i = w.i
    LEFT JOIN {name}_hop h ON h.key = w.key AND h.i = w.i
    LEFT JOIN {name}_atoms z ON z.key = h.key AND z.i = h.stop)
  WHERE piece <> '')"""


SPLIT_TOKENS, SPLIT_OVERLAP = 300, 30


@query("split_oversize", f"""WITH RECURSIVE long AS (
  SELECT doc_id AS key, {SPLIT_TOKENS} AS room, coalesce(text, '') AS text FROM documents),
{sql_split('long', 'pieces', SPLIT_OVERLAP)}
SELECT key AS doc_id, CAST(no - 1 AS INTEGER) AS piece_index, piece,
       CAST({sql_tokens('piece')} AS INTEGER) AS token_count FROM pieces""")
def split_oversize(spark, sf_dir):
    units = F.array(F.struct(
        F.coalesce("text", F.lit("")).alias("text"), F.lit(SPLIT_TOKENS).alias("budget")))
    pieces = chunking.oversize_splitter(SPLIT_OVERLAP)(units)[0]
    split = explode_once(
        documents(spark, sf_dir).select("doc_id", pieces.alias("pieces")),
        "pieces", "piece_index", "piece")
    return split.withColumn("token_count", tx.token_count(F.col("piece")))


def sql_chunks(budget: int, overlap: int) -> str:
    """Table expressions from ``docs`` (see ``CLEAN_SQL``) to ``chunks``, oversize sections
    split."""
    packed = sql_packed(budget)
    listed = sql_heading_list(
        "(list_slice(sections, CAST(start AS INTEGER), CAST(start + size - 1 AS INTEGER)))")
    line = r"(?m)^[ \t]*(## [^\n]*)$"
    without = sql_strip(r"regexp_replace(body, '(?m)^[ \t]*## [^\n]*$\n?', '', 'g')")
    after = "CASE WHEN {0} <> '' THEN {0} || chr(10) || chr(10) ELSE '' END"
    return f"""{packed},
described AS (
  SELECT u.page_id, url, unit, oversize, body, head, {HEADER_SQL} AS name, {listed} AS list,
    CASE WHEN oversize THEN {sql_strip(f"regexp_extract(body, '{line}', 1)")} ELSE '' END AS h2
  FROM units u JOIN docs USING (page_id)),
long AS (
  SELECT page_id || '/' || unit AS key, CAST({budget} - head - {sql_tokens('h2')} AS INTEGER) AS room,
    {without} AS text
  FROM described WHERE oversize),
{sql_split('long', 'pieces', overlap)},
bodies AS (
  SELECT page_id, url, unit, 1 AS no, name || {after.format('list')} AS prefix, body, true AS linked
  FROM described WHERE NOT oversize
  UNION ALL
  SELECT page_id, url, unit, no, name || {after.format(f"({sql_strip('list')})")}
         || {after.format('h2')}, piece, no = 1
  FROM described JOIN pieces ON key = page_id || '/' || unit WHERE oversize),
parts AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY unit, no) AS seq FROM bodies),
assembled AS (
  SELECT page_id, seq, prefix || body AS text FROM parts WHERE seq = 1
  UNION ALL
  SELECT p.page_id, p.seq, p.prefix || CASE WHEN p.linked
      THEN {sql_last_tokens('l.text', overlap)} || chr(10) || chr(10) ELSE '' END || p.body
  FROM assembled l JOIN parts p ON p.page_id = l.page_id AND p.seq = l.seq + 1),
chunks AS (
  SELECT page_id, url, CAST(seq AS INTEGER) AS chunk_index,
    CAST(count(*) OVER (PARTITION BY page_id) AS INTEGER) AS total_chunks,
    CAST({sql_tokens('text')} AS INTEGER) AS token_count, text AS chunk_text,
    replace(substr(text, 1, 100), chr(10), ' ') AS chunk_preview
  FROM assembled JOIN (SELECT page_id, url FROM docs) USING (page_id))"""


def sql_named_texts(source: str) -> str:
    """``docs`` (see ``CLEAN_SQL``) of ``source``, a query for page_id, url and md."""
    return f"web AS ({source}),\n" + CLEAN_SQL[CLEAN_SQL.index("docs AS ("):]


DOC_CHUNKS = (400, 40)


@query("chunk_documents", f"""WITH RECURSIVE {sql_named_texts(
    "SELECT doc_id AS page_id, source || '/' || doc_id || '.md' AS url, coalesce(text, '') AS md "
    "FROM documents")},
{sql_chunks(*DOC_CHUNKS)}
SELECT page_id AS doc_id, url AS name, chunk_index, total_chunks, token_count, chunk_text,
  chunk_preview FROM chunks""")
def chunk_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn(
        "name", F.expr("source || '/' || doc_id || '.md'"))
    return chunking.chunk_documents(docs, "doc_id", "text", "name", *DOC_CHUNKS)


@query("chunk_pages", f"""WITH RECURSIVE {CLEAN_SQL},
{sql_chunks(PACK_TOKENS, OVERLAP)}
SELECT * FROM chunks""")
def chunk_pages(spark, sf_dir):
    return chunking.chunk_documents(
        web(spark, sf_dir), "page_id", "md", "url", PACK_TOKENS, OVERLAP)


@query("chunk_preview", """
SELECT doc_id, replace(substr(text, 1, 100), chr(10), ' ') AS chunk_preview,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS result_preview
FROM documents""")
def chunk_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.chunk_preview(F.col("text")).alias("chunk_preview"),
        tx.result_preview(F.col("text")).alias("result_preview"))


def _section_chunks(spark, sf_dir) -> DataFrame:
    """Sections of the pages in the shape of chunks."""
    arrays = _sections(spark, sf_dir).select(
        "page_id", "url", F.size("__sections").alias("total_chunks"),
        F.arrays_zip(F.col("__sections").alias("s"), F.col("__tokens").alias("t")).alias("zipped"))
    return explode_once(arrays, "zipped", "pos", "both").select(
        "page_id", "url", (F.col("pos") + 1).alias("chunk_index"), "total_chunks",
        F.col("both.s").alias("chunk_text"), F.col("both.t").alias("token_count"),
        tx.chunk_preview(F.col("both.s")).alias("chunk_preview"))


@query("provenance", f"""WITH {ROWS_SQL}
SELECT page_id, CAST(idx AS VARCHAR) AS chunk_index, CAST(total AS VARCHAR) AS total_chunks,
       CAST(t AS VARCHAR) AS token_count, url, 'url' AS source FROM toks""")
def provenance(spark, sf_dir):
    tagged = chunking.with_provenance(_section_chunks(spark, sf_dir), "url", url="url")
    return tagged.select("page_id", *[
        F.col("variables")[k].alias(k)
        for k in ("chunk_index", "total_chunks", "token_count", "url", "source")])


@query("chunk_stats", f"""WITH {ROWS_SQL}
SELECT count(*) AS chunks, CAST(sum(t) AS BIGINT) AS total_tokens,
       CAST(sum(t) // count(*) AS BIGINT) AS avg_tokens FROM toks""")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(_section_chunks(spark, sf_dir))


INDEXED_SQL = f"""{ROWS_SQL},
broken AS (SELECT page_id, url FROM pages WHERE url LIKE '%spam%'),
rows AS (
  SELECT k.page_id, k.url, CAST(idx AS INTEGER) AS chunk_index, CAST(t AS INTEGER) AS token_count,
    replace(substr(section, 1, 100), chr(10), ' ') AS chunk_preview,
    CASE WHEN t < 20 THEN 'ERROR: No content returned'
         ELSE md5(k.page_id || '#' || k.url || '#' || idx) END AS flow_process_id,
    CASE WHEN t < 20 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN t < 20 THEN NULL WHEN length(section) > 200
         THEN substr(section, 1, 200) || '...' ELSE section END AS result,
    CASE WHEN t < 20 THEN 'No content returned' END AS error
  FROM toks k WHERE url NOT LIKE '%spam%'
  UNION ALL
  SELECT page_id, url, 0, 0, '', 'ERROR: blocked', 'failed', NULL, 'blocked' FROM broken)"""


def _indexed(spark, sf_dir) -> DataFrame:
    chunks = _section_chunks(spark, sf_dir).where(~F.col("url").contains("spam"))
    empty = F.col("token_count") < 20
    done = chunks.withColumn("status", F.when(empty, "failed").otherwise("success"))\
        .withColumn("result", F.col("chunk_text"))\
        .withColumn("error", F.when(empty, F.lit("No content returned")))
    broken = table(spark, sf_dir, "pages").where(F.col("url").contains("spam"))
    return indexing.index_results(
        done, ["page_id", "url"], broken.select("page_id", "url", F.lit("blocked").alias("error")))


@query("index_results", f"WITH {INDEXED_SQL} SELECT * FROM rows")
def index_results(spark, sf_dir):
    return _indexed(spark, sf_dir)


@query("index_rollup", f"""WITH {INDEXED_SQL},
s AS (SELECT page_id, count(*) FILTER (chunk_index = 0) AS broken,
        count(*) FILTER (chunk_index > 0 AND status = 'success') AS ok,
        count(*) FILTER (chunk_index > 0 AND status <> 'success') AS bad FROM rows GROUP BY 1)
SELECT count(*) AS total_sources, count(*) FILTER (broken = 0) AS sources_ok,
       count(*) FILTER (broken > 0) AS sources_failed, CAST(sum(ok) AS BIGINT) AS chunks_ok,
       CAST(sum(bad) AS BIGINT) AS chunks_failed FROM s""")
def index_rollup(spark, sf_dir):
    return indexing.index_rollup(_indexed(spark, sf_dir), "page_id")


def digest_chunk(text: str, variables: dict) -> str:
    """A row function over chunks."""
    if "spam" in variables["url"]:
        raise ValueError("refused")
    return hashlib.md5(text.encode()).hexdigest()


CAPTURED_SQL = f"SELECT page_id, url, {sql_markdown('html')} AS md FROM pages"


def sql_indexed(rest: str, columns: str) -> str:
    """Index rows of ``chunks`` under ``digest_chunk``, and one of each source without any."""
    ids = " || '#' || ".join(columns.split(", "))
    return f"""
SELECT {columns}, chunk_index, token_count, chunk_preview,
  CASE WHEN url LIKE '%spam%' THEN 'ERROR: refused' ELSE md5({ids} || '#' || chunk_index)
  END AS flow_process_id,
  CASE WHEN url LIKE '%spam%' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN url NOT LIKE '%spam%' THEN md5(chunk_text) END AS result,
  CASE WHEN url LIKE '%spam%' THEN 'refused' END AS error FROM chunks {rest}
UNION ALL
SELECT {columns}, 0, 0, '', 'ERROR: No content extracted', 'failed', NULL, 'No content extracted'
FROM docs {rest} WHERE page_id NOT IN (SELECT page_id FROM chunks)"""


@query("index_pages", f"""WITH RECURSIVE {sql_named_texts(CAPTURED_SQL)},
{sql_chunks(PACK_TOKENS, OVERLAP)}
{sql_indexed('', 'page_id, url')}""")
def index_pages(spark, sf_dir):
    return indexing.index_pages(
        pages(spark, sf_dir), digest_chunk, max_tokens=PACK_TOKENS, overlap=OVERLAP)


ENTRIES_PER_SITEMAP = 20


def captured_sitemaps(spark, sf_dir) -> tuple[DataFrame, str]:
    """Sitemap documents over the pages, and the root's name.

    A tree of fixed fan-out: no document lists more than ``ENTRIES_PER_SITEMAP`` entries,
    and the number of levels grows with the pages.
    """
    def entries(kind: str, loc: str) -> Column:
        escaped = F.replace(F.col(loc), F.lit("&"), F.lit("&amp;"))
        return F.concat(F.lit(f"<{kind}><loc>"), escaped, F.lit(f"</loc></{kind}>"))

    def document(tag: str, kind: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("at", "entry")))
        body = F.array_join(F.transform(ordered, lambda e: e["entry"]), "")
        space = "http://www.sitemaps.org/schemas/sitemap/0.9"
        return F.concat(F.lit(f'<?xml version="1.0"?><{tag} xmlns="{space}">'), body,
                        F.lit(f"</{tag}>")).alias("xml")

    def level(rows: DataFrame, key: Column, name: str, tag: str, kind: str) -> DataFrame:
        return rows.withColumn("entry", entries(kind, "loc")).groupBy(key.alias("key")).agg(
            document(tag, kind)
        ).withColumn("sitemap_url", F.concat(F.lit(f"{name}-"), F.col("key").cast("string")))

    stored = table(spark, sf_dir, "pages")
    rows = stored.select(F.col("page_id").alias("at"), F.col("url").alias("loc"))
    span = stored.agg(F.max("page_id")).first()[0] + 1
    tag, kind, levels = "urlset", "url", []
    while not levels or span > 1:
        bucket = F.floor(F.col("at") / ENTRIES_PER_SITEMAP)
        level_docs = level(rows, bucket, f"level{len(levels)}", tag, kind)
        levels.append(level_docs.select("sitemap_url", "xml"))
        rows = level_docs.select(F.col("key").alias("at"), F.col("sitemap_url").alias("loc"))
        span = -(-span // ENTRIES_PER_SITEMAP)
        tag, kind = "sitemapindex", "sitemap"
    return reduce(DataFrame.unionAll, levels), f"level{len(levels) - 1}-0"


@query("sitemap_expand", """
SELECT row_number() OVER (ORDER BY page_id) AS url_index, url FROM pages""")
def sitemap_expand(spark, sf_dir):
    return sitemaps.expand_sitemaps(*captured_sitemaps(spark, sf_dir))


@query("sitemap_limit", """
SELECT * FROM (SELECT row_number() OVER (ORDER BY page_id) AS url_index, url FROM pages)
WHERE url_index <= 100""")
def sitemap_limit(spark, sf_dir):
    return sitemaps.limit_urls(sitemap_expand(spark, sf_dir), 100)


SITE_CHUNKS = (120, 15)


@query("index_sitemap", f"""WITH RECURSIVE {sql_named_texts(CAPTURED_SQL)},
{sql_chunks(*SITE_CHUNKS)},
n AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS url_index FROM pages)
{sql_indexed('JOIN n USING (page_id)', 'url_index, url')}""")
def index_sitemap(spark, sf_dir):
    urls = sitemap_expand(spark, sf_dir)
    return indexing.index_sitemap(urls, pages(spark, sf_dir), digest_chunk, *SITE_CHUNKS)


@query("index_folder", f"""WITH RECURSIVE f AS (
  SELECT CASE lang WHEN 'en' THEN doc_id || '.pdf' ELSE doc_id || '.docx' END AS filename,
    CASE lang WHEN 'en' THEN 'pdf' ELSE 'docx' END AS file_type,
    CASE WHEN lang <> 'es' THEN text END AS text FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY file_type DESC, filename) AS file_index FROM f),
{sql_named_texts(
    "SELECT file_index AS page_id, filename AS url, text AS md FROM n WHERE text IS NOT NULL")},
{sql_chunks(4000, 100)}
SELECT file_index, filename, file_type, coalesce(chunk_index, 0) AS chunk_index,
  coalesce(token_count, 0) AS token_count, coalesce(chunk_preview, '') AS chunk_preview,
  CASE WHEN chunk_index IS NULL THEN 'ERROR: No content extracted'
       ELSE md5(file_index || '#' || filename || '#' || file_type || '#' || chunk_index)
  END AS flow_process_id,
  CASE WHEN chunk_index IS NULL THEN 'failed' ELSE 'success' END AS status,
  length(chunk_text) || ' of ' || filename AS result,
  CASE WHEN chunk_index IS NULL THEN 'No content extracted' END AS error
FROM n LEFT JOIN chunks ON page_id = file_index""")
def index_folder(spark, sf_dir):
    folder = scratch_path(spark, "indexed-folder")
    name = F.expr("CASE lang WHEN 'en' THEN doc_id || '.pdf' ELSE doc_id || '.docx' END")
    stored = table(spark, sf_dir, "documents").select(name.alias("filename"), "lang", "text")
    sinks.write_row_files(stored, folder, "filename", "text")
    extracted = stored.select("filename", F.expr("CASE WHEN lang <> 'es' THEN text END AS text"))
    return indexing.index_folder(
        sources.scan_folder(spark, folder), extracted,
        lambda text, variables: f"{len(text)} of {variables['filename']}")
