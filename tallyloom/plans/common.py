"""Registry of runnable queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that summation order does not show."""
    return df.select(*[
        F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# SQL text for the checks, one helper per expression the checks share. Rules are stated here
# anew, so that a check does not take them over from what it checks.

# One token, and a plain decimal number.
SQL_TOKEN = r"(?:[\pL\pN]+|[^\s\pL\pN])"
SQL_NUMBER = r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"

EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+\z"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE_SPACE}', '', 'g')"


def sql_number(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '{SQL_NUMBER}') " \
           f"THEN try_cast(trim({x}) AS DOUBLE) END"


def sql_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{SQL_TOKEN}'))"


def sql_last_tokens(x: str, n: int) -> str:
    return f"array_to_string(regexp_extract_all({x}, '{SQL_TOKEN}\\s*')[-{n}:], '')"


def sql_stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


# Rules of the markdown check, in the order they are applied.
SQL_TAG_RULES = [
    ("<(b|strong)( [^>]*)?>(.*?)</(b|strong)>", "**\\3**"),
    ("<(i|em)( [^>]*)?>(.*?)</(i|em)>", "_\\3_"),
    ("<li( [^>]*)?>", "\n* "),
    ("<br[^>]*>", "\n"),
    ("</h[1-6]>", "\n\n"),
    ("</?(p|div|ul|ol|table|tr|article|section|footer|blockquote)( [^>]*)?>", "\n\n"),
    ("""<img [^>]*alt=("([^"]*)"|'([^']*)')[^>]*src=("([^"]*)"|'([^']*)')[^>]*>""", "![\\2\\3](\\5\\6)"),
    ("""<img [^>]*src=("([^"]*)"|'([^']*)')[^>]*alt=("([^"]*)"|'([^']*)')[^>]*>""", "![\\5\\6](\\2\\3)"),
    ("""<img [^>]*src=("([^"]*)"|'([^']*)')[^>]*>""", "![](\\2\\3)"),
    ("""<a [^>]*href=("([^"]*)"|'([^']*)')[^>]*>(.*?)</a>""", "[\\4](\\2\\3)"),
    ("<[a-z/!?][^>]*>", ""),
]
# The entities that the test pages have, and some more.
SQL_ENTITIES = {
    "quot": '"', "lt": "<", "gt": ">", "nbsp": " ", "copy": "(C)", "middot": "*", "mdash": "--",
    "ndash": "-", "#39": "'", "apos": "'", "amp": "&",
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_markdown(x: str) -> str:
    """Markdown of pages without preformatted text and ordered lists."""
    for tag in ("head", "script", "style"):
        x = f"regexp_replace({x}, '<{tag}[ >].*?</{tag}>', '', 'gis')"
    x = f"regexp_replace(regexp_replace({x}, '<!--.*?-->', '', 'gs'), '[ \\t\\r\\n]+', ' ', 'g')"
    for level in range(1, 7):
        x = f"regexp_replace({x}, '<h{level}[^>]*>', chr(10) || chr(10) || '{'#' * level} ', 'gi')"
    for pattern, replacement in SQL_TAG_RULES:
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(replacement)}, 'gi')"
    for name, character in SQL_ENTITIES.items():
        x = f"replace({x}, '&{name};', {_quoted(character)})"
    x = f"regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return sql_strip(f"regexp_replace({x}, '\\n\\n\\n+', chr(10) || chr(10), 'g')")


def sql_sections(x: str) -> str:
    cut = f"regexp_replace({x}, '\\n[ \\t]*(#{{1,2}} )', chr(2) || '\\1', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(2)), " \
           f"lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_heading_list(sections: str) -> str:
    one = "list_filter(list_transform(regexp_extract_all(s, '(?m)^[ \\t]*## (.*)$', 1), " \
          f"lambda h: {sql_strip('h')}), lambda h: h <> '')"
    found = f"flatten(list_transform({sections}, lambda s: {one}))"
    bullets = f"array_to_string(list_transform({found}, lambda h: '- ' || h || chr(10)), '')"
    return f"CASE WHEN len({found}) > 0 THEN '## List of H2 Headings' || chr(10) || chr(10) " \
           f"|| {bullets} ELSE '' END"
