"""Markdown to token-budgeted chunks.

A document is one row, and everything that happens to it is an array expression on that
row: no shuffle, no window, no explode until the finished chunks leave it. Python is
entered once, with the token counts of sections, to pack them, and the text of those that are
over budget by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.binding import let
from tallyloom.functions.split_text import MeasureText, default_measure, split_counted
from tallyloom.functions.text import SPACES, chunk_preview, last_tokens, strip, token_count
from tallyloom.operators.calls import slabs

MAX_TOKENS = 4000
OVERLAP_TOKENS = 100

CountAll = Callable[[Column], Column]


def count_each(texts: Column) -> Column:
    """Default token counts of an array of texts."""
    return F.transform(texts, token_count)


def encoder_count_each(load: Callable[[], Callable[[str], list]]) -> CountAll:
    """Token counts of an array of texts by a user's encoder, loaded once per task."""

    @F.pandas_udf("array<int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for arrays in batches:
            yield arrays.map(lambda a: None if a is None else [len(encode(t)) for t in a])

    # Keeps the optimizer from merging the call into, and repeating it in, later steps.
    return count.asNondeterministic()


def source_header(source: Column) -> Column:
    """The heading line that names the source, or an empty text."""
    named = source.isNotNull() & (source != "")
    return F.when(named, F.concat(F.lit("# "), source, F.lit("\n\n"))).otherwise(F.lit(""))


def with_source_header(text: Column, source: Column) -> Column:
    """Put the source heading before the text unless it starts with it already."""
    head = source_header(source)
    named = F.concat(F.lit("# "), source)
    present = (head == "") | F.startswith(F.ltrim(text, F.lit(SPACES)), named)
    return F.when(present, text).otherwise(F.concat(head, text))


def split_sections(text: Column) -> Column:
    """Cut before every ``#`` and ``##`` heading line outside code fences.

    The heading stays with its section; sections are stripped, empty ones left out.
    """
    fenced = F.array_join(
        F.transform(
            F.split(text, "```"),
            lambda part, i: F.when(
                i % 2 == 1, F.replace(part, F.lit("\n#"), F.lit("\n\u0001#"))
            ).otherwise(part),
        ),
        "```",
    )
    masked = F.when(F.contains(text, F.lit("```")), fenced).otherwise(text)
    cut = F.split(masked, r"\n(?=[ \t]*#{1,2} )")
    whole = F.transform(
        cut, lambda s: strip(F.replace(s, F.lit("\n\u0001#"), F.lit("\n#"))))
    return F.filter(whole, lambda s: s != "")


def drop_source_header(section: Column, source: Column) -> Column:
    """A section without the source heading and the first blank line after it."""
    first = strip(F.substring_index(section, "\n", 1))
    rest = F.when(
        F.instr(section, "\n") > 0, F.regexp_replace(section, r"^[^\n]*", "")
    ).otherwise(F.lit(""))
    tight = F.regexp_replace(rest, r"(?s)^(.*?)\n[ \t]*\n(.*)\z", "$1\n$2")
    is_header = source.isNotNull() & (source != "") & (first == F.concat(F.lit("# "), source))
    return F.when(is_header, strip(tight)).otherwise(section)


def headings(text: Column) -> Column:
    """Texts of the ``## `` heading lines."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*## (.*)$"), F.lit(1))
    return F.when(
        F.contains(text, F.lit("## ")), F.filter(F.transform(found, strip), lambda h: h != "")
    ).otherwise(F.array().cast("array<string>"))


def heading_list(texts: Column) -> Column:
    """Bullet list of the second-level headings of some sections; empty without any."""
    def bullets(found: Column) -> Column:
        lines = F.transform(found, lambda h: F.concat(F.lit("- "), h, F.lit("\n")))
        return F.when(
            F.size(found) > 0,
            F.concat(F.lit("## List of H2 Headings\n\n"), F.array_join(lines, "")),
        ).otherwise(F.lit(""))

    return let(F.flatten(F.transform(texts, headings)), bullets)


def _cuts(tokens: Sequence[int], budget: int, header: int) -> list[list[int]]:
    """(start, size, oversize) of the groups of one document."""
    out, start, used = [], 0, header

    def close(end: int) -> None:
        if end > start:
            out.append([start + 1, end - start, 0])

    for at, size in enumerate(tokens):
        if size > budget - header:
            close(at)
            out.append([at + 1, 1, 1])
            start, used = at + 1, header
        elif at > start and used + size + 2 > budget:
            close(at)
            start, used = at, header + size
        else:
            used += size + (2 if at > start else 0)
    close(len(tokens))
    return out


def pack_sections(tokens: Column, max_tokens: int, header_tokens: Column) -> Column:
    """Group consecutive sections within the budget: array of (start, size, oversize).

    ``tokens`` holds the section token counts. A section over budget by itself closes the
    current group and stands alone. A running sum that starts anew at every cut is no window,
    and a fold would copy a growing array, so the counts alone, no text, cross to Python; time
    is linear in the number of sections.
    """
    @F.pandas_udf("array<array<int>>")
    def pack(counts: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([
            None if c is None else _cuts(c.tolist(), max_tokens, int(h))
            for c, h in zip(counts, headers, strict=True)], dtype=object)

    # Keeps the optimizer from merging the call into, and repeating it in, later steps.
    return F.transform(pack.asNondeterministic()(tokens, header_tokens), lambda g: F.struct(
        g[0].alias("start"), g[1].alias("size"), (g[2] == 1).alias("oversize")))


def _split_units(units: Sequence, overlap: int, bind: MeasureText) -> list[list[tuple[str, int]]]:
    return [
        [] if u is None or u["text"] is None
        else split_counted(u["text"], u["budget"], overlap, bind)
        for u in units
    ]


def oversize_splitter(
    overlap: int, load_measure: Callable[[], MeasureText] = default_measure
) -> Callable[[Column], Column]:
    """Split the (text, budget) entries of an array; NULL entries give empty lists."""

    @F.pandas_udf("array<array<string>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bind = load_measure()
        for arrays in batches:
            yield arrays.map(lambda units: [
                [piece for piece, _ in pieces] for pieces in _split_units(units, overlap, bind)])

    # Keeps the optimizer from merging the call into, and repeating it in, later steps.
    return split.asNondeterministic()


def pack_and_split(
    tokens: Column, header_tokens: Column, oversize: Column, budget: int, overlap: int,
    load_measure: Callable[[], MeasureText] = default_measure,
) -> Column:
    """``groups`` as ``pack_sections`` cuts them, as (start, size, oversize) in whole numbers;
    ``pieces``, a list for every section, empty for those within budget; their ``counts``.

    ``oversize`` holds (text, budget) of the sections over budget and NULL for the others, or
    is NULL without any. One crossing to Python for both; of a batch some rows at a time are
    Python objects.
    """
    @F.arrow_udf("groups array<array<int>>, pieces array<array<string>>, counts array<array<int>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bind, nested = load_measure(), lambda kind: pa.list_(pa.list_(kind))
        kind = pa.struct([("groups", nested(pa.int32())), ("pieces", nested(pa.string())),
                          ("counts", nested(pa.int32()))])
        for batch in batches:
            for rows in slabs(batch):
                made = [(counts, header, [] if big is None else _split_units(big, overlap, bind))
                        for counts, header, big in rows]
                yield pa.array([{
                    "groups": None if counts is None else _cuts(counts, budget, int(header)),
                    "pieces": [[text for text, _ in pieces] for pieces in units],
                    "counts": [[size for _, size in pieces] for pieces in units],
                } for counts, header, units in made], kind)

    # Keeps the optimizer from merging the call into, and repeating it in, later steps.
    return cut.asNondeterministic()(tokens, header_tokens, oversize)


def assemble_chunks(parts: Column, overlap: int) -> Column:
    """Parts of (prefix, body, linked, tokens of the body) to chunks of (text, tokens).

    A linked part carries the last ``overlap`` tokens of the chunk before it between its
    prefix and its body. Where the body before has as many tokens they are its own, whatever
    that chunk carries itself, so every chunk is made by itself; only behind shorter bodies
    the few chunks back to a long one are gone through.
    """
    def chunk(p: Column, carried: Column) -> Column:
        return let(F.concat(p["prefix"], carried), lambda start: F.struct(
            F.concat(start, p["body"]).alias("text"),
            (token_count(start) + p["tokens"]).alias("tokens")))

    if overlap <= 0:
        return F.transform(parts, lambda p: chunk(p, F.lit("")))

    def linked(tail: Column) -> Column:
        return F.concat(last_tokens(tail, overlap), F.lit("\n\n"))

    def behind_short(ps: Column, i: Column) -> Column:
        long_ones = F.transform(
            F.slice(ps, F.lit(1), i), lambda p, k: F.when(p["tokens"] >= overlap, k))
        start = F.coalesce(F.array_max(long_ones), F.lit(0))

        def step(last: Column, p: Column) -> Column:
            return F.concat(p["prefix"], F.when(p["linked"] & (last != ""), linked(last))
                            .otherwise(F.lit("")), p["body"])

        return let(start, lambda s: F.aggregate(F.slice(ps, s + 1, i - s), F.lit(""), step))

    def carried(ps: Column, p: Column, i: Column) -> Column:
        before = F.get(ps, i - 1)
        return F.when((i == 0) | ~p["linked"], F.lit(""))\
            .when(before["tokens"] >= overlap, linked(before["body"]))\
            .otherwise(linked(behind_short(ps, i)))

    return let(parts, lambda ps: F.transform(ps, lambda p, i: chunk(p, carried(ps, p, i))))


def document_sections(text: Column, source: Column | None) -> Column:
    """The sections of a document, without the heading that names its source."""
    src = F.lit(None).cast("string") if source is None else source
    headed = let(with_source_header(text, src), lambda body: F.transform(
        split_sections(body), lambda s: drop_source_header(s, src)))
    # A text without any heading is one section.
    cleaned = F.when(F.contains(text, F.lit("#")), headed).otherwise(F.array(strip(text)))
    return F.filter(cleaned, lambda s: s != "")


def section_arrays(
    df: DataFrame, text: str, source: str | None, count_all: CountAll = count_each
) -> DataFrame:
    """Add ``__head``, ``__head_tokens``, ``__sections`` and ``__tokens`` of the document."""
    src = F.col(source) if source else None
    head = F.lit("") if src is None else source_header(src)
    sections = document_sections(F.coalesce(F.col(text), F.lit("")), src)
    if count_all is count_each:
        both = let(sections, lambda s: F.struct(s.alias("s"), count_each(s).alias("t")))
        df = df.withColumn("__both", both).withColumn("__sections", F.col("__both.s"))\
            .withColumn("__tokens", F.col("__both.t")).drop("__both")
    else:
        df = df.withColumn("__sections", sections)\
            .withColumn("__tokens", count_all(F.col("__sections")))
    return df.withColumn("__head", head).withColumn("__head_tokens", token_count(head))


HEADING_LINE = r"(?m)^[ \t]*(## [^\n]*)$"
HEADING_LINES = r"(?m)^[ \t]*## [^\n]*$\n?"


def _block(text: Column) -> Column:
    return F.when(text != "", F.concat(text, F.lit("\n\n"))).otherwise(F.lit(""))


def _second_heading(section: Column) -> Column:
    return F.when(F.contains(section, F.lit("## ")),
                  strip(F.regexp_extract(section, HEADING_LINE, 1))).otherwise(F.lit(""))


def _oversize_sections(sections: Column, tokens: Column, head_tokens: Column, budget: int) -> Column:
    """Text to be split and room for it of every section over budget; NULL without any."""
    def entry(s: Column) -> Column:
        text = F.when(F.contains(s, F.lit("## ")), strip(F.regexp_replace(s, HEADING_LINES, "")))\
            .otherwise(s)
        room = F.lit(budget) - head_tokens - token_count(_second_heading(s))
        return F.struct(text.alias("text"), room.cast("int").alias("budget"))

    over = F.transform(sections, lambda s, i: F.when(
        F.get(tokens, i) > budget - head_tokens, entry(s)))
    return F.when(F.exists(tokens, lambda n: n > budget - head_tokens), over)


def _chunk_parts(document: Column, own_counts: bool) -> Column:
    """The packed groups and split sections of a document, ready to be assembled."""
    def part(prefix: Column, body: Column, linked: Column, tokens: Column) -> Column:
        return F.struct(prefix.alias("prefix"), body.alias("body"), linked.alias("linked"),
                        tokens.cast("int").alias("tokens"))

    def split(d: Column, texts: Column, at: Column) -> Column:
        prefix = F.concat(d["head"], _block(strip(heading_list(texts))), _block(_second_heading(texts[0])))

        def counted(p: Column, j: Column) -> Column:
            return F.get(F.get(d["cut"]["counts"], at), j) if own_counts else token_count(p)

        return let(prefix, lambda x: F.transform(
            F.get(d["cut"]["pieces"], at), lambda p, j: part(x, p, j == 0, counted(p, j))))

    def whole(d: Column, texts: Column, group: Column) -> Column:
        body = F.array_join(texts, "\n\n")
        size = F.aggregate(F.slice(d["tokens"], group[0], group[1]), F.lit(0), lambda a, b: a + b) \
            if own_counts else token_count(body)
        return F.array(part(F.concat(d["head"], _block(heading_list(texts))), body, F.lit(True), size))

    return let(document, lambda d: F.flatten(F.transform(d["cut"]["groups"], lambda g: let(
        F.slice(d["sections"], g[0], g[1]), lambda texts: F.when(
            g[2] == 1, split(d, texts, g[0] - 1)).otherwise(whole(d, texts, g))))))


def chunk_documents(
    df: DataFrame,
    id_col: str,
    text: str,
    source: str | None = None,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    count_all: CountAll = count_each,
    load_measure: Callable[[], MeasureText] = default_measure,
    strict_budget: bool = False,
    keep_empty: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Chunks of every document: index, total, token count, text and preview.

    A document without any text has no chunks; ``keep_empty`` gives it a row with index 0
    and no text. Columns named in ``carry`` come along.

    Heading list and overlap come on top of ``max_tokens``; ``strict_budget`` keeps room
    for the overlap inside it. A user's encoder counts through ``count_all`` (see
    ``encoder_count_each``) and ``load_measure`` (see ``encoder_measure``); the overlap
    taken from the chunk before is measured in default tokens.
    """
    if max_tokens < 1 or not 0 <= overlap < max_tokens:
        raise ValueError("max_tokens must be positive and more than the overlap")
    budget = max_tokens - overlap if strict_budget else max_tokens
    keep = list(dict.fromkeys([id_col, *([source] if source else []), *carry]))
    rows = section_arrays(df.select(*dict.fromkeys([*keep, text])), text, source, count_all)
    # Only counts and what is over budget cross to Python.
    rows = rows.withColumn("__cut", pack_and_split(
        F.col("__tokens"), F.col("__head_tokens"),
        _oversize_sections(F.col("__sections"), F.col("__tokens"), F.col("__head_tokens"), budget),
        budget, overlap, load_measure))
    document = F.struct(*[F.col(f"__{c}").alias(c) for c in ("head", "sections", "tokens", "cut")])
    own_counts = count_all is count_each and load_measure is default_measure
    chunks = rows.select(*keep, assemble_chunks(
        _chunk_parts(document, own_counts), overlap).alias("__chunks"))
    # The outer form keeps the optimizer from testing the array, and so building it, twice.
    exploded = chunks.select(
        *keep, F.posexplode_outer(let(F.col("__chunks"), lambda c: F.transform(
            c, lambda t: F.struct(t["text"].alias("text"), t["tokens"].alias("tokens"),
                                  F.size(c).alias("total")))
        )).alias("__pos", "__chunk"))
    if not keep_empty:
        exploded = exploded.where(F.col("__pos").isNotNull())
    return exploded.select(
        *keep,
        F.coalesce(F.col("__pos") + 1, F.lit(0)).alias("chunk_index"),
        F.coalesce("__chunk.total", F.lit(0)).alias("total_chunks"),
        (F.col("__chunk.tokens") if count_all is count_each
         else count_all(F.array("__chunk.text"))[0]).alias("token_count"),
        F.col("__chunk.text").alias("chunk_text"),
        chunk_preview(F.col("__chunk.text")).alias("chunk_preview"),
    )


def with_provenance(chunks: DataFrame, kind: str, **extra: str) -> DataFrame:
    """Variables that tell the row function where a chunk comes from.

    ``extra`` maps a variable to the column it is taken from.
    """
    pairs = {"chunk_index": "chunk_index", "total_chunks": "total_chunks",
             "token_count": "token_count", **extra}
    entries = [x for name, column in pairs.items()
               for x in (F.lit(name), F.col(column).cast("string"))]
    return chunks.withColumn(
        "variables", F.create_map(*entries, F.lit("source"), F.lit(kind)))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint")
    return chunks.agg(F.count("*").alias("chunks"), total.alias("total_tokens")).withColumn(
        "avg_tokens",
        F.when(F.col("chunks") > 0, F.floor(F.col("total_tokens") / F.col("chunks")))
        .otherwise(F.lit(0)).cast("bigint"),
    )
