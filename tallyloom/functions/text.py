"""Text expressions. Everything here stays in the JVM unless an encoder is supplied."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial
from html.entities import name2codepoint
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.binding import let

# One token is a run of letters and digits, or one other visible character.
TOKEN = r"(?:[\p{L}\p{N}]+|\S)"
TOKEN_AND_GAP = TOKEN + r"\s*"
# Fixed value: all white space characters.
SPACES = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends.

    A trim looks at the ends only, where a pattern would run over the whole text.
    """
    return F.btrim(text, F.lit(SPACES))


def token_count(text: Column) -> Column:
    """Default token counter."""
    return F.regexp_count(text, F.lit(TOKEN))


def last_tokens(text: Column, n: int) -> Column:
    """The last ``n`` tokens with the gaps between and after them, verbatim.

    Looked for in the end of the text; in all of it only where that holds too few.
    """
    def pieces(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(TOKEN_AND_GAP), F.lit(0))

    def kept(found: Column) -> Column:
        return F.array_join(
            F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), F.lit(n)), "")

    # A token that the cut splits is before the last n if there are more than n.
    return let(text, lambda t: let(pieces(F.right(t, F.lit(12 * n))), lambda near: F.when(
        F.size(near) > n, kept(near)).otherwise(let(pieces(t), kept))))


def encoder_token_count(load: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """A token counter around a user's encoder.

    ``load`` runs once per Python task and returns ``encode(text) -> tokens``.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encode(t))).astype("Int32")

    return count


def chunk_preview(text: Column) -> Column:
    """The one-line look at a chunk that result tables carry beside it."""
    return F.translate(F.substring(text, 1, 100), "\n", " ")


def result_preview(text: Column) -> Column:
    """A result shortened to 200 characters, marked when it was longer."""
    return F.when(F.char_length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("...")))\
        .otherwise(text)


def site_name(url: Column) -> Column:
    """The authority part of a URL with dots turned to underscores."""
    return F.replace(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("."), F.lit("_"))


def plain_message(text: Column) -> Column:
    """Message HTML to plain text; entities are undone one after another, ``&amp;`` last."""
    plain = F.regexp_replace(text, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return strip(plain)


def clean_message(text: Column) -> Column:
    """Plain text of a message, with a marker where nothing is left."""
    return let(plain_message(text), lambda plain: F.when(
        plain == "", F.lit("[Empty message]")).otherwise(plain))


def format_executed(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` of an ISO text as written, whatever its offset.

    Text that is no ISO date and time keeps its first 19 characters; missing is ``N/A``.
    """
    wall = F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{2})$", "")
    iso = wall.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    moment = F.when(iso, wall.try_cast("timestamp_ntz"))
    return F.when(value.isNull() | (value == ""), F.lit("N/A")).otherwise(
        F.coalesce(F.date_format(moment, "yyyy-MM-dd HH:mm"), F.substring(value, 1, 19))
    )


# HTML to markdown. Steps are applied top to bottom, their rules one after another; a
# step with tags is for pages that have one of them. A tag is what has a letter, a slash or a mark
# after its ``<``.
NO_TEXT = r"(?is)<(?:!--.*?--|head[ >].*?</head|script[ >].*?</script|style[ >].*?</style)>"
LINE_SPACES = ("\t", "\r", "\n")
TAG_STEPS: list[tuple[str, list[tuple[str, str]]]] = [
    ("", [("(?i)<h1[^>]*>", "\n\n# ")]),
    ("h2 h3 h4 h5 h6", [
        (f"(?i)<h{n}[^>]*>", "\n\n" + "#" * n + " ") for n in range(2, 7)]),
    ("/b /strong", [(r"(?i)<(?:b|strong)(?: [^>]*)?>(.*?)</(?:b|strong)>", "**$1**")]),
    ("/i /em", [(r"(?i)<(?:i|em)(?: [^>]*)?>(.*?)</(?:i|em)>", "_$1_")]),
    ("", [
        (r"(?i)<li(?: [^>]*)?>", "\n* "),
        (r"(?i)<br[^>]*>", "\n"),
        (r"(?i)<(?:/h[1-6]|/?(?:p|div|ul|ol|table|tr|article|section|footer|blockquote)(?: [^>]*)?)>",
         "\n\n"),
    ]),
    ("img", [
        (r"""(?i)<img [^>]*alt=(?:"([^"]*)"|'([^']*)')[^>]*src=(?:"([^"]*)"|'([^']*)')[^>]*>""",
         "![$1$2]($3$4)"),
        (r"""(?i)<img [^>]*src=(?:"([^"]*)"|'([^']*)')[^>]*alt=(?:"([^"]*)"|'([^']*)')[^>]*>""",
         "![$3$4]($1$2)"),
        (r"""(?i)<img [^>]*src=(?:"([^"]*)"|'([^']*)')[^>]*>""", "![]($1$2)"),
    ]),
    ("/a", [(r"""(?i)<a [^>]*href=(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a>""", "[$3]($1$2)")]),
]
ANY_TAG = r"</?[a-zA-Z][^>]*>|<[!?][^>]*>"
TAG_NAME = r"<(/?[a-zA-Z][a-zA-Z0-9]*)"

# Characters that are written in ASCII. Lower-case vowels lose their accents.
PLAIN_CHARACTERS = {
    "nbsp": " ", "lsquo": "'", "rsquo": "'", "ldquo": '"', "rdquo": '"', "copy": "(C)",
    "mdash": "--", "ndash": "-", "rarr": "->", "larr": "<-", "middot": "*", "oelig": "oe",
    "aelig": "ae", "lrm": "", "rlm": "",
}
LINE, SPACE = "\u0003", "\u0004"


def _character_text(name: str, code: int) -> str:
    if name in PLAIN_CHARACTERS:
        return PLAIN_CHARACTERS[name]
    parts = normalize("NFD", chr(code))
    return parts[0] if len(parts) == 2 and parts[0] in "aeiou" else chr(code)


#: What stands for a character, by its entity's name and by its number.
CHARACTERS = {key: _character_text(name, code) for name, code in name2codepoint.items()
              for key in (name, f"#{code}")} | {"apos": "'"}


def undo_entities(text: Column) -> Column:
    """Named and numeric character references to text, once; what names nothing stays."""
    known = F.from_json(F.lit(json.dumps(CHARACTERS)), "map<string,string>")

    def character(ref: Column) -> Column:
        code = F.when(F.startswith(F.lower(ref), F.lit("#x")), F.conv(F.substr(ref, F.lit(3)), 16, 10))\
            .when(F.startswith(ref, F.lit("#")), F.substr(ref, F.lit(2))).cast("long")

        def of(c: Column) -> Column:
            key = F.when(c.isNull(), ref).otherwise(F.concat(F.lit("#"), c.cast("string")))
            valid = c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF)
            coded = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))\
                .when(c.isNotNull(), F.lit("�"))
            return F.coalesce(F.try_element_at(known, key), coded)

        return let(code, of)

    def part(p: Column, i: Column) -> Column:
        ref = F.regexp_extract(
            p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        done = let(ref, lambda r: F.when(r != "", F.concat(
            character(r), F.substr(p, F.char_length(r) + 2))))
        return F.when(i == 0, p).otherwise(F.coalesce(done, F.concat(F.lit("&"), p)))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(
        F.transform(F.split(t, "&"), part), "")).otherwise(t))


def _inside(text: Column, tag: str, change: Callable[[Column], Column]) -> Column:
    """Rewrite what lies between ``<tag>`` and the next ``</tag>`` or the end."""
    def part(p: Column, i: Column) -> Column:
        inner = F.regexp_replace(p, f"(?is)</{tag}>.*", "")
        return F.when(i == 0, p).otherwise(let(inner, lambda x: F.concat(
            F.lit(f"<{tag}>"), change(x), F.substr(p, F.char_length(x) + 1))))

    return F.array_join(F.transform(F.split(text, f"(?i)<{tag}(?: [^>]*)?>"), part), "")


def _keep_lines(code: Column) -> Column:
    """Lines and spaces of preformatted text as marks, in a block indented by four spaces."""
    lines = F.regexp_replace(F.regexp_replace(code, r"^\r?\n|\s+\z", ""), r"\r?\n", LINE + SPACE * 4)
    return F.concat(F.lit("<p>" + SPACE * 4), F.translate(lines, " \t", SPACE * 2), F.lit("</p>"))


def _numbered(items: Column) -> Column:
    return F.array_join(F.transform(F.split(items, r"(?i)<li(?: [^>]*)?>"), lambda x, i: F.when(
        i == 0, x).otherwise(F.concat(F.lit("\n"), i.cast("string"), F.lit(". "), x))), "")


def tight(text: Column) -> Column:
    """One space for many, none beside a line feed, and two line feeds at most in a row."""
    def few(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)

    lines = F.array_join(F.transform(F.split(let(text, few), "\n"), lambda x: F.trim(x)), "\n")
    return F.regexp_replace(lines, r"\n{3,}", "\n\n")


def html_to_markdown(html: Column) -> Column:
    """Markdown text of a page, no line wrapping.

    Links, images, bold, italics, lists and preformatted lines are kept; items of an ordered
    list are numbered, and one inside another numbers on. Tags left open mark nothing. One pass
    finds which tags a page has; costly rules whose tags it lacks are not run over it.
    """
    def converted(page: Column, names: Column) -> Column:
        def where(tags: str, text: Column, change: Callable[[Column], Column]) -> Column:
            has = F.arrays_overlap(names, F.split(F.lit(tags), " "))
            return let(text, lambda t: F.when(has, change(t)).otherwise(t))

        text = where("pre", page, lambda t: _inside(t, "pre", _keep_lines))
        text = F.regexp_replace(text, NO_TEXT, "")
        for character in LINE_SPACES:
            text = F.replace(text, F.lit(character), F.lit(" "))
        text = where("ol", text, lambda t: _inside(t, "ol", _numbered))
        for tags, rules in TAG_STEPS:
            change = partial(_apply_rules, rules=rules)
            text = where(tags, text, change) if tags else change(text)
        text = tight(undo_entities(F.regexp_replace(text, ANY_TAG, "")))
        return F.translate(strip(text), LINE + SPACE, "\n ")

    found = F.regexp_extract_all(html, F.lit(TAG_NAME), F.lit(1))
    # The names once each, lower-cased after that: a page repeats few of them many times.
    names = F.transform(F.array_distinct(found), F.lower)
    return let(F.struct(html.alias("page"), names.alias("names")),
               lambda both: converted(both["page"], both["names"]))


def _apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text
