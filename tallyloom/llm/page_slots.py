"""Main text of web pages by equivalence-class template deduction.

Pages of one host are made from a template. A token is an element with all that stands around
it, or a text with its element. Tokens that occur equally often on every page of a host share
an occurrence vector and form an equivalence class. Classes found on enough pages, whose tokens
hang together under one place, are valid; they nest by that place into the host's template. What
is left on a page are the slots between template elements. Slots are judged by what all pages
of the host put into them, and the main slots' text is extracted.

Occurrence vectors are folded to 64 bits while they are counted, so pages, however many a host
has, never meet; only a host's template, bounded by the size of a page, is gathered.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import markup
from tallyloom.llm.markup import Page
from tallyloom.session import durable

#: Share of a host's pages that a template token is found on, and one that is the same text.
SUPPORT, CONSTANT, CONSTANT_PAGES = 0.1, 0.5, 3
#: A container of this share of a page's good text holds the main text. An article of which the
#: template holds as much is a copy.
DOMINANT = 0.66
TOKENS = ("host long, token long, parent long, is_text boolean, vector long, pages long, "
          "chars long, links long")
CACHED_HOSTS = 512


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(
        url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def unwanted(page: Page, by_words: bool = True) -> list[bool]:
    """Per element: it is, or stands in, what holds no main text by its name.

    Class names do not count on elements that hold an article. Of a header inside an article
    the headings are kept.
    """
    holds = [False] * len(page.elements)
    for i in range(len(page.elements) - 1, 0, -1):
        e = page.elements[i]
        if holds[i] or e.tag in ("article", "main") or e.role in ("article", "main"):
            holds[e.parent] = True
    out, article, headed = [False], [False], [False]
    for i, e in enumerate(page.elements[1:], 1):
        inside = article[e.parent]
        own = e.tag in ("article", "main") or e.role in ("article", "main")
        article.append(inside or own)
        named = bool(by_words and not holds[i] and e.tag not in ("html", "body", "main")
                     and e.words & markup.NOT_TEXT_WORDS)
        if e.tag == "header" and inside and not named:
            headed.append(True)
            out.append(out[e.parent])
            continue
        headed.append(headed[e.parent] and e.tag not in markup.HEADINGS)
        out.append(out[e.parent] or e.unseen or named or e.tag in markup.NOT_TEXT
                   or e.role in markup.NOT_TEXT_ROLES)
    return [o or h for o, h in zip(out, headed, strict=True)]


def marked(page: Page, dropped: list[bool]) -> list[int]:
    """The outermost elements whose names say that they hold the article.

    Article elements first, then what names of articles' bodies say, then main elements. Of
    several the one that holds most of their text, if one does, else all.
    """
    for says in (
        lambda e: e.tag == "article" or e.role == "article",
        lambda e: e.itemprop == "articlebody" or bool(e.words & markup.MAIN_WORDS),
        lambda e: e.tag == "main" or e.role == "main",
    ):
        owner = [-1]
        for i, e in enumerate(page.elements[1:], 1):
            above = owner[e.parent]
            owner.append(above if above >= 0 or dropped[i] or not says(e) else i)
        size: Counter[int] = Counter()
        for at, _, _, text in page.texts:
            if owner[at] >= 0 and not dropped[at] and (n := len(text.strip())):
                size[owner[at]] += n
        if size:
            top, most = max(size.items(), key=lambda kv: (kv[1], -kv[0]))
            return [top] if 2 * most > sum(size.values()) else sorted(size)
    return []


def blocks(page: Page, chosen: list[bool]) -> Iterator[tuple[int, str, int, int]]:
    """(element, text, characters, those in links) of every block with text in chosen elements."""
    at, number, parts, links = 0, -1, [], 0
    for where, block, linked, text in [*page.texts, (0, -2, False, "")]:
        if block != number:
            joined = " ".join("".join(parts).split())
            if joined:
                yield at, joined, len(joined), min(links, len(joined))
            number, parts, links = block, [], 0
        if block >= 0 and chosen[where]:
            if not parts:
                at = where
            parts.append(text)
            links += len(text.strip()) if linked else 0


def text_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path} {text}", 1) >> 1


def page_tokens(page: Page) -> dict[int, list]:
    """Token: [parent, is a text, occurrences, characters, those in links].

    Characters are those directly in the element, of wanted texts.
    """
    out: dict[int, list] = {}
    for e in page.elements:
        above = page.elements[e.parent].path if e.parent >= 0 else -1
        out.setdefault(e.path, [above, False, 0, 0, 0])[2] += 1
    for at, text, chars, links in blocks(page, [not d for d in unwanted(page)]):
        path = page.elements[at].path
        out[path][3] += chars
        out[path][4] += links
        found = out.setdefault(text_token(path, text), [path, True, 0, 0, 0])
        found[2] += 1
        found[3] += chars
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a task's pages, counted by host and folded into occurrence vectors."""
    fields = [f.split() for f in TOKENS.split(", ")]
    held: dict[tuple[int, int], list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(host, token, *v) for (host, token), v in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(column, pa.bool_() if kind == "boolean" else pa.int64())
             for column, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)],
            [name for name, _ in fields])

    for batch in batches:
        for key, host, source in zip(*[batch.column(c).to_pylist() for c in ("key", "host", "html")],
                                     strict=True):
            for token, (parent, is_text, n, chars, links) in page_tokens(markup.parse(source)).items():
                vector = xxhash.xxh64_intdigest(f"{key} {n}") - (1 << 63)
                found = held.get((host, token))
                if found is None:
                    held[host, token] = [parent, is_text, vector, 1, chars, links]
                else:
                    found[2] ^= vector
                    found[3] += 1
                    found[4] += chars
                    found[5] += links
            if len(held) > 200_000:
                yield flush()
    if held:
        yield flush()


def template(rows: list[dict]) -> tuple[dict[int, int], set[int]]:
    """Template elements with the good characters their slots hold on all pages; constant texts.

    Tokens of one occurrence vector that hang together form a class; a class of two or more is
    valid. A class nests in the one around the place it hangs from. A slot is good but for its
    constant texts, and not at all if it's mostly links.
    """
    known = {r["token"]: r for r in rows}
    root: dict[int, int] = {}

    def top(token: int) -> int:
        path = []
        while token not in root:
            path.append(token)
            r, above = known[token], known.get(known[token]["parent"])
            if above is None or (above["vector"], above["pages"]) != (r["vector"], r["pages"]):
                root[token] = token
            else:
                token = above["token"]
        for t in path:
            root[t] = root[token]
        return root[token]

    size = Counter(top(t) for t in known)
    elements = {t for t, r in known.items() if not r["is_text"] and size[root[t]] > 1} | {0}

    def slot(token: int) -> int:
        while token not in elements:
            above = known.get(token)
            if above is None:
                return 0
            token = above["parent"]
        return token

    chars: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for t, r in known.items():
        found = chars[slot(r["parent"] if r["is_text"] else t)]
        if r["is_text"]:
            found[2] += r["chars"]
        else:
            found[0] += r["chars"]
            found[1] += r["links"]
    good = dict.fromkeys(elements, 0)
    for t, (total, links, constant) in chars.items():
        worth = max(total - constant, 0) if 2 * links <= total else 0
        while True:
            good[t] += worth
            if t not in known or known[t]["parent"] not in known:
                break
            t = slot(known[t]["parent"])
    return good, {t for t, r in known.items() if r["is_text"]}


def _templates(table: pa.Table) -> pa.Table:
    good, constant = template(table.to_pylist())
    return pa.table({
        "host": pa.array([table.column("host")[0].as_py()], pa.int64()),
        "elements": pa.array([list(good)], pa.list_(pa.int64())),
        "good": pa.array([list(good.values())], pa.list_(pa.int64())),
        "constant": pa.array([sorted(constant)], pa.list_(pa.int64())),
    })


def deduce(pages: DataFrame) -> DataFrame:
    """``host, elements, good, constant``: the template of every host of ``key, host, html``.

    A host's row holds tokens found on a tenth of its pages or more, so at most ten times as
    many as a page has on average.
    """
    counted = durable(
        pages.mapInArrow(_tokens, TOKENS).groupBy("host", "token").agg(
            F.first("parent").alias("parent"), F.first("is_text").alias("is_text"),
            F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"),
            F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        ).where(f"NOT is_text OR pages >= {CONSTANT_PAGES}"), "tokens")
    hosts = counted.where("token = 0").select("host", F.col("pages").alias("all"))
    common = counted.join(hosts, "host").where(
        F.col("pages") >= F.col("all") * F.when(F.col("is_text"), CONSTANT).otherwise(SUPPORT))
    return durable(common.groupBy("host").applyInArrow(
        _templates, "host long, elements array<long>, good array<long>, constant array<long>"),
        "templates")


def main_text(page: Page, good: dict[int, int], constant: set[int]) -> str:
    """The text of a page's main slots; see ``extract``."""
    for by_words in (True, False):
        dropped = unwanted(page, by_words)
        article = set(marked(page, dropped))
        chosen = article or {_container(page, good, dropped)}
        inside = [False] * len(page.elements)
        for i, e in enumerate(page.elements):
            inside[i] = i in chosen or (i > 0 and inside[e.parent])
        found = list(blocks(page, [a and not d for a, d in zip(inside, dropped, strict=True)]))
        poor = _link_slots(page, good, article, found) if article else set()
        texts = [text for at, text, _, _ in found if at not in poor
                 and not (constant and text_token(page.elements[at].path, text) in constant)]
        whole = sum(chars for _, _, chars, _ in found)
        if article and sum(map(len, texts)) <= (1 - DOMINANT) * whole:
            texts = [text for _, text, _, _ in found]  # a copy of other pages
        if texts:
            return "\n".join(texts)
    return ""


def _link_slots(page: Page, good: dict[int, int], article: set[int], found: list[tuple]) -> set[int]:
    """Elements in an article's slots, other than blocks of text, that hold no good text.

    What the host's template says of a slot is asked of the page as well, as its text may stand in
    elements too rare for the template.
    """
    held = [[0, 0] for _ in page.elements]
    for at, _, chars, links in found:
        held[at][0] += chars
        held[at][1] += links
    for i in range(len(page.elements) - 1, 0, -1):
        above = held[page.elements[i].parent]
        above[0] += held[i][0]
        above[1] += held[i][1]
    poor: set[int] = set()
    below = [False] * len(page.elements)
    for i, e in enumerate(page.elements[1:], 1):
        below[i] = e.parent in article or below[e.parent]
        if below[i] and (e.parent in poor or (
                e.tag not in markup.TEXT_BLOCKS and good.get(e.path) == 0
                and 2 * held[i][1] > held[i][0])):
            poor.add(i)
    return poor


def _container(page: Page, good: dict[int, int], dropped: list[bool]) -> int:
    """The innermost element, other than a block of text, that holds most of the good slots."""
    inner: dict[int, list[int]] = defaultdict(list)
    for i, e in enumerate(page.elements[1:], 1):
        inner[e.parent].append(i)
    at = 0
    while True:
        worth = good.get(page.elements[at].path, 0)
        following = [i for i in inner[at] if not dropped[i]
                     and page.elements[i].tag not in markup.TEXT_BLOCKS
                     and good.get(page.elements[i].path, 0) > DOMINANT * worth]
        paths = {page.elements[i].path for i in following}
        if worth <= 0 or len(following) != 1 or len(paths) != 1:
            return at
        at = following[0]


def _extracted(columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[dict[int, int], set[int]]] = {}
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                host = batch.column("host")[i].as_py()
                if host not in known:
                    if len(known) >= CACHED_HOSTS:
                        known.clear()
                    elements, good, constant = (
                        batch.column(c)[i].as_py() or [] for c in ("elements", "good", "constant"))
                    known[host] = dict(zip(elements, good, strict=True)), set(constant)
                texts.append(main_text(markup.parse(batch.column("html")[i].as_py()), *known[host]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], [*columns, "text", "n_chars"])
    return run


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``id_col, url_col, text, n_chars``: the main text of every page.

    Pages are grouped by the host of their address; without one they form a group too. Texts in
    elements whose tag, role or class says menu, header, footer, sidebar, notice, advert, form,
    script, comment or the like are left out. The main text is what stands in the article that
    the page marks; without a mark, in the innermost container of the host's good slots. Texts that
    half of the host's pages (three at least) have in the same place are left out, and so are
    an article's slots of links; an article that would lose two thirds of its text by it is a
    copy and is kept whole. A header inside an article keeps its headings.

    Character references are decoded, white space (any Unicode, also of a line break element)
    inside a block becomes one space, blocks are joined by a line feed. A null or empty page, or
    one without main text, gives an empty text. Repeated rows each get a row. Other columns,
    whatever their names, are left alone; an empty table gives an empty one.
    """
    schema = T.StructType([
        pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType())])
    read = pages.select(
        F.col(id_col).alias("__id"), F.col(url_col).alias("__url"),
        F.xxhash64(host_of(F.col(url_col))).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    templates = deduce(read.select(F.monotonically_increasing_id().alias("key"), "host", "html"))
    out = read.join(templates, "host", "left").select(
        "__id", "__url", "host", "html", "elements", "good", "constant").mapInArrow(
        _extracted(["__id", "__url"]), T.StructType([
            T.StructField("__id", schema[id_col].dataType), T.StructField("__url", schema[url_col].dataType),
            *schema.fields[2:]]))
    return out.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), "text", "n_chars")
