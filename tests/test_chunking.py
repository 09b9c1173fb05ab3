"""The chunker against a plain restatement of its rules and against its properties."""

import pathlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.split_text import (
    default_measure, encoder_measure, split_to_budget,
)
from tallyloom.functions.text import token_count
from tallyloom.operators import chunking as ch
from tallyloom.operators.calls import slabs
from tallyloom.operators.encoding import encoder_counts
from tallyloom.session import shared_dir

TOKEN = re.compile(r"[^\W_]+|[^ \t\n\x0b\f\r]")


def count(text):
    return len(TOKEN.findall(text))


def tail(text, n):
    starts = [m.start() for m in TOKEN.finditer(text)]
    return text[starts[-n:][0]:] if starts else ""


def h2_list(sections):
    found = [line.strip()[3:].strip() for s in sections for line in s.split("\n")
             if line.strip().startswith("## ")]
    return "## List of H2 Headings\n\n" + "".join(f"- {h}\n" for h in found) if found else ""


def brute_chunks(text, source, budget, overlap):
    """The same rules, one document at a time."""
    head = f"# {source}\n\n" if source else ""
    if source and not text.strip().startswith(f"# {source}"):
        text = head + text
    sections, current, fenced = [], [], False
    for line in text.split("\n"):
        if not fenced and re.match(r"[ \t]*#{1,2} ", line) and current:
            sections.append("\n".join(current).strip())
            current = []
        current.append(line)
        fenced ^= line.count("```") % 2 == 1
    sections.append("\n".join(current).strip())
    cleaned = []
    for section in sections:
        lines = section.split("\n")
        if source and lines[0].strip() == f"# {source}":
            lines = lines[1:]
            blank = next((i for i, line in enumerate(lines) if not line.strip()), None)
            if blank is not None:
                del lines[blank]
        section = "\n".join(lines).strip()
        if section:
            cleaned.append(section)

    chunks, held, used = [], [], count(head)

    def emit(prefix, body, linked=True):
        last = chunks[-1] if chunks and linked and overlap else ""
        chunks.append(prefix + (tail(last, overlap) + "\n\n" if last else "") + body)

    def flush():
        nonlocal held, used
        if held:
            listed = h2_list(held)
            emit(head + (listed + "\n\n" if listed else ""), "\n\n".join(held))
        held, used = [], count(head)

    for section in cleaned:
        size = count(section)
        if size > budget - count(head):
            flush()
            h2 = next((x.strip() for x in section.split("\n") if x.strip().startswith("## ")), "")
            rest = "\n".join(x for x in section.split("\n") if not x.strip().startswith("## "))
            listed = h2_list([section]).strip()
            prefix = head + "".join(f"{x}\n\n" for x in (listed if h2 else "", h2) if x)
            room = budget - count(head) - count(h2)
            for i, piece in enumerate(
                    split_to_budget(rest.strip(), room, overlap, default_measure())):
                emit(prefix, piece, i == 0)
        elif held and used + size + 2 > budget:
            flush()
            held, used = [section], count(head) + size
        else:
            used += size + (2 if held else 0)
            held.append(section)
    flush()
    return chunks


def random_document(rng):
    parts = []
    for _ in range(rng.randint(0, 12)):
        kind = rng.random()
        if kind < 0.35:
            parts.append(rng.choice(["## ", "# ", "### ", "  ## "]) + f"Heading {rng.randint(0, 9)}")
        elif kind < 0.45:
            parts.append("```\n# not a heading\n## nor this\n```")
        else:
            words = " ".join(rng.choice(["alpha", "béta,", "x1.", "Ω", "end."])
                             for _ in range(rng.choice([3, 10, 60])))
            parts.append(words + rng.choice(["\n", "\n\n", "\n \n"]))
    return "\n".join(parts)


@pytest.mark.parametrize("source", [None, "site.org/a"])
@pytest.mark.parametrize("budget,overlap", [(30, 5), (50, 0), (400, 20)])
def test_chunks_match_brute_force(spark, source, budget, overlap):
    rng = random.Random(budget)
    texts = [random_document(rng) for _ in range(60)]
    texts += ["", "  \n ", "## only\n", f"# {source}\nintro\n\nmore\n\nend",
              "before\n# A\n\n## B\n### C stays\ntext\n## D\n" + "long word " * 100 + "\n## E\ntail"]
    rows = [(i, t, source) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, source string").repartition(4)
    got = ch.chunk_documents(df, "id", "text", "source" if source else None, budget, overlap)
    by_doc = {}
    for r in got.orderBy("id", "chunk_index").collect():
        by_doc.setdefault(r.id, []).append(r)
    for i, text in enumerate(texts):
        expected = brute_chunks(text, source, budget, overlap)
        rows = by_doc.get(i, [])
        assert [r.chunk_text for r in rows] == expected, text
        assert [r.chunk_index for r in rows] == list(range(1, len(expected) + 1))
        assert {r.total_chunks for r in rows} <= {len(expected)}
        assert [r.token_count for r in rows] == [count(c) for c in expected]


def test_every_section_is_packed_once(spark):
    tokens = [[3, 200, 4, 5, 90, 1], [], [50], [500, 500], [40, 40, 40, 40]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id int, t array<int>")
    rows = df.select("id", "t", ch.pack_sections(F.col("t"), 100, F.lit(7)).alias("u")).collect()
    for row in rows:
        covered = [i for u in row.u for i in range(u.start, u.start + u.size)]
        assert covered == list(range(1, len(row.t) + 1))
        for u in row.u:
            inside = row.t[u.start - 1:u.start - 1 + u.size]
            assert u.oversize == (inside[0] > 93)
            assert u.oversize or sum(inside) + 2 * (len(inside) - 1) + 7 <= 100


def test_empty_documents_can_be_kept(spark):
    df = spark.createDataFrame([(1, ""), (2, "a")], "id int, text string")
    got = {r.id: r for r in ch.chunk_documents(df, "id", "text", keep_empty=True).collect()}
    assert (got[1].chunk_index, got[1].chunk_text) == (0, None)
    assert got[2].chunk_index == 1


def test_strict_budget_leaves_room_for_the_overlap(spark):
    text = "\n".join(f"## H{i}\n" + "word " * 18 for i in range(20))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    for strict in (False, True):
        chunks = ch.chunk_documents(df, "id", "text", None, 60, 20, strict_budget=strict)
        bodies = [r.chunk_text.rpartition("- H")[2].partition("\n")[2] for r in chunks.collect()]
        assert (max(count(b) for b in bodies) <= 60) == strict


@pytest.mark.parametrize("budget,overlap", [(10, 0), (10, 4), (25, 25), (2, 1)])
def test_split_pieces_cover_the_text_within_budget(budget, overlap):
    rng = random.Random(3)
    words = iter(range(10_000))
    text = "\n\n".join(
        " ".join(f"w{next(words)}" + rng.choice(["", ".", ""]) for _ in range(rng.randint(1, 60)))
        for _ in range(8))
    pieces = split_to_budget(text, budget, overlap, default_measure())
    assert all(count(p) <= budget for p in pieces)
    whole = TOKEN.findall(text)
    at = 0
    for piece in pieces:
        tokens = TOKEN.findall(piece)
        first = next(t for t in tokens if t != ".")
        start = whole.index(first) - tokens.index(first)
        assert whole[start:start + len(tokens)] == tokens
        assert at - overlap <= start <= at
        at = start + len(tokens)
    assert at == len(whole)


def test_splitter_cuts_words_only_when_it_must():
    pieces = split_to_budget("abcdefgh", 3, 0, encoder_measure(lambda: list)())
    assert "".join(pieces) == "abcdefgh" and all(len(p) <= 3 for p in pieces)


def test_a_users_encoder_counts(spark):
    df = spark.createDataFrame([(1, "## A\nabc\n## B\n" + "x" * 30)], "id int, text string")
    got = ch.chunk_documents(
        df, "id", "text", None, 20, 0, count_all=ch.encoder_count_each(lambda: list),
        load_measure=encoder_measure(lambda: list)).orderBy("chunk_index").collect()
    assert all(r.token_count == len(r.chunk_text) for r in got)
    assert "".join(r.chunk_text.rpartition("\n\n")[2] for r in got[1:]) == "x" * 30


def test_python_and_jvm_tokens_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "text", token_count(F.col("text")).alias("n")).collect()
    assert all(count(r.text) == r.n for r in docs)


def test_index_pages_reports_pages_without_text(spark):
    from tallyloom.operators.indexing import index_pages, index_rollup

    pages = spark.createDataFrame(
        [(1, "u1", "<p>hello there</p>"), (2, "u2", "<script>x</script>")],
        "page_id int, url string, html string")
    rows = index_pages(pages, lambda text, variables: text.upper())
    got = {r.page_id: r for r in rows.collect()}
    assert got[1].status == "success" and got[1].result == "# U1\n\nHELLO THERE"
    assert (got[2].chunk_index, got[2].status, got[2].error) == (0, "failed", "No content extracted")
    total = index_rollup(rows, "page_id").first()
    assert (total.total_sources, total.sources_ok, total.sources_failed) == (2, 1, 1)


def test_index_sitemap_reports_pages_that_were_not_captured(spark):
    from tallyloom.operators.indexing import index_sitemap

    urls = spark.createDataFrame([(1, "u1"), (2, "gone"), (3, "u1")], "url_index long, url string")
    pages = spark.createDataFrame([("u1", "<p>hi</p>"), ("other", "<p>x</p>")],
                                  "url string, html string")
    rows = index_sitemap(urls, pages, lambda text, variables: "{url_index}/{total_urls}".format(
        **variables))
    got = {r.url_index: (r.url, r.chunk_index, r.status, r.result, r.error) for r in rows.collect()}
    assert got == {1: ("u1", 1, "success", "1/3", None), 3: ("u1", 1, "success", "3/3", None),
                   2: ("gone", 0, "failed", None, "Page not captured")}


def test_of_a_batch_some_rows_at_a_time_are_python_objects(spark):
    columns = [pa.array(range(300)), pa.array([None, "x"] * 150)]
    some = list(slabs(columns))
    assert [len(rows) for rows in some] == [128, 128, 44]
    assert [r for rows in some for r in rows] == list(zip(*(c.to_pylist() for c in columns)))
    docs = spark.createDataFrame(
        [(k, None if k % 7 == 0 else "word " * k) for k in range(300)], "id long, text string")
    chunks = ch.chunk_documents(docs.coalesce(1), "id", "text", None, 50, 5, keep_empty=True)
    got = {(r.id, r.total_chunks > 1) for r in chunks.collect()}
    assert got == {(k, k % 7 > 0 and k > 50) for k in range(300)}


def test_encoder_counts_store_no_row_for_a_piece_of_a_text(spark):
    texts = [None, "", "  ", "a bcde, fghij 12345678", "same same same"] * 900
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    kept = pathlib.Path(re.sub("^file:/+", "/", shared_dir(spark)))
    before = {p.name for p in kept.glob("*")} if kept.exists() else set()
    counted = encoder_counts(docs, "text", lambda: lambda piece: list(piece)[::2])
    got = {r.id: r.n_tokens for r in counted.collect()}
    sizes = {None: None, "": 0, "  ": 1}
    for text in texts[3:5]:
        sizes[text] = sum(-(-len(p) // 2) for p in re.findall(r" ?[a-z]+| ?[0-9]+| ?,+| +", text))
    assert got == {k: sizes[t] for k, t in enumerate(texts)}
    made = {p.name.split("-")[0] for p in kept.glob("*")} - {n.split("-")[0] for n in before}
    assert "pieces" not in made
