import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions import verdicts as vd
from tallyloom.functions.numbers import safe_double
from tallyloom.operators.outcomes import parse_verdict


def apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_removes_every_kind_of_space(spark):
    assert apply(spark, tx.strip, ["\t a b\n  ", " ", None]) == ["a b", "", None]


def test_clean_message_undoes_entities_in_order(spark):
    cases = ["<p>a&nbsp;b</p>", "&amp;lt;", "&lt;b&gt;", "<br>", " x < y "]
    assert apply(spark, tx.clean_message, cases) == [
        "a b", "&lt;", "<b>", "[Empty message]", "x < y"]


def test_format_executed(spark):
    cases = ["2024-03-01T10:20:30Z", "2024-03-01T10:20:30.123+02:00", "2024-03-01", "soon enough, "
             "but not yet", "2024-13-01T10:20:30", None, ""]
    assert apply(spark, tx.format_executed, cases) == [
        "2024-03-01 10:20", "2024-03-01 10:20", "2024-03-01 00:00", "soon enough, but no",
        "2024-13-01T10:20:30", "N/A", "N/A"]


def test_site_name_keeps_user_and_port(spark):
    cases = ["https://a.b.com/x", "http://u@a.b:80/x?y=1"]
    assert apply(spark, tx.site_name, cases) == ["a_b_com", "u@a_b:80"]


def test_safe_double(spark):
    cases = ["8", " 8.5 ", "1e3", "8d", "nan", "inf", "", ".5", "5.", "-2", None]
    assert apply(spark, safe_double, cases) == [
        8.0, 8.5, 1000.0, None, None, None, None, 0.5, 5.0, -2.0, None]


def test_result_preview_marks_long_text(spark):
    assert apply(spark, tx.result_preview, ["a" * 200, "b" * 201]) == [
        "a" * 200, "b" * 200 + "..."]


def test_chunk_preview_is_one_line(spark):
    assert apply(spark, tx.chunk_preview, ["a\nb" + "c" * 200]) == ["a b" + "c" * 97]


def test_tokens(spark):
    assert apply(spark, tx.token_count, ["Hé llo, x1.\n", ""]) == [5, 0]
    last = lambda c: tx.last_tokens(c, 2)
    assert apply(spark, last, ["one, two\nthree ", "x", ""]) == ["two\nthree ", "x", ""]


def test_html_to_markdown(spark):
    html = ('<html><head><title>no</title></head><body><script>x()</script><h1>T</h1>'
            '<p>See <a class="q" href="/u">the <b>page</b></a>.<br>Next</p><!-- c -->'
            '<img src="i.png" alt="pic"><ul><li>one<li>two</ul>&lt;ok&gt; &amp;amp;</body></html>')
    assert apply(spark, tx.html_to_markdown, [html]) == [
        "# T\n\nSee [the **page**](/u).\nNext\n\n![pic](i.png)\n\n* one\n* two\n\n<ok> &amp;"]


@pytest.mark.parametrize("html,expected", [
    ("&mdash; &#8217; &hellip; &eacute; &#xE9; &#x41; &Eacute;", "-- ' \u2026 e e A \u00c9"),
    ("&nothing; &#0; a & b &amp;lt;", "&nothing; \ufffd a & b &lt;"),
    ("<a class=x href='http://x'>t</a> <img src='i.png' alt='p'>", "[t](http://x) ![p](i.png)"),
    ("5 < 6 and 7 > 3", "5 < 6 and 7 > 3"),
    ("<ol><li>one<li class=a>two</ol><ul><li>x</ul>", "1. one\n2. two\n\n* x"),
    ("<strong>bold</strong> and <em>it</em>, <b>open", "**bold** and _it_, open"),
    ("<p>a</p><pre>\nx = 1\n  y  = &lt;2\n</pre><p>b</p>", "a\n\n    x = 1\n      y  = <2\n\nb"),
    ("<ol><li>one", "1. one"),
    ("", ""),
])
def test_html_rules(spark, html, expected):
    assert apply(spark, tx.html_to_markdown, [html]) == [expected]


def payload(*parts):
    return json.dumps({"outputs": [{"outputs": [
        {"results": {"message": {"result": p}}} for p in parts]}]})


def test_extract_output(spark):
    cases = [payload("```json\n{1}\n```", " two "), payload("```\n```", " "), payload(),
             "no json"]
    assert apply(spark, vd.extract_output, cases) == ["{1}\ntwo", "NOCONTENT", "NOCONTENT", None]


@pytest.mark.parametrize("text,expected", [
    ('{"total_rating": 8, "reasoning": "r", "correctness": "Correct", "x": {"y": 1}}',
     ("8", "Correct", "r", {"x": '{"y":1}'}, None)),
    ("{}", ("0", "Unknown", "No reasoning provided", {}, None)),
    ('{"total_rating": null}', (None, "Unknown", "No reasoning provided", {}, None)),
    ("{broken", ("0", "Error", "Error parsing judge result", None, "Error parsing judge result")),
    ("[1]", ("0", "Error", "Error parsing judge result", None, "Error parsing judge result")),
])
def test_parse_verdict(spark, text, expected):
    row = parse_verdict(spark.createDataFrame([(text,)], "verdict string")).first()
    assert (row.judge_score, row.judge_correctness, row.judge_reasoning, row.extras,
            row.error) == expected


def test_normalise_correctness(spark):
    assert apply(spark, vd.normalise_correctness, ["1", "CORRECT", "false", None]) == [
        "Correct", "Unknown", "Incorrect", "Unknown"]


def test_an_encoder_sees_every_distinct_piece_once(spark, tmp_path):
    import re
    import uuid

    from tallyloom.operators.encoding import encoder_counts

    folder = str(tmp_path)

    def encode(piece):
        return re.findall(r"[aeiou]|[^aeiou]+", piece)

    def load():
        def noted(piece):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(piece)
            return encode(piece)
        return noted

    texts = ["one two three two", "two  two!", "", None, " naïve 42,000 one\n", "two" * 50]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id long, t string, n_tokens0 int")
    got = {r.id: r.n_tokens for r in encoder_counts(df, "t", load, r" ?[a-zï]+| ?[0-9]+|[^\sa-zï0-9]+|\s+").collect()}
    pieces = [re.findall(r" ?[a-zï]+| ?[0-9]+|[^\sa-zï0-9]+|\s+", t) if t is not None else None for t in texts]
    assert got == {i: None if p is None else sum(len(encode(x)) for x in p) for i, p in enumerate(pieces)}
    seen = [f.read_text() for f in tmp_path.iterdir()]
    assert sorted(seen) == sorted({x for p in pieces for x in p or []})
    assert encoder_counts(df.where("false"), "t", load).collect() == []
