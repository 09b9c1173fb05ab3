import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import inputs
from tallyloom.sinks import tables as sinks
from tallyloom.sources import tables as sources
from tallyloom.streaming.jobs import settings


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_eval_csv(spark, tmp_path):
    good = put(tmp_path / "a.csv", 'flow_input,expected_output,x\n"2+2?",4,\n"a\n""b""",c,d\n')
    rows = sources.read_eval_csv(spark, good).collect()
    assert [tuple(r) for r in rows] == [("2+2?", "4", None), ('a\n"b"', "c", "d")]
    bad = put(tmp_path / "b.csv", "query,answer\n1,2\n")
    with pytest.raises(ValueError, match="expected_output"):
        sources.read_eval_csv(spark, bad)


@pytest.mark.parametrize("line,expected", [
    ("a,b,c", ","), ("a;b", ";"), ("a\tb\tc;d", "\t"), ("a,b;c", ","), ("a;b\tc", ";"),
    ("alone", ";"), ("", ";")])
def test_delimiter(spark, tmp_path, line, expected):
    assert sources.detect_delimiter(spark, put(tmp_path / "f.csv", line + "\nx,y,z\n")) == expected


def test_batch_csv_numbers_rows_before_dropping_blanks(spark, tmp_path):
    path = put(tmp_path / "b.csv", 'flow_input;filename;flow_variable\n'
               ' one ; a.txt ;{"k": 1, "n": {"m": 2}}\n  ;b.txt;\ntwo;;"[1]"\nthree;c.txt;\n')
    rows = sources.read_batch_csv(spark, path).orderBy("input_index").collect()
    assert [tuple(r) for r in rows] == [
        (0, "one", "a.txt", {"k": "1", "n": '{"m":2}'}), (2, "two", None, None),
        (3, "three", "c.txt", None)]


def test_batch_csv_names_the_row_with_broken_json(spark, tmp_path):
    path = put(tmp_path / "b.csv", "flow_input,flow_variable\nok,{}\nbad one,{oops\n")
    with pytest.raises(Exception, match="row 1 with flow_input bad one"):
        sources.read_batch_csv(spark, path).collect()


def test_batch_csv_needs_its_input_column(spark, tmp_path):
    with pytest.raises(ValueError, match="flow_input"):
        sources.read_batch_csv(spark, put(tmp_path / "b.csv", "a,b\n1,2\n"))


def test_positions_run_over_files_in_path_order(spark, tmp_path):
    for name, words in (("2.txt", "c d e"), ("1.txt", "a b"), ("3.txt", "f")):
        put(tmp_path / name, "\n".join(words.split()) + "\n")
    df = sources.with_file_positions(spark.read.text(str(tmp_path)))
    assert [r.value for r in df.orderBy("input_index").collect()] == list("abcdef")
    assert [r.input_index for r in df.orderBy("input_index").collect()] == list(range(6))


def test_positions_within_a_file_that_is_split(spark, tmp_path):
    path = put(tmp_path / "big.txt", "".join(f"{i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = sources.with_file_positions(spark.read.text(path))
        assert df.where(F.col("value").cast("long") != F.col("input_index")).count() == 0
        assert df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def csv_text(rows, newline, quote_all=False):
    import csv
    import io

    out = io.StringIO()
    csv.writer(out, lineterminator=newline, quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL)\
        .writerows(rows)
    return out.getvalue()


def records_of(seed, n):
    """Cells with line breaks, empty lines, quotes and delimiters; some are long."""
    import random

    rng = random.Random(seed)
    pieces = ["a", "b c", ",", "\n", "\n\n", '"', '""', "x,y", " ", "é", "end\n", '\n"', "z" * 90]
    return [[str(i)] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(3)]
            for i in range(n)]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [64, 333, 5000])
def test_one_file_read_by_several_tasks(spark, tmp_path, newline, size):
    rows = records_of(size, 300)
    text = csv_text([["n", "with space", "`tick", "d.e"], *rows], newline)
    path = put_bytes(tmp_path / "one.csv", text)
    options = dict(header=True, quote='"', escape='"', multiLine=True)
    expected = [tuple(r) for r in spark.read.options(**options).csv(path).collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = sources.read_csv(spark, path, index="i")
        splits = spark.read.text(path).rdd.getNumPartitions()
        got = df.orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 2 and len(expected) == 300
    assert df.columns == ["i", "n", "with space", "`tick", "d.e"]
    assert [tuple(r)[1:] for r in got] == expected and [r.i for r in got] == list(range(300))


def put_bytes(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_records_of_odd_files(spark, tmp_path):
    """Files without a last line break, with empty lines, headers alone, a byte order mark."""
    texts = {"a.csv": '\ufeffk,v\n1,"x\n\ny"\n\n2,z', "b.csv": "k,v\n", "c.csv": "k,v\n\n\n3\n4,5,6\n",
             "d.csv": 'k,v\r\n7,"p\r\nq"\r\n', "e.csv": 'k,v\n8,"never closed\n9,x\n'}
    for name, text in texts.items():
        put_bytes(tmp_path / name, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        got = sources.read_csv(spark, str(tmp_path), index="i").orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = sources.read_csv(spark, str(tmp_path), index="i").orderBy("i").collect()
    # But for a last line feed in a quote that never closes.
    assert [tuple(r)[:2] for r in whole] == [tuple(r)[:2] for r in got] and whole[:5] == got[:5]
    assert [tuple(r) for r in got] == [
        (0, "1", "x\n\ny"), (1, "2", "z"), (2, "3", None), (3, "4", "5"), (4, "7", "p\nq"),
        (5, "8", "never closed\n9,x")]
    assert got[0].asDict().keys() == {"i", "k", "v"}
    single = sources.read_csv(spark, str(tmp_path / "c.csv"), multiline=False, index="i")
    assert [tuple(r) for r in single.orderBy("i").collect()] == [(0, "3", None), (1, "4", "5")]
    empty = sources.read_csv(spark, put(tmp_path / "none.txt", ""), index="i")
    assert empty.collect() == [] and empty.columns == ["i"]


def test_json_array_or_object(spark, tmp_path):
    put(tmp_path / "a.json", '[{"flow_input": "x", "v": 1},\n {"flow_input": "y", "v": 2}]')
    put(tmp_path / "b.json", '{"flow_input": "z",\n "v": 3}')
    rows = sources.read_json_inputs(spark, str(tmp_path)).orderBy("v").collect()
    assert [(r.flow_input, r.v) for r in rows] == [("x", 1), ("y", 2), ("z", 3)]


def test_text_lines(spark, tmp_path):
    path = put(tmp_path / "t.txt", " a \n\n\t\nb\n")
    assert [r[0] for r in sources.read_text_inputs(spark, path).collect()] == ["a", "b"]


def test_matrix_checks(spark, tmp_path):
    with pytest.raises(ValueError, match="variant"):
        sources.read_matrix_csv(spark, put(tmp_path / "m.csv", "Input\nx\n"))
    with pytest.raises(ValueError, match="empty"):
        sources.read_matrix_csv(spark, put(tmp_path / "e.csv", "Input,A\n"))


def test_folder(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "~$a.docx", "c.Docx", "n.txt", "pdf"):
        put(tmp_path / name, name)
    (tmp_path / "sub").mkdir()
    put(tmp_path / "sub" / "z.pdf", "z")
    rows = sources.scan_folder(spark, str(tmp_path)).orderBy("file_index").collect()
    assert [(r.file_index, r.filename, r.file_type, r.total_files, r.length) for r in rows] == [
        (1, "a.pdf", "pdf", 3, 5), (2, "b.PDF", "pdf", 3, 5), (3, "c.Docx", "docx", 3, 6)]


def test_file_type_counts(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.docx"):
        put(tmp_path / name, name)
    counts = sources.file_type_counts(sources.scan_folder(spark, str(tmp_path)))
    assert {r.file_type: r.n for r in counts.collect()} == {"pdf": 2, "docx": 1}


def test_a_batch_skips_the_outputs_of_an_earlier_one(spark, tmp_path):
    from tallyloom.operators.runs import run_batch

    out = str(tmp_path / "out" / "out")
    schema = "flow_input string, filename string, flow_variable map<string,string>"
    tasks = spark.createDataFrame(
        [("a", "x/1.txt", None), ("b", "2.txt", None), ("c", None, None)], schema)
    called = []

    def fn(text, variables):
        if text in called:
            raise ValueError("called again")
        return text + variables.get("filename", "")

    assert sources.list_outputs(spark, out).count() == 0
    first = run_batch(tasks.limit(1), fn, sources.list_outputs(spark, out))
    sinks.write_row_files(first.where("status = 'success'"), out)
    assert [r[0] for r in sources.list_outputs(spark, out).collect()] == ["x/1.txt"]
    again = run_batch(tasks, fn, sources.list_outputs(spark, out))
    got = {r.flow_input: (r.status, r.result, r.error) for r in again.collect()}
    assert got == {"a": ("skipped", None, None), "b": ("success", "b2.txt", None),
                   "c": ("success", "c", None)}
    forced = run_batch(tasks, fn, sources.list_outputs(spark, out), overwrite=True)
    assert forced.where("status = 'success'").count() == 3


def test_checkpoint_grows_and_may_be_absent(spark, tmp_path):
    path, schema = str(tmp_path / "cp"), "ticket_id long, status string"
    assert sources.read_checkpoint(spark, path, schema).count() == 0
    for i in (1, 2, 2):
        sinks.append_checkpoint(spark.createDataFrame([(i, "R")], schema), path)
    assert sources.read_checkpoint(spark, path, schema).count() == 3
    ids = sources.processed_ids(sources.read_checkpoint(spark, path, schema))
    assert sorted(r[0] for r in ids.collect()) == ["1", "2"]


def test_a_run_adds_its_rows_once(spark, tmp_path):
    """Broken, repeated, concurrent and overlapping runs of one checkpoint."""
    path, schema = str(tmp_path / "cp"), "ticket_id long, status string"

    def rows(*ids):
        return spark.createDataFrame([(i, "R") for i in ids], schema)

    def ids(**options):
        return sorted(r[0] for r in sources.read_checkpoint(spark, path, schema, **options).collect())

    assert sinks.append_checkpoint(rows(1, 2), path, "monday")
    assert not sinks.append_checkpoint(rows(1, 2), path, "monday")
    assert ids() == [1, 2]

    # A run that breaks off while it writes, or before its marker, has added nothing.
    broken = rows(3).select("ticket_id", F.raise_error(F.lit("lost")).cast("string").alias("status"))
    with pytest.raises(Exception, match="lost"):
        sinks.append_checkpoint(broken, path, "tuesday")
    left = sinks.checkpoint_attempt(rows(3, 4), path, "tuesday")
    assert ids() == [1, 2]
    again = sinks.checkpoint_attempt(rows(3, 4), path, "tuesday")
    assert sinks.commit_checkpoint(spark, path, "tuesday", again)
    assert not sinks.commit_checkpoint(spark, path, "tuesday", left)
    assert ids() == [1, 2, 3, 4]

    # Two runs at once that took up the same ids: of an id the earlier commit's row counts.
    one = sinks.checkpoint_attempt(rows(5, 6), path, "one")
    two = sinks.checkpoint_attempt(rows(6, 7).withColumn("status", F.lit("L")), path, "two")
    assert sinks.commit_checkpoint(spark, path, "two", two)
    assert sinks.commit_checkpoint(spark, path, "one", one)
    assert ids() == [1, 2, 3, 4, 5, 6, 6, 7]
    assert ids(key="ticket_id") == [1, 2, 3, 4, 5, 6, 7]
    kept = sources.read_checkpoint(spark, path, schema, key="ticket_id").where("ticket_id = 6")
    assert kept.first().status == "L"
    with pytest.raises(ValueError, match="run"):
        sinks.append_checkpoint(rows(1), path, "a/b")


def test_concurrent_commits_of_a_run(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path, schema = str(tmp_path / "cp"), "ticket_id long"
    df = spark.range(10).withColumnRenamed("id", "ticket_id")
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda k: sinks.append_checkpoint(df, path, f"run-{k % 2}"), range(6)))
    assert sum(won) == 2
    assert sources.read_checkpoint(spark, path, schema).count() == 20


def test_a_plain_table_is_a_checkpoint_too(spark, tmp_path):
    path, schema = str(tmp_path / "cp"), "ticket_id long"
    spark.range(3).withColumnRenamed("id", "ticket_id").write.parquet(path)
    assert sources.read_checkpoint(spark, path, schema).count() == 3
    sinks.append_checkpoint(spark.range(3, 5).withColumnRenamed("id", "ticket_id"), path)
    assert sources.read_checkpoint(spark, path, schema).count() == 5


def test_json_array_files(spark, tmp_path):
    import json

    rows = [("q\n\"", 1, {"a": "b"}, None), (" é ", 2, None, [1, None])]
    df = spark.createDataFrame(rows, "question string, score int, extra map<string,string>, l array<int>")
    path = str(tmp_path / "r.json")
    assert sinks.write_json_arrays(df.repartition(3), path) >= 1
    files = sorted(f for f in os.listdir(path) if not f.startswith(("_", ".")))
    found = [x for f in files for x in json.loads((tmp_path / "r.json" / f).read_text(encoding="utf-8"))]
    assert sorted((r["question"], r["score"], r["extra"], r["l"]) for r in found) == sorted(rows)
    assert all(list(r) == df.columns for r in found)
    back = sources.read_json_inputs(spark, path, df.schema)
    assert sorted(r.question for r in back.collect()) == sorted(r[0] for r in rows)
    assert sinks.write_json_arrays(df.where("false"), str(tmp_path / "none.json")) == 1
    only, = [f for f in os.listdir(tmp_path / "none.json") if f.endswith(".json")]
    assert json.loads((tmp_path / "none.json" / only).read_text()) == []


def test_results_format_follows_the_suffix(spark, tmp_path):
    df = spark.createDataFrame([("q", 1, {"a": "b"}), (" sp ", 2, None)],
                               "question string, score int, extra map<string,string>")
    sinks.write_results(df, str(tmp_path / "r.CSV"))
    back = sources.read_csv(spark, str(tmp_path / "r.CSV")).orderBy("score").collect()
    assert [tuple(r) for r in back] == [("q", "1", '{"a":"b"}'), (" sp ", "2", None)]
    sinks.write_results(df, str(tmp_path / "r.json"))
    assert spark.read.json(str(tmp_path / "r.json")).count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        sinks.write_results(df, str(tmp_path / "r.txt"))


def test_row_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "l1\nl2"), ("c.txt", "x")],
                               "filename string, result string")
    out = str(tmp_path / "out")
    assert sinks.write_row_files(df, out) == 2
    assert sinks.write_row_files(df, out) == 2
    with open(os.path.join(out, "a", "b.txt"), encoding="utf-8") as f:
        assert f.read() == "l1\nl2"
    assert sorted(os.listdir(out)) == ["a", "c.txt"]
    with pytest.raises(ValueError, match="more than one row"):
        sinks.write_row_files(df.unionAll(df), out)
    nameless = spark.createDataFrame([(None, "x"), ("d.txt", "y")], df.schema)
    with pytest.raises(ValueError, match="no file name"):
        sinks.write_row_files(nameless, out)
    assert not os.path.exists(os.path.join(out, "d.txt"))
    with pytest.raises(Exception, match="leaves the output folder"):
        sinks.write_row_files(df.withColumn("filename", F.concat(F.lit("../"), "filename")), out)


def test_column_validation(spark):
    df = spark.createDataFrame([], "flow_input string, filename string")
    assert inputs.validate_columns(df, output_dir="o") is df
    with pytest.raises(ValueError, match="output directory"):
        inputs.validate_columns(df)
    with pytest.raises(ValueError, match="output directory"):
        inputs.validate_columns(df.drop("filename"), output_dir="o")
    with pytest.raises(ValueError, match="missing required columns: flow_input"):
        inputs.validate_columns(df.drop("flow_input"))
    with pytest.raises(ValueError, match="other; allowed: filename, flow_input, flow_variable"):
        inputs.validate_columns(df.withColumn("other", F.lit(1)), output_dir="o")


def test_variables_of_the_row_win(spark):
    df = spark.createDataFrame(
        [("f", {"filename": "own", "a": "1"}), ("f", None), (None, None)],
        "filename string, flow_variable map<string,string>")
    got = [r.variables for r in inputs.build_variables(df).collect()]
    assert got == [{"filename": "own", "a": "1"}, {"filename": "f"}, {}]


def test_split_record_without_an_input_column(spark):
    df = spark.createDataFrame([("h", 1)], "human_input string, n int")
    row = inputs.split_record(df).first()
    assert row.flow_input == '{"human_input":"h","n":1}'
    assert row.flow_variable == {"human_input": "h", "n": "1"}
    row = inputs.split_record(df, sequential=True).first()
    assert (row.flow_input, row.flow_variable) == ("h", {"n": "1"})


def test_widening_takes_every_key(spark):
    df = spark.range(1200).select(F.create_map(F.col("id").cast("string"), F.lit("x")).alias("m"))
    assert inputs.widen_map(df, "m", "v_").columns == sorted(f"v_{i}" for i in range(1200))


def test_a_row_function_runs_once_under_the_file_sink(spark, tmp_path):
    import uuid

    from tallyloom.operators.apply import apply_flow

    calls = tmp_path / "calls"
    calls.mkdir()

    def fn(text, variables):
        (calls / uuid.uuid4().hex).touch()
        return text.upper()

    rows = spark.range(10).selectExpr("concat('d/', id, '.txt') filename", "concat('t', id) flow_input")
    done = apply_flow(rows, fn, vars_col=None).where("status = 'success'")
    folder = f"file:{tmp_path}/out"
    assert sinks.write_row_files(done, folder) == 10
    assert len(list(calls.iterdir())) == 10
    assert (tmp_path / "out/d/3.txt").read_text() == "T3"
    assert not list((tmp_path / "out").rglob("*.part"))
    with pytest.raises(Exception, match="leaves the output folder"):
        sinks.write_row_files(spark.sql("SELECT '../x' filename, 'a' result"), folder)


@pytest.mark.parametrize("sections", [1, 7, 3000])
def test_packing_of_many_sections(spark, sections):
    from tallyloom.operators.chunking import pack_sections

    tokens = [(i * 7) % 40 for i in range(sections)]
    row = spark.createDataFrame([(tokens,)], "t array<int>").select(
        pack_sections(F.col("t"), 60, F.lit(3)).alias("u")).first()
    covered = [i for u in row.u for i in range(u.start, u.start + u.size)]
    assert covered == list(range(1, sections + 1))
    for u in row.u:
        total = 3 + sum(tokens[u.start - 1:u.start + u.size - 1]) + 2 * (u.size - 1)
        assert total <= 60 and not u.oversize


def test_many_short_files_are_read_in_few_tasks(spark, tmp_path):
    folder, cores = str(tmp_path / "many"), spark.sparkContext.defaultParallelism
    rows = spark.range(1, 121).select(  # Spark's scan leaves out empty files
        F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.repeat(F.lit("é"), F.col("id").cast("int")).alias("result"))
    written = sinks.write_row_files(rows, folder)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "4194304"}):
        scan = spark.read.format("binaryFile").load(folder)
        few = sources.in_fewer_tasks(scan, written)
        assert scan.rdd.getNumPartitions() == 120 and few.rdd.getNumPartitions() == cores
        got = {(r.filename, r.length, r.total_files)
               for r in sources.scan_folder(spark, folder).collect()}
    assert got == {(f"{k}.pdf", 2 * k, 120) for k in range(1, 121)}


def test_a_mounted_folder_is_listed_by_a_task(spark, tmp_path, monkeypatch):
    """The files that Spark's reader finds, without the list of them on the driver."""
    from pyspark.sql import DataFrameReader

    folder = tmp_path / "in box"
    for name in ("a.pdf", "b c%20é+#.docx", "_x=1.pdf", "_x.pdf", ".y.pdf", "z.pdf._COPYING_", "empty.pdf",
                 "_metadata.pdf", "sub/d.pdf", "sub/deep/e.txt", "_sub/f.pdf", ".sub/g.pdf", "_metadata1/h"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        put(folder / name, "" if name == "empty.pdf" else name)
    (folder / "gone.pdf").symlink_to(tmp_path / "nowhere")
    (folder / "linked").symlink_to(folder / "sub")
    found = {}
    for below in (False, True):
        scan = spark.read.format("binaryFile").option("recursiveFileLookup", below).load(str(folder))
        found[below] = {tuple(r) for r in scan.select("path", "length").collect()}
    assert (len(found[False]), len(found[True])) == (3, 8)

    def load(*_):
        raise AssertionError("the driver lists the folder")

    monkeypatch.setattr(DataFrameReader, "load", load)
    for path in (str(folder), f"file://{folder}/", f"{tmp_path}/./in box"):
        for below in (False, True):
            assert {tuple(r) for r in sources._listed(spark, path, below).collect()} == found[below]
    assert {r.filename for r in sources.scan_folder(spark, str(folder)).collect()} == {
        "a.pdf", "b c%20é+#.docx", "_x=1.pdf"}
    assert sources.scan_folder(spark, str(folder / "sub" / "deep")).collect() == []
