"""Row functions, matrices, matching, sitemaps and the streaming jobs on small fixtures."""

import os
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import matrix, outcomes, sessions
from tallyloom.operators.apply import apply_flow, apply_judge, exact_judge, overlap_judge
from tallyloom.operators.sitemaps import expand_sitemaps, limit_urls
from tallyloom.streaming import jobs


def test_one_bad_row_does_not_fail_the_job(spark):
    def fn(text, variables):
        if text == "boom":
            raise ValueError("bad input")
        return {"none": None, "empty": ""}.get(text, f"{text}{variables.get('v', '')}")

    rows = [("a", {"v": "1"}), ("boom", None), ("none", {}), ("empty", {}), (None, {}), ("b", None)]
    df = spark.createDataFrame(rows, "flow_input string, variables map<string,string>")
    for got in (apply_flow(df, fn, parallelism=2), apply_flow(df, setup=lambda: fn)):
        by_input = {r.flow_input: (r.status, r.result, r.error) for r in got.collect()}
        failed = ("failed", None, "No content returned")
        assert by_input == {
            "a": ("success", "a1", None), "b": ("success", "b", None),
            "boom": ("error", None, "bad input"), "none": failed, "empty": failed, None: failed}


def spans(path):
    """(start, end) of the calls that a function noted in a folder."""
    return sorted(tuple(map(float, f.read_text().split())) for f in path.iterdir())


def noting(folder, seconds):
    def fn(text, variables):
        import time
        import uuid

        start = time.time()
        time.sleep(seconds)
        (folder / uuid.uuid4().hex).write_text(f"{start} {time.time()}")
        return text[::-1]

    return fn


@pytest.mark.parametrize("in_flight", [1, 4])
def test_calls_in_flight_overlap_and_keep_their_order(spark, tmp_path, in_flight):
    df = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("flow_input"))
    done = apply_flow(df, noting(tmp_path, 0.05), vars_col=None, in_flight=in_flight).collect()
    assert [r.result for r in done] == [str(i)[::-1] for i in range(40)]
    ran = spans(tmp_path)
    most = max(sum(a <= start < b for a, b in ran) for start, _ in ran)
    assert len(ran) == 40 and most == in_flight


def test_a_call_that_hangs_is_a_row_with_an_error(spark):
    def fn(text, variables):
        import time

        if text.startswith("hang"):
            time.sleep(30)
        if text == "exit":
            raise SystemExit("left")
        return text

    rows = ["a", "hang 1", "b", "hang 2", "hang 3", None, "exit", "c"]
    df = spark.createDataFrame([(t,) for t in rows], "flow_input string").coalesce(1)
    for in_flight in (1, 2):
        start = datetime.now()
        got = [(r.flow_input, r.status, r.error) for r in apply_flow(
            df, fn, vars_col=None, in_flight=in_flight, timeout=0.8).collect()]
        assert (datetime.now() - start).total_seconds() < 20
        late = "Flow execution timed out after 0.8 seconds"
        assert got == [
            (t, "failed", "No content returned") if t is None else (t, "error", "left")
            if t == "exit" else (t, "error", late) if t.startswith("hang") else (t, "success", None)
            for t in rows]
    judged = apply_judge(
        df.select(F.col("flow_input").alias("expected_answer"), F.lit("x").alias("actual_answer")),
        lambda e, a: fn(e or "", {}), in_flight=4, timeout=0.8)
    assert judged.where(F.col("error").contains("timed out")).count() == 3


def test_the_window_outlives_many_given_up_calls():
    import threading
    import time

    from tallyloom.operators.calls import CallWindow

    lock, now, most = threading.Lock(), 0, 0

    def fn(n):
        nonlocal now, most
        with lock:
            now, most = now + 1, max(most, now + 1)
        time.sleep(0.5 if n % 5 == 0 else 0.001)
        with lock:
            now -= 1
        return n

    window = CallWindow(fn, 8, 0.1)
    for low in range(0, 200, 50):
        done = window.run([(n,) for n in range(low, low + 50)])
        assert [c.value for c in done] == [None if n % 5 == 0 else n for n in range(low, low + 50)]
        assert all((c.error is None) == bool(c.args[0] % 5) for c in done)
    assert window.run([]) == [] and window.run([None])[0].value is None
    window.close()
    with pytest.raises(ValueError, match="positive"):
        CallWindow(fn, 0)


def test_setup_runs_once_per_task(spark, tmp_path):
    folder = str(tmp_path)

    def setup():
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda text, variables: text

    df = spark.range(1000).repartition(3).select(F.col("id").cast("string").alias("flow_input"))
    applied = apply_flow(df, setup=setup, vars_col=None)
    assert applied.where("status = 'success'").count() == 1000
    assert len(os.listdir(folder)) == 3


def test_judges(spark):
    df = spark.createDataFrame(
        [("A b", " a B "), ("one two", "two three"), ("x", None)],
        "expected_answer string, actual_answer string")
    assert [r.judge_score for r in exact_judge(df).collect()] == [10.0, 0.0, 0.0]
    scores = [r.judge_score for r in overlap_judge(df).collect()]
    assert scores == pytest.approx([10.0, 10 / 3, 0.0])
    judged = apply_judge(df, lambda e, a: '{"total_rating": %d}' % len(a)).collect()
    assert [r.judge_score for r in judged] == ["5", "9", "0"]
    assert judged[2].judge_reasoning.startswith("Error during flow execution")


def test_collapse_after_expand_restores_the_matrix(spark):
    rows = [(0, " x ", "1", "2", "3"), (1, "y", "4", "5", "6"), (2, "  ", "", "", ""),
            (3, None, "", "", ""), (4, "z", "7", "8", "9")]
    names = ["Output1", "a.b", "Out 3"]
    base = spark.createDataFrame(rows, ["i", "Input", *names])
    cells = matrix.expand_matrix(base, "i", "Input", names, "variant")
    assert cells.count() == 9
    assert {r.variables["variant"] for r in cells.collect()} == set(names)
    values = {(r[0], n): v for r in rows for n, v in zip(names, r[2:])}
    known = spark.createDataFrame(
        [(i, n, v) for (i, n), v in values.items()], "row_idx long, col_name string, cell string")
    back = matrix.collapse_matrix(base, cells.join(known, ["row_idx", "col_name"]), "i", "Input",
                                  names)
    assert back.columns == ["i", "Input", *names]
    assert [tuple(r) for r in back.orderBy("i").collect()] == rows


def test_a_blank_matrix_is_all_skipped(spark):
    base = spark.createDataFrame([(0, "", "a"), (1, " ", "b")], "i int, Input string, V string")
    cells = matrix.run_cells(base, lambda t, v: t, "i", "Input", ["V"])
    row = matrix.matrix_stats(base, cells, ["V"], "Input").first()
    assert (row.completed, row.failed, row.skipped, row.total) == (0, 0, 4, 4)


def test_extra_variables_reach_the_cells(spark):
    base = spark.createDataFrame([(0, "x", "a", {"k": "v", "col_name": "lost"})],
                                 "i int, Input string, V string, e map<string,string>")
    cells = matrix.run_cells(base, lambda t, v: f"{t}{v['k']}{v['col_name']}", "i", "Input", ["V"],
                             extra_vars="e")
    assert cells.first().result == "xvV"


def test_match_within_takes_the_earliest_in_time(spark):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    tasks = spark.createDataFrame([(i, at(100)) for i in range(4)],
                                  "task_id long, submitted_at timestamp")
    results = spark.createDataFrame(
        [(0, at(50)), (0, at(300)), (0, at(200)), (1, at(401)), (2, at(400)), (2, at(400)),
         (9, at(100))], "task_id long, arrived_at timestamp")
    got = {r.task_id: (r.completed_at, r.status) for r in outcomes.match_within(
        tasks, results, F.expr("INTERVAL 300 SECONDS")).collect()}
    assert got == {0: (at(200), "success"), 1: (None, "failed"), 2: (at(400), "success"),
                   3: (None, "failed")}


def test_session_artefacts(spark):
    rows = [(1, 1, 10, "artefact"), (1, 2, 20, "message"), (1, 3, 30, "artefact"),
            (1, 1, 10, "artefact"), (2, 4, 5, "artefact"), (3, 5, 1, "message")]
    df = spark.createDataFrame(rows, "session_id long, event_id long, ts long, kind string")
    got = {r.session_id: tuple(r)[1:] for r in sessions.session_response(df).collect()}
    assert got == {1: (2, 1, "success"), 2: (None, 1, "timeout"), 3: (5, 0, "success")}
    assert sorted(r.event_id for r in sessions.session_artefacts(df).collect()) == [1, 4]


def xml(kind, child, *locs):
    body = "".join(f"<{child}><loc>{loc}</loc></{child}>" for loc in locs)
    return (f'<{kind} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{body}</{kind}>')


def test_sitemaps_keep_order_and_repeats(spark):
    docs = spark.createDataFrame([
        ("root", xml("sitemapindex", "sitemap", "b", "a", "b")),
        ("a", xml("urlset", "url", "u1", "u2", "u1")), ("b", xml("sitemapindex", "sitemap", "c")),
        ("c", xml("urlset", "url", "u9&amp;x")), ("unused", xml("urlset", "url", "no")),
    ], "sitemap_url string, xml string")
    urls = expand_sitemaps(docs, "root")
    got = [tuple(r) for r in urls.orderBy("url_index").collect()]
    assert got == [(1, "u9&x"), (2, "u1"), (3, "u2"), (4, "u1"), (5, "u9&x")]
    assert limit_urls(urls, 2).count() == 2


def test_sitemaps_that_cannot_be_expanded(spark):
    schema = "sitemap_url string, xml string"
    lost = spark.createDataFrame([("root", xml("sitemapindex", "sitemap", "gone"))], schema)
    with pytest.raises(ValueError, match="not among"):
        expand_sitemaps(lost, "root")
    endless = spark.createDataFrame([
        ("root", xml("sitemapindex", "sitemap", "a")), ("a", xml("sitemapindex", "sitemap", "root")),
    ], schema)
    with pytest.raises(ValueError, match="lists itself"):
        expand_sitemaps(endless, "root")


def test_a_restarted_stream_leaves_no_duplicates(spark, tmp_path):
    inbox, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ticket_id long, v string"
    for ids in ([1, 2, 2], [2, 3], [1, 3, 4]):
        spark.createDataFrame([(i, "x") for i in ids], schema).write.mode("append").parquet(inbox)
        stream = jobs.read_table_stream(spark, inbox, spark.read.parquet(inbox).schema, 1)
        jobs.resume_stream(stream, path, checkpoint, "ticket_id",
                           work=lambda df: df.withColumn("done", F.lit(True)))
    rows = spark.read.parquet(path).collect()
    assert sorted(r.ticket_id for r in rows) == [1, 2, 3, 4]
    assert all(r.done for r in rows)


def test_a_failed_batch_is_run_again_without_duplicates(spark, tmp_path):
    inbox, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(10).withColumnRenamed("id", "ticket_id").write.parquet(inbox)

    def broken(df):
        df.write.parquet(f"{path}/batch_id=0")
        raise RuntimeError("lost")

    schema = spark.read.parquet(inbox).schema
    with pytest.raises(Exception, match="lost"):
        jobs.resume_stream(jobs.read_table_stream(spark, inbox, schema), path, checkpoint,
                           "ticket_id", work=broken)
    jobs.resume_stream(jobs.read_table_stream(spark, inbox, schema), path, checkpoint, "ticket_id")
    assert spark.read.parquet(path).count() == 10


def inbox_of(spark, tmp_path, batches, schema, name="in"):
    """One file, and so with a bound of one file one micro-batch, for every list of rows."""
    inbox = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    return inbox, spark.read.parquet(inbox).schema


def test_resuming_never_reads_the_output(spark, tmp_path):
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    batches = [[(1,), (2,), (2,)], [(2,), (3,)], [(3,), (1,), (4,)], [(4,), (5,)]]
    inbox, schema = inbox_of(spark, tmp_path, batches[:3], "ticket_id long")
    done = spark.createDataFrame([("5",)], "ticket_id string")

    def run():
        with jobs.settings(spark, {jobs.PARTITIONS: "2", jobs.STATE_STORE: jobs.ROCKSDB}):
            return jobs.resume_stream(jobs.read_table_stream(spark, inbox, schema, 1), path,
                                      checkpoint, "ticket_id", done=done)

    query = run()
    assert [p["batchId"] for p in query.recentProgress if p["numInputRows"]] == [0, 1, 2]
    first = sorted(r.ticket_id for r in spark.read.parquet(path).collect())
    assert first == [1, 2, 3, 4]
    # With the output gone the ids are still known.
    os.rename(path, str(tmp_path / "away"))
    inbox_of(spark, tmp_path, [*batches[3:], [(6,), (1,)]], "ticket_id long")
    run()
    assert sorted(r.ticket_id for r in spark.read.parquet(path).collect()) == [6]


def test_ids_are_forgotten_behind_the_watermark(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda d: t0 + timedelta(days=d)
    batches = [[(1, at(0))], [(1, at(5)), (2, at(9))], [(3, at(60))], [(4, at(60))],
               [(1, at(70)), (3, at(61))]]
    inbox, schema = inbox_of(spark, tmp_path, batches, "ticket_id long, at timestamp")
    path = str(tmp_path / "out")
    query = jobs.resume_stream(jobs.read_table_stream(spark, inbox, schema, 1), path,
                               str(tmp_path / "state"), "ticket_id", at="at", within="10 days")
    rows = sorted(tuple(r) for r in spark.read.parquet(path).select("ticket_id", "at").collect())
    assert rows == [(1, at(0)), (1, at(70)), (2, at(9)), (3, at(60)), (4, at(60))]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_a_steady_stream_takes_up_what_arrives_and_stops_cleanly(spark, tmp_path):
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    inbox, schema = inbox_of(spark, tmp_path, [[(1,), (2,)], [(3,)], [(2,), (4,)]], "ticket_id long")
    later = [[(5,)], [(6,), (1,)]]

    def until(query):
        ran = [p for p in query.recentProgress if p["numInputRows"]]
        if len(ran) == 3 and later:
            inbox_of(spark, tmp_path, [later.pop(0)], "ticket_id long")
        return len(ran) >= 4

    query = jobs.resume_stream(jobs.read_table_stream(spark, inbox, schema, 1), path, checkpoint,
                               "ticket_id", every="300 milliseconds", until=until)
    assert not query.isActive
    ran = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in ran] == [2, 1, 2, 1]
    starts = [datetime.fromisoformat(p["timestamp"]) for p in ran]
    assert all((b - a).total_seconds() >= 0.25 for a, b in zip(starts, starts[1:]))
    inbox_of(spark, tmp_path, later, "ticket_id long")
    jobs.resume_stream(jobs.read_table_stream(spark, inbox, schema, 1), path, checkpoint,
                       "ticket_id", every="300 milliseconds", until=jobs.idle(1))
    rows = [r.ticket_id for r in spark.read.parquet(path).collect()]
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]


def test_a_steady_stream_raises_its_failure(spark, tmp_path):
    inbox, schema = inbox_of(spark, tmp_path, [[(1,)]], "ticket_id long")

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        jobs.resume_stream(jobs.read_table_stream(spark, inbox, schema), str(tmp_path / "out"),
                           str(tmp_path / "state"), "ticket_id", work=broken, every="1 second",
                           until=jobs.idle(30))


def test_running_falls_when_a_task_ends(spark, tmp_path):
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    batches = [[(1, "running"), (2, "running"), (3, "running")],
               [(1, "success"), (1, "running"), (4, "error")],
               [(2, "failed"), (1, "success"), (4, "running"), (5, "running")]]
    inbox, schema = inbox_of(spark, tmp_path, batches, "task_id long, status string")
    jobs.task_status_stream(jobs.read_table_stream(spark, inbox, schema, 1), path, checkpoint)
    cycles = {}
    for r in spark.read.parquet(path).collect():
        cycles.setdefault(r.batch_id, {})[r.status] = r.n
    assert cycles == {0: {"running": 3}, 1: {"running": 1, "success": 1, "error": 1},
                      2: {"running": 2, "failed": 1}}
    got = {r.status: r.n for r in jobs.latest_counts(spark, path).collect()}
    assert got == {"running": 2, "success": 1, "failed": 1, "error": 1}


def test_a_session_with_most_rows_over_micro_batches(spark, tmp_path):
    """One session holds nearly all rows; artefacts are counted exactly, repeats once."""
    import random

    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    events = [(1, i, at(rng.randrange(0, 30_000)), "artefact", None) for i in range(4000)]
    events += [(1, 5000, at(20_000), "message", "m"), (1, 5001, at(25_000), "message", "late"),
               (1, 5002, at(20_000), "artefact", None), (1, 4999, at(20_000), "artefact", None),
               (2, 6000, at(10), "artefact", None), (2, 6001, at(40_000), "message", "too late")]
    events.sort(key=lambda e: (e[2] + timedelta(seconds=rng.randrange(3000)), e[1]))
    events += rng.sample(events[-1000:], 200)
    schema = "session_id long, event_id long, ts timestamp, kind string, text string"
    cut = len(events) // 4 + 1
    batches = [events[k:k + cut] for k in range(0, len(events), cut)]
    inbox, stored = inbox_of(spark, tmp_path, [*batches, [(9, 9, at(10**8), "other", None)]], schema)
    path = str(tmp_path / "out")
    with jobs.settings(spark, {jobs.PARTITIONS: "2", jobs.STATE_STORE: jobs.ROCKSDB,
                               "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}):
        jobs.drain(jobs.session_response_stream(
            jobs.read_table_stream(spark, inbox, stored, 1), "30000 seconds", "5000 seconds",
            text="text"), path, str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(path).collect()}
    twin = sessions.session_response(spark.createDataFrame(events, schema),
                                     F.expr("INTERVAL 30000 SECONDS"), "text")
    assert got == {tuple(r) for r in twin.collect()} and len(got) == 2


def test_matching_in_a_stream_needs_no_python(spark, tmp_path):
    schemas = {"tasks": "task_id long, submitted_at timestamp", "results": "task_id long, arrived_at timestamp"}
    streams = []
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
        streams.append(jobs.read_table_stream(spark, str(tmp_path / name), schema))
    matched = jobs.match_within_stream(*streams, "10 seconds")
    assert "Python" not in matched._jdf.queryExecution().toString()


def test_status_counts_over_several_batches(spark, tmp_path):
    inbox, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "status string"
    for statuses in (["success", "failed"], ["success"], ["error", "success"]):
        spark.createDataFrame([(s,) for s in statuses], schema).coalesce(1)\
            .write.mode("append").parquet(inbox)
    stream = jobs.read_table_stream(spark, inbox, spark.read.parquet(inbox).schema, 1)
    jobs.status_counts_stream(stream, path, checkpoint)
    got = {r.status: r.n for r in jobs.latest_counts(spark, path).collect()}
    assert got == {"success": 3, "failed": 1, "error": 1}


def test_sessions_out_of_order_over_micro_batches(spark, tmp_path):
    inbox, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "session_id long, event_id long, ts timestamp, kind string, text string"
    t0 = datetime(2024, 1, 1, 10)
    at = lambda m: t0 + timedelta(minutes=m)
    batches = [[(1, 1, at(10), "artefact", "a"), (2, 3, at(0), "artefact", "c")],
               [(1, 2, at(5), "message", "m"), (1, 1, at(10), "artefact", "a")],
               [(1, 4, at(1), "artefact", "b"), (3, 5, at(20), "message", "n")],
               [(9, 9, at(9999), "other", None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    stream = jobs.read_table_stream(spark, inbox, spark.read.parquet(inbox).schema, 1)
    with jobs.settings(spark, {jobs.PARTITIONS: "2", jobs.STATE_STORE: jobs.ROCKSDB}):
        jobs.drain(jobs.session_response_stream(stream, "60 minutes", "30 minutes", text="text"),
                   path, checkpoint)
    got = {tuple(r) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 2, 1, "success", "m"), (2, None, 1, "timeout", None),
                   (3, 5, 0, "success", "n")}
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    twin = sessions.session_response(every, F.expr("INTERVAL 60 MINUTES"), "text")
    assert got == {tuple(r) for r in twin.where("session_id < 9").collect()}


def test_stream_outcomes_are_one_row_per_task(spark, tmp_path):
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    asked = [[(0, at(100)), (1, at(100))], [(2, at(90))], [(-1, at(9999))]]
    given = [[(2, at(150)), (0, at(300))], [(0, at(200)), (0, at(50)), (1, at(401)), (8, at(120))],
             [(-1, at(9999))]]

    def stream(name, batches, column):
        inbox, schema = str(tmp_path / name), f"task_id long, {column} timestamp"
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        return jobs.read_table_stream(spark, inbox, spark.read.parquet(inbox).schema, 1)

    with jobs.settings(spark, {jobs.PARTITIONS: "2", jobs.STATE_STORE: jobs.ROCKSDB}):
        jobs.drain(jobs.match_within_stream(
            stream("tasks", asked, "submitted_at"), stream("results", given, "arrived_at"),
            "300 seconds", "400 seconds"), path, checkpoint)
    got = {r.task_id: (r.completed_at, r.status) for r in spark.read.parquet(path).collect()}
    assert got == {0: (at(200), "success"), 1: (None, "failed"), 2: (at(150), "success")}


class _Store:
    """State of one session in memory; counts what would be calls to the JVM."""

    def __init__(self):
        self.row, self.spans, self.calls, self.span_calls, self.timers = None, {}, 0, 0, set()

    def getValueState(self, *_):  # noqa: N802
        return self

    def getMapState(self, *_):  # noqa: N802
        return SimpleNamespace(iterator=self._iterate, updateValue=self._put, removeKey=self._take)

    def get(self):
        self.calls += 1
        return self.row

    def update(self, row):
        self.calls += 1
        self.row = row

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def _iterate(self):
        self.span_calls += 1
        return iter(list(self.spans.items()))

    def _put(self, place, held):
        self.span_calls += 1
        self.spans[place] = held

    def _take(self, place):
        self.span_calls += 1
        del self.spans[place]


@pytest.mark.parametrize("most", [4096, 5])
def test_a_session_of_usual_size_needs_its_own_row_alone(monkeypatch, most):
    monkeypatch.setattr(jobs, "HELD", most)
    hour, store, rng = 3_600_000_000, _Store(), random.Random(5)
    session = jobs._Session(48 * hour, 1000 * hour)
    session.init(store)
    rows = [(k * hour // 2, k, "artefact", None) for k in range(150)]
    rows[70] = (35 * hour, 70, "message", "m")
    rng.shuffle(rows)
    # Five micro-batches in which the watermark has passed nothing, then it passes everything.
    for k in range(0, 150, 30):
        batch = pd.DataFrame(rows[k:k + 30], columns=["at", "event_id", "kind", "message"])
        assert not list(session.handleInputRows((1,), iter([batch]), SimpleNamespace(
            getCurrentWatermarkInMs=lambda: -1)))
    assert (store.span_calls == 0) == (most == 4096)
    assert most < 4096 or store.calls <= 15
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: 500 * hour // 1000)
    out = list(session.handleExpiredTimer((1,), late, None))
    assert [tuple(r) for df in out for r in df.to_numpy()] == [(1, 70, 70, "success", "m")]
    assert not store.spans
