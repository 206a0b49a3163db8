"""Runs: stopped by a table, out of time, killed and taken up again; heartbeats and answers as they arrive."""

import glob
import http.server
import json
import os
import random
import shutil
import signal
import subprocess
import sys
import textwrap
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark.operators import report
from evalspark.sources import arriving, endpoint, sse
from evalspark.streaming import heartbeats, progress, runs

HERE = os.path.dirname(os.path.abspath(__file__))


def work(spark, n, side="a"):
    return spark.range(n).select(F.lit(side).alias("side"), F.col("id").alias("row_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("request"))


def provider(log=None, seconds=0.0, bad=(), hang=()):
    """Answers the request in capitals; tells a file what it was asked."""

    class Provider:
        def answer(self, task, requests):
            if log:
                with open(log, "a") as f:  # one line a call: small appends aren't torn
                    f.write(json.dumps(requests) + "\n")
            if set(requests) & set(hang):
                time.sleep(60)
            time.sleep(seconds)
            if set(requests) & set(bad):
                raise ValueError("refused")
            return [r.upper() for r in requests]

    return Provider()


def calls(log):
    return Counter(r for line in open(log) for r in json.loads(line)) if os.path.exists(log) else Counter()


def statuses(store, w, run):
    return dict(Counter(r.status for r in store.outcome(w, run).collect()))


def wait_for(what, seconds=90):
    end = time.time() + seconds
    while not what():
        assert time.time() < end, "waited in vain"
        time.sleep(0.2)


def test_run_to_its_end(spark, tmp_path):
    store, w = runs.Store(str(tmp_path / "s")), work(spark, 50)
    assert store.outcome(w, "r").where("status <> 'pending'").count() == 0
    w = w.unionByName(spark.createDataFrame([("a", 900, None), ("a", 3, "q3")], "side string, row_id long, request string"))  # a null request, a repeated row
    limits = runs.Limits(batch=4, per_task=10, poll=0.2)
    log = str(tmp_path / "log")
    state = runs.start(w, store, "r", "t", provider(log, bad=("q7",)), limits)
    assert state.wait(90) == "completed" and state.attempt == 1
    found = {r.row_id: r for r in store.outcome(w, "r").collect()}
    assert len(found) == 51 and found[3].answer == "Q3" and found[900].status == "error" and found[900].error == "no request"
    wrong = {i for i, r in found.items() if r.status == "error"} - {900}
    assert 7 in wrong and len(wrong) <= 4 and all(found[i].error == "ValueError: refused" for i in wrong)
    assert max(calls(log).values()) == 1
    # again: nothing is left to ask; with errors asked again, those alone
    assert runs.start(w, store, "r", "t", provider(log), limits).wait(60) == "completed" and max(calls(log).values()) == 1
    assert runs.start(w, store, "r", "t", provider(log), limits, again=("error",)).wait(60) == "completed"
    assert {r for r, n in calls(log).items() if n == 2} == {f"q{i}" for i in wrong} and statuses(store, w, "r") == {"done": 50, "error": 1}
    assert [r.attempt for r in store.results(spark).where("row_id = 7").collect()] == [3]
    assert runs.start(w.where("false"), store, "none", "t", provider(), limits).wait(60) == "completed"


def test_stop_from_the_table(spark, tmp_path):
    """A running stage stops within a batch: rows done stay, the others are cancelled, another run goes on."""
    store, w, log = runs.Store(str(tmp_path / "s")), work(spark, 400), str(tmp_path / "log")
    limits = runs.Limits(batch=2, per_task=6, poll=0.2)
    slow = runs.start(w, store, "slow", "t", provider(log, seconds=0.5), limits)
    other = runs.start(work(spark, 20, "b"), store, "other", "t", provider(seconds=0.05), limits)
    wait_for(lambda: glob.glob(f"{store.path}/results/run-slow-*/part-*"))  # not by a job: it would wait for the run's tasks
    store.stop(spark, "slow", "enough")
    told = time.time()
    assert slow.wait(60) == "cancelled" and time.time() - told < 30
    after = sum(calls(log).values())
    time.sleep(2.5)
    assert sum(calls(log).values()) <= after + 16  # what was under way in four tasks when their workers were ended
    states = statuses(store, w, "slow")
    assert set(states) == {"done", "cancelled"} and 6 <= states["done"] < 390 and sum(states.values()) == 400
    assert other.wait(60) == "completed" and statuses(store, work(spark, 20, "b"), "other") == {"done": 20}
    # told to stop, it doesn't begin; allowed again, it asks for what is left only
    assert runs.start(w, store, "slow", "t", provider(log), limits).wait(60) == "cancelled"
    done = {f"q{r.row_id}" for r in store.results(spark).where("run = 'slow'").collect()}
    store.allow(spark, "slow")
    again = str(tmp_path / "again")
    assert runs.start(w, store, "slow", "t", provider(again), runs.Limits(batch=50, per_task=100, poll=0.2)).wait(60) == "completed"
    assert not done & set(calls(again)) and set(calls(again)) == {f"q{i}" for i in range(400)} - done and statuses(store, w, "slow") == {"done": 400}
    assert [(r.run, r.go, r.reason) for r in store.orders(spark).orderBy("ts").collect()] == [("slow", False, "enough"), ("slow", True, "")]
    assert [(r.attempt, r.event) for r in store.events(spark).where("run = 'slow'").orderBy("attempt", "ts").collect()] == [(1, "running"), (1, "cancelled"), (2, "running"), (2, "cancelled"), (3, "running"), (3, "completed")]


def test_deadlines(spark, tmp_path):
    store, w = runs.Store(str(tmp_path / "s")), work(spark, 200)
    limits = runs.Limits(job=4, batch=2, per_task=20, poll=0.2)
    assert runs.start(w, store, "job", "t", provider(seconds=0.3), limits).wait(60) == "timeout"
    states = statuses(store, w, "job")
    assert set(states) == {"done", "timeout"} and 0 < states["done"] < 200
    assert runs.start(w, store, "none left", "t", provider(), limits, seconds_left=0).wait(60) == "timeout"
    # one call hangs: its rows time out, the job ends long before its own deadline, and the rows are asked again
    began = time.time()
    assert runs.start(w, store, "call", "t", provider(hang=("q11",)), runs.Limits(call=1, batch=2, per_task=20, poll=0.2)).wait(60) == "timeout"
    assert time.time() - began < 40 and store.results(spark).where("run = 'call' AND status = 'timeout'").count() in (1, 2)
    assert runs.start(w, store, "call", "t", provider(), limits, seconds_left=60).wait(60) == "completed" and statuses(store, w, "call") == {"done": 200}


def test_killed_and_taken_up(spark, tmp_path):
    """The driver is killed half-way: rows whose task had ended are never asked again."""
    path, log = str(tmp_path / "s"), str(tmp_path / "log")
    code = f"""
        import sys; sys.path[:0] = [{HERE!r}, {os.path.dirname(HERE)!r}]
        from pyspark.sql import SparkSession
        from evalspark.streaming import runs
        import test_runs as t
        import cloudpickle; cloudpickle.register_pickle_by_value(t)
        from pyspark import cloudpickle as own; own.register_pickle_by_value(t)
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        runs.start(t.work(spark, 60), runs.Store({path!r}), "r", "t", t.provider({log!r}, seconds=0.4), runs.Limits(batch=2, per_task=4, poll=0.2)).wait()
    """.replace("        import cloudpickle; cloudpickle.register_pickle_by_value(t)\n", "")
    child = subprocess.Popen([sys.executable, "-c", textwrap.dedent(code)], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    store, w = runs.Store(path), work(spark, 60)
    wait_for(lambda: len(glob.glob(f"{path}/results/*/part-*")) >= 2)
    os.killpg(child.pid, signal.SIGKILL)
    child.wait()
    time.sleep(1)
    done, before = {f"q{r.row_id}" for r in store.results(spark).collect()}, calls(log)
    assert 4 <= len(done) < 60 and statuses(store, w, "r") == {"done": len(done), "pending": 60 - len(done)}
    state = runs.start(w, store, "r", "t", provider(log), runs.Limits(batch=2, per_task=4, poll=0.2))
    assert state.wait(90) == "completed" and state.attempt == 2 and statuses(store, w, "r") == {"done": 60}
    after = calls(log)
    assert all(after[r] == 1 for r in done) and all(after[f"q{i}"] == before[f"q{i}"] + 1 for i in range(60) if f"q{i}" not in done)
    assert sum(after.values()) - 60 <= 2 * 4  # the tasks that were under way


def test_attempts_at_the_same_time(spark, tmp_path):
    """Two drivers take one run: numbers are never shared, rows that both answer count once."""
    store, w = runs.Store(str(tmp_path / "s")), work(spark, 12)
    limits = runs.Limits(batch=3, per_task=6, poll=0.2)
    both = [runs.start(w, store, "r", "t", provider(seconds=0.3), limits) for _ in range(2)]
    assert [s.wait(60) for s in both] == ["completed"] * 2 and {s.attempt for s in both} == {1, 2}
    assert store.results(spark).count() == 12
    seen = progress.progress(store.arriving(spark).select("run", F.col("asked_at").alias("ts"), "error"), "run")
    progress.to_files(seen, str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
    assert progress.current(spark.read.parquet(str(tmp_path / "p")), "run").collect()[0].done >= 12


# ---------------------------------------------------------------- heartbeats


def put(spark, path, n, rows):
    df = spark.createDataFrame([(r, k, m) for r, k, m in rows], "run string, kind string, m long")
    df.select("run", "kind", F.timestamp_seconds(F.col("m") * 60).alias("ts")).coalesce(1).write.parquet(f"{path}/in/{n}")


def listen(spark, path, **how):
    """Go on from the checkpoint to the source's present end: rows found, and how many runs have state."""
    found: list = []
    minute = lambda t: int(t.timestamp() // 60)

    def keep(batch, number):
        found.extend((r.run, r.status, minute(r.last_beat), minute(r.found_at)) for r in batch.collect())

    with heartbeats.keyed_state(spark):
        beats = spark.readStream.schema("run string, kind string, ts timestamp").option("recursiveFileLookup", True).parquet(f"{path}/in")
        query = heartbeats.silent(beats, **how).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    return found, query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else 0


def test_silent_runs(spark, tmp_path):
    """Late and repeated signs, an end, a failure that is told once, and state that goes in the end."""
    how = {"silence": "30 minutes", "forget": "60 minutes", "late": "10 minutes"}
    put(spark, tmp_path, 0, [("a", "started", 100), ("b", "started", 100), ("c", "started", 100), (None, None, 100)])
    assert listen(spark, tmp_path, **how) == ([], 3)
    put(spark, tmp_path, 1, [("a", None, 120), ("a", None, 120), ("b", "completed", 125)])
    assert listen(spark, tmp_path, **how) == ([], 3)
    put(spark, tmp_path, 2, [("a", None, 158), ("b", None, 124)])  # behind a gap of 38 minutes that isn't judged before the watermark (148) has passed 150
    assert listen(spark, tmp_path, **how) == ([("c", "failed", 100, 130)], 3)
    put(spark, tmp_path, 3, [("a", None, 149), ("c", None, 149)])  # late enough to close the gap; c has failed already
    assert listen(spark, tmp_path, **how) == ([], 3)
    put(spark, tmp_path, 4, [("a", None, 240)])
    assert listen(spark, tmp_path, **how) == ([("a", "failed", 158, 188)], 1)
    put(spark, tmp_path, 5, [("a", None, 241), ("b", None, 125), ("c", None, 100), ("d", "completed", 500)])  # too late to count
    assert listen(spark, tmp_path, **how) == ([], 1)
    put(spark, tmp_path, 6, [("e", "completed", 700)])
    assert listen(spark, tmp_path, **how) == ([], 1)


def test_signs_in_any_batches(spark, tmp_path):
    """However signs are ordered and dealt into batches, within what may be late: the same runs fail at the same times."""
    rng = random.Random(5)
    signs = [(run, rng.choice([None, None, None, None, None, "completed"] if k > 6 else [None]), m) for run in "abcdefghijkl" for k, m in enumerate(sorted(rng.sample(range(1000, 1600), 14)))]
    want = []
    for run in "abcdefghijkl":
        own = sorted(m for r, _, m in signs if r == run)
        over = min((m for r, k, m in signs if r == run and k), default=None)
        last = next((a for a, b in zip(own, [*own[1:], 10**6], strict=True) if b - a > 60), None)
        if over is None or over > last:
            want.append((run, "failed", last, last + 60))
    assert 3 < len(want) <= 12
    for n, size in enumerate((len(signs), 40, 15)):
        path = tmp_path / str(n)
        order = sorted(signs, key=lambda s: s[2] + rng.uniform(0, 50))  # up to 50 minutes late, an hour may be
        got: list = []
        for k in range(0, len(order), size):
            put(spark, path, k, order[k : k + size])
            got += listen(spark, path, silence="60 minutes", forget="60 days", late="60 minutes")[0]
        put(spark, path, "last", [("end", "completed", 3000)])
        got += listen(spark, path, silence="60 minutes", forget="60 days", late="60 minutes")[0]
        assert sorted(got) == want
    assert heartbeats.joined([(0, 5), (50, 60)], [15, 30, 75], 10) == [(0, 15), (30, 30), (50, 60), (75, 75)]


def test_live_clock(spark, tmp_path):
    """With processing time a run is found though nothing comes any more."""
    put(spark, tmp_path, 0, [("a", None, 0), ("b", "completed", 0)])
    found: list = []
    with heartbeats.keyed_state(spark):
        beats = spark.readStream.schema("run string, kind string, ts timestamp").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = heartbeats.silent(beats, silence="2 seconds", forget="2 seconds", event_time=False).writeStream.outputMode("update").foreachBatch(lambda b, n: found.extend(r.run for r in b.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="500 milliseconds").start()
    wait_for(lambda: found)
    wait_for(lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
    query.stop()
    assert found == ["a"]


# ---------------------------------------------------------------- answers as they arrive


class Slow(http.server.BaseHTTPRequestHandler):
    """Streams the lines that the request names, one after another; breaks the connection where it says so."""

    protocol_version = "HTTP/1.0"
    gate = threading.Event()
    pause = 0.0

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(200)
        self.end_headers()
        for line in asked["lines"]:
            if line == "HOLD":  # until somebody has seen what came before
                self.gate.wait(120)
                continue
            if line == "BREAK":
                self.connection.shutdown(2)
                return
            self.wfile.write((line + "\n").encode())
            self.wfile.flush()
            time.sleep(self.pause)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Slow)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    Slow.gate.clear()
    yield f"http://127.0.0.1:{httpd.server_port}/"
    httpd.shutdown()


def fold(spark, folder, check, files=None, **how):
    """Go on to the spool's present end: each batch's answers."""
    seen: list = []
    with heartbeats.keyed_state(spark):
        rows = arriving.answers(arriving.arriving(spark, folder, files), **how)
        rows.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.append({r.response: (r.answer, r.n_events, r.complete) for r in b.collect()})).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_answers_before_they_end(spark, tmp_path, server):
    Slow.pause, folder = 0.1, f"{tmp_path}/spool"
    lines = [x for k in range(12) for x in (f'data: {{"text": "{k},"}}', "")]
    lines.insert(10, "HOLD")
    requests = spark.createDataFrame([(f"r{i}", json.dumps({"id": i, "lines": [*lines, "data: [DONE]", ""]})) for i in range(3)], "response string, request string")
    done: list = []
    work = threading.Thread(target=lambda: done.extend(arriving.spool(requests, endpoint.Endpoint(server, stream=True), folder, every=0.5).collect()))
    work.start()
    wait_for(lambda: glob.glob(f"{folder}/*.parquet"))
    first = fold(spark, folder, f"{tmp_path}/check")
    ended = not work.is_alive()
    Slow.gate.set()
    early = {r: a for batch in first for r, a in batch.items()}
    work.join(60)
    assert not ended and early and all(not complete and 0 < n <= 5 for _, n, complete in early.values())
    assert {(r.response, r.n_lines, r.error) for r in done} == {(f"r{i}", 26, None) for i in range(3)}
    last = {r: a for batch in fold(spark, folder, f"{tmp_path}/check") for r, a in batch.items()}
    want = {f"r{i}": ("".join(f"{k}," for k in range(12)), 12, True) for i in range(3)}
    assert last == want and all(w.startswith(early[r][0]) for r, (w, *_) in want.items() if r in early)
    assert fold(spark, folder, f"{tmp_path}/check") == [] or not any(fold(spark, folder, f"{tmp_path}/check"))
    # a replay, a file a batch, stopped in between: the same answers; and the same as the fold of the whole table
    copy = f"{tmp_path}/copy"
    os.mkdir(copy)
    names = sorted(os.path.basename(p) for p in glob.glob(f"{folder}/*.parquet"))
    again: dict = {}
    for part in (names[::-1][: len(names) // 2], names):
        for name in part:
            shutil.copy(f"{folder}/{name}", f"{copy}/{name}")
        for batch in fold(spark, copy, f"{tmp_path}/check2", files=1):
            again |= batch
    assert again == want
    told = sse.answers(sse.frames(arriving.whole(arriving.spooled(spark, folder)), "response", "line_no"), "response", "line_no")
    assert {r.response: (r.answer, r.n_events, True) for r in told.collect()} == want


def test_forms_of_events_and_broken_responses(spark, tmp_path, server):
    Slow.pause, folder = 0.0, f"{tmp_path}/spool"
    cases = {
        "full": ['data: {"text": "a"}', "", 'data: {"answer": "whole"}', "", 'data: {"answer": " "}', ""],
        "frames": ["event: x", 'data: {"text":', 'data: "é"}', "", ": note", "data: no json", "", 'data: {"text": "z"}'],
        "broken": ['data: {"text": "a"}', "", "BREAK"],
        "empty": [],
    }
    requests = spark.createDataFrame([(n, json.dumps({"id": n, "lines": c})) for n, c in cases.items()] + [(None, "x")], "response string, request string")
    point = endpoint.Endpoint(server, stream=True, attempts=1)
    ended = {r.response: r for r in arriving.spool(requests, point, folder, every=0.1).collect()}
    assert sorted(ended) == sorted(cases) and ended["frames"].n_lines == 8 and ended["empty"].n_lines == 0
    got: dict = {}
    for batch in fold(spark, folder, f"{tmp_path}/check"):
        got |= batch
    assert got["full"] == ("whole", 3, True) and got["frames"] == ("éz", 3, True) and got["empty"] == ("", 0, True)
    assert {r.response for r in arriving.unanswered(requests.where("response IS NOT NULL"), folder).collect()} <= {"broken"}
    # posted again with another answer: the later attempt counts, whole, and lines of the two don't mix
    better = spark.createDataFrame([("broken", json.dumps({"id": 9, "lines": ['data: {"text": "b"}', "", 'data: {"text": "c"}', ""]}))], "response string, request string")
    if got["broken"][2] is False:
        arriving.spool(better, point, folder, every=0.1).collect()
        for batch in fold(spark, folder, f"{tmp_path}/check"):
            got |= batch
        assert got["broken"] == ("bc", 2, True)
        best = arriving.whole(arriving.spooled(spark, folder)).where("response = 'broken'")
        assert [r.line for r in best.orderBy("line_no").collect()] == ['data: {"text": "b"}', "", 'data: {"text": "c"}', ""]
    gone = endpoint.Endpoint("http://127.0.0.1:9/", stream=True, attempts=1)
    assert [r.error is not None for r in arriving.spool(better, gone, f"{tmp_path}/none").collect()] == [True]


def test_any_order_of_lines(spark, tmp_path):
    """Lines shuffled over files, with repeats: the fold is that of the lines in order."""
    rng, rows, want = random.Random(8), [], {}
    for k in range(6):
        lines = [x for i in range(rng.randint(0, 8)) for x in ([f'data: {{"text": "{k}{i}"}}', ""] if rng.random() < 0.7 else [f'data: {{"final_answer": "f{i}"}}'])] + [""]
        rows += [(f"r{k}", "1", n, line, None) for n, line in enumerate(lines)] + [(f"r{k}", "1", len(lines), None, None)]
    table = spark.createDataFrame(rows, "response string, attempt string, line_no long, line string, error string")
    for framed, parts in ((True, sse.frames), (False, sse.data_lines)):
        told = {r.response: (r.answer, True) for r in sse.answers(parts(table.where("line IS NOT NULL"), "response", "line_no"), "response", "line_no").collect()}
        folder = f"{tmp_path}/{framed}"
        mixed = rows + rng.sample(rows, 5)
        rng.shuffle(mixed)
        for k in range(0, len(mixed), 7):
            spark.createDataFrame(mixed[k : k + 7], table.schema).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(folder)
        got: dict = {}
        for batch in fold(spark, folder, f"{tmp_path}/check{framed}", files=3, framed=framed):
            got |= batch
        assert {r: (a, c) for r, (a, _, c) in got.items()} == {f"r{k}": told.get(f"r{k}", ("", True)) for k in range(6)}


def test_summaries_of_every_prefix(spark, tmp_path):
    """Merged states equal the whole computation after each batch; a batch that is written again counts once."""
    rng, rows = random.Random(9), []
    schema = "run string, metric string, score double, threshold double"
    for k in range(4):
        batch = [(rng.choice("ab"), rng.choice("xyz"), rng.choice([None, float("nan"), rng.random(), 0.7]), rng.choice([None, 0.5])) for _ in range(200)]
        rows += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        progress.summarized(stream, f"{tmp_path}/parts", f"{tmp_path}/check", "run", "metric").awaitTermination()
        got = progress.summaries(spark.read.parquet(f"{tmp_path}/parts"), "run", "metric")
        want = report.metric_summary(spark.createDataFrame(rows, schema), "run", "metric")
        columns = ["run", "metric", "mean", "min", "max", "pass_rate", "n", "errors"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    report.partial_summary(spark.read.schema(schema).parquet(f"{tmp_path}/in/3"), "run", "metric").write.mode("overwrite").parquet(f"{tmp_path}/parts/batch=3")
    assert sorted(map(tuple, progress.summaries(spark.read.parquet(f"{tmp_path}/parts"), "run", "metric").select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
