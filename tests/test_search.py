"""Searches with bounds against plain ones, and calls under a budget."""

import http.server
import math
import random
import threading
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from evalspark.functions import text as T
from evalspark.functions.stored import handed
from evalspark.operators import buckets, report, retrieval, snapshots
from evalspark.plans import datasets
from evalspark.sources import endpoint, paced


def test_terms_in_one_pass(spark):
    """Hashed terms are the tokens: the same numbers of the same ones."""
    rng = random.Random(1)
    texts = ["".join(rng.choices(["BM25 ", "é", "x1", " ", "漢字", "字", "K", "İ", "\n", "\x01", "4e00", "-", "漢", "𝒜"], k=rng.randint(0, 40))) for _ in range(200)] + [None, "", "a" * 100_000, "漢" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    made = T.term_counts(df, "id", "text").join(df.select("id", T.bigram_tokens("text").alias("tokens"), T.token_count("text").alias("n")), "id").collect()
    name: dict = {}
    for r in made:
        want = Counter(r.tokens or [])
        assert r.len == (r.n or 0) == sum(want.values()) and sorted(r.tfs) == sorted(want.values())
        if len(want) == 1:
            name[r.terms[0]] = next(iter(want))
    tokens = sorted({t for r in made for t in r.tokens or []})
    alone = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id long, text string")
    name = {r.terms[0]: tokens[r.id] for r in T.term_counts(alone, "id", "text").collect()}
    assert len(name) == len(tokens)
    assert all({name[h]: n for h, n in zip(r.terms, r.tfs, strict=True)} == dict(Counter(r.tokens or [])) for r in made)
    some = handed(spark.createDataFrame([(h,) for h in list(name)[::2]], "h long"))
    kept = {r.id: r for r in T.term_counts(df, "id", "text", some).collect()}
    assert all(sorted(kept[r.id].terms) == sorted(h for h in r.terms if h in set(list(name)[::2])) and kept[r.id].len == r.len for r in made)
    assert handed(spark.range(10), 9) is None and handed(spark.range(0), 9).value.tolist() == []


def slow_bm25(docs, queries, k):
    tokens = {i: t.split() for i, t in docs.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    out = []
    for q, text in queries.items():
        scores = {}
        for i, ts in tokens.items():
            tf = Counter(ts)
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in set(text.split()) if t in tf)
            if round(s, 6) > 0:
                scores[i] = round(s, 6)
        out += [(q, i, r + 1) for r, (i, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def test_bm25_skips_blocks_and_stays_exact(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = {i: " ".join(rng.choices(words, weights, k=rng.randint(0, 30)) + [f"topic{i // 20}"] * (i % 3)) for i in range(600)}
    queries = {i: " ".join(rng.choices(words[5:], weights[5:], k=2) + [f"topic{rng.randint(0, 29)}"]) for i in range(25)} | {90: "", 91: "unknown", 92: "w0"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    want = slow_bm25(docs, queries, 4)
    for block in (1, 20, 10**6):
        assert sorted((r.query_id, r.doc_id, r["rank"]) for r in retrieval.bm25(d, q, 4, block=block).collect()) == want
    few = retrieval.scored_share(d, q, 4, block=20).first()
    assert 0 < few.scored < few["all"] and few.share < 0.75
    assert retrieval.scored_share(d, q, 4, block=10**6).first().share == 1
    named = d.withColumn("doc_id", F.format_string("%05d", "doc_id"))  # ids that aren't numbers
    assert sorted((r.query_id, int(r.doc_id), r["rank"]) for r in retrieval.bm25(named, q, 4).collect()) == want
    assert retrieval.bm25(d.where("false"), q).count() == 0 and retrieval.bm25(d, q.where("false")).count() == 0


def test_bm25_writes_no_pairs(spark, monkeypatch):
    """Of common words: no table has a row for every query and document, or every document and term; batches and pieces of any size find the same."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    docs = {i: " ".join(rng.choices(words, k=rng.randint(0, 12))) for i in range(1500)}
    docs |= {2000 - i: docs[7] for i in range(300)}  # copies: the smaller ids win
    queries = {i: " ".join(rng.choices(words, k=5)) for i in range(20)} | {20: docs[7]}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    want, rows, kept = slow_bm25(docs, queries, 4), {}, retrieval.stored

    def counted(df, name):
        out = kept(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(retrieval, "stored", counted)
    found = lambda **how: sorted((r.query_id, r.doc_id, r["rank"]) for r in retrieval.bm25(d, q, 4, **how).collect())
    assert found() == want
    assert max(rows.values()) == len(docs) and rows["bm25-best"] <= 3 * 4 * len(queries)
    monkeypatch.setattr(retrieval, "CELLS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert found() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found(most=5) == want


def test_scenarios_write_no_pairs(spark, monkeypatch):
    """The registered query, with all documents as distractors: of a document one row is written, of a query the best of each task."""
    kept, rows = retrieval.stored, {}

    def counted(df, name):
        out = kept(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(retrieval, "stored", counted)
    got = {r.scenario: r.n for r in datasets.retrieval_scenarios(spark, SF).collect()}
    items, docs = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("benchmark", "documents"))
    assert got == {"none": items, "all": items}
    assert rows.pop("bm25-best") <= 5 * items * 4 and rows.pop("bm25-idf") <= rows.pop("bm25-asked")
    assert max(rows.values()) == items + docs


def test_bm25_of_odd_rows_as_sql_has_it(spark):
    """Rows that share an id, null ids and null texts, with the queries' terms handed to tasks and by a join."""
    rng = random.Random(9)
    say = lambda k: " ".join(rng.choices(["a", "b", "c", "d", "e", "f", "gg"], [9, 5, 3, 2, 1, 1, 1], k=k))
    docs = [(i, say(rng.randint(0, 9))) for i in range(80)] + [(900, None), (901, None), (902, "")]
    docs += docs[:5] + [(i, say(8)) for i in (3, 4, 30, 30)] + [(None, "gg f"), (None, "e e e"), (None, None)]
    queries = [(i, say(3)) for i in range(8)] + [(1, "gg a"), (2, "f"), (None, "gg"), (50, None), (51, "zz")]
    for kind in ("long", "string"):
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
        q = spark.createDataFrame(queries, "query_id long, text string").withColumn("query_id", F.col("query_id").cast(kind))
        con = duckdb.connect()
        con.register("documents", d.toArrow())
        con.register("questions", q.toArrow())
        tokens = datasets.TOKENS_SQL.format("text")
        sql = datasets.BM25_SQL.format(docs=f"SELECT doc_id, {tokens} AS tok FROM documents", queries=f"SELECT query_id, {tokens} AS tok FROM questions")
        want = con.sql(f"WITH {sql} SELECT query_id, doc_id, rank, score FROM k WHERE rank <= 4").fetchall()
        for how in ({}, {"most": 3}, {"most": 3, "block": 5}):
            got = [(r.query_id, r.doc_id, r["rank"], r.score) for r in retrieval.bm25(d, q, 4, **how).collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr), (kind, how)


@pytest.mark.parametrize("case", ["clusters", "spread", "copies", "odd"])
def test_nearest_by_cosine(spark, case):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    x = {"clusters": lambda: centers[rng.integers(0, 12, 400)] + rng.normal(scale=0.05, size=(400, 8)), "spread": lambda: rng.normal(size=(400, 8)), "copies": lambda: np.repeat(rng.normal(size=(3, 8)), 130, 0), "odd": lambda: np.where(rng.random((60, 8)) < 0.5, 0.0, -rng.random((60, 8)))}[case]()
    if case == "odd":
        x[:5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    more = [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8)]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>").repartition(5)
    queries = df.where("vec_id % 7 = 0 OR vec_id >= 1000")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = np.round(np.clip(unit @ unit.T, 0, 1), 6)
    np.fill_diagonal(c, -1)
    want = {i: int(c[i].argmax()) for i in range(0, len(x), 7)}
    for how in ({"shard": 50, "pivots": 10}, {"shard": 10**6, "pivots": 1}, {}):
        got = {r.query_id: (r.vec_id, r.cosine) for r in retrieval.cosine_max(df, queries, **how).collect()}
        assert {i: v for i, (v, _) in got.items()} == want and all(s == round(float(c[i, v]), 4) for i, (v, s) in got.items())
    assert retrieval.cosine_max(df.where("false"), queries).count() == 0 and retrieval.cosine_max(df, queries.where("false")).count() == 0


def test_cosines_held_at_a_time():
    """Queries that stream past a shard in one large batch are multiplied piece by piece: memory doesn't follow the batch."""
    rng = np.random.default_rng(4)
    n, m = 8192, 4000
    x = np.concatenate([rng.normal(size=(n, 8)), rng.normal(size=(m, 8))])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * (n + m) + 1, 8), pa.int32()), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n + m, np.int64)), pa.array(np.arange(n + m) >= n), pa.array(np.arange(n + m)), lists], names=["shard", "asked", "id", "v"])
    tracemalloc.start()
    got = [r for b in retrieval._nearest(iter([batch])) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [r["vec_id"] for r in got[:500]] == np.round(np.clip(u[n : n + 500] @ u[:n].T, 0, 1), 6).argmax(1).tolist()
    assert len(got) == m and most < 80e6  # all at once: over 500 MB


def test_overlap_sends_the_best_only(spark):
    """Counted in tasks or by a join: the same; what leaves a task doesn't follow the corpus."""
    rng = random.Random(6)
    say = lambda k: "".join(rng.choices("abc ", k=k))
    texts = {i: say(rng.randint(0, 30)) for i in range(30)} | {90: "", 91: None, 92: "zzz", 93: "".join(rng.choices("abcdefghijklmnop", k=30_000))}
    docs = [(i, say(rng.randint(0, 80))) for i in range(400)] + [(500, "zzz"), (499, "z z z"), (501, None)] + [(600 - k, texts[93][k : 29_000 + k]) for k in range(3)]
    rng.shuffle(docs)
    t = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    grams = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))} if x else set()
    plain = {i: grams((x or "").replace(" ", "")) for i, x in docs}
    want = {}
    for i, x in texts.items():
        a = grams((x or "").replace(" ", ""))
        found = [(round(len(a & g) / len(a), 4), -j) for j, g in plain.items() if a & g]
        want[i] = (max(found)[0], -max(found)[1]) if found else (0.0, None)
    for most in (1 << 22, 5):
        assert {r.item_id: (r.overlap, r.doc_id) for r in retrieval.ngram_overlap(t, d, most=most).collect()} == want
    asked = T.gram_hashes(t, "item_id", "text").distinct()
    sent = retrieval._best_shared(asked.toArrow(), d.coalesce(1).select("doc_id", T.question_key("text").alias("_t")), asked.schema[0], 5)
    met = asked.join(T.gram_hashes(d, "doc_id", "text"), "gram").select("item_id", "doc_id").distinct()
    assert sent.count() < 0.2 * met.count()


# ---------------------------------------------------------------- budgets


class Strict(http.server.BaseHTTPRequestHandler):
    """Refuses every third call, and notes when each came."""

    protocol_version = "HTTP/1.0"
    came: list = []
    lock = threading.Lock()

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        with self.lock:
            n = len(self.came)
            refuse = n % 3 == 2
            self.came.append((time.time(), body, refuse))
        self.send_response(500 if body == "bad" else 429 if refuse else 200)
        if refuse:
            self.send_header("Retry-After", "1")
        self.end_headers()
        if not refuse and body != "bad":
            self.wfile.write(body.upper().encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def strict():
    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Strict)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    Strict.came.clear()
    yield f"http://127.0.0.1:{httpd.server_port}/"
    httpd.shutdown()


def test_budget_of_calls(spark, strict):
    """Every third call is refused: no row is lost, the rate is kept, and what was given back goes into a later stage."""
    work = spark.createDataFrame([(i, f"q{i}") for i in range(40)] + [(90, None), (91, "bad")], "id long, request string")
    budget = paced.Budget(calls=20, slots=2, parallel=2, rounds=8)
    rows = paced.paced(work, endpoint.Endpoint(strict), budget).collect()
    assert sorted(r.id for r in rows) == [*range(40), 90, 91]
    told = {r.id: r for r in rows}
    assert all(told[i].answer == f"Q{i}" for i in range(40)) and told[90].error == "no request" and "500" in told[91].error and told[91].stage == 8
    came = sorted(t for t, *_ in Strict.came)
    assert sum(b.startswith("q") and not r for _, b, r in Strict.came) == 40  # each answered once
    assert max(Counter(int(t) for t in came).values()) <= 20 + 2 * 2 and max(r.stage for r in rows if r.id < 40) > 1
    after = [t for t, _, r in Strict.came if r]
    assert after  # a refusal holds its own task for a second
    assert paced.paced(work.where("false"), endpoint.Endpoint(strict), budget).count() == 0


def test_pace():
    """By a clock of its own: calls and tokens are both kept to, and a refusal holds everything."""
    now = [0.0]
    pace = paced.Pace(calls=2, tokens=100, clock=lambda: now[0])
    assert pace.wait(10) == 0 and pace.wait(10) == 0.5 and pace.wait(200) == 1.0 and pace.wait(1) == 3.0
    pace.hold(20)
    assert pace.wait(1) == 20
    now[0] = 100
    assert pace.wait(1) == 0


def test_tokens_of_a_stage(spark):
    class Quick:
        def call(self, request):
            return request

    work = spark.createDataFrame([(i, "x", 50) for i in range(12)], "id long, request string, tokens int")
    began = sorted(r.began for r in paced.paced(work, Quick(), paced.Budget(calls=1000, tokens=100, slots=1), cost="tokens").collect())
    assert began[-1] - began[0] >= 11 * 0.5 - 0.3


# ---------------------------------------------------------------- versions of stored datasets


def test_versions(spark, tmp_path):
    """Merges against a dict; files that a merge doesn't meet are listed again; old versions and pages stay as they are."""
    rng = random.Random(4)
    data = snapshots.Dataset(spark, str(tmp_path / "d"), ("k", "side"), rows_per_file=50)
    schema = "k long, side string, v int"
    there: dict = {}
    kept = {}
    for n in range(1, 7):
        low = rng.randint(0, 600)
        ks = range(0, 900, 3) if n == 1 else [rng.choice([None, *range(low, low + 40)]) for _ in range(30)]
        batch = [(k, rng.choice("ab"), rng.randint(0, 99)) for k in ks]
        update = n % 3 != 0
        before = {f.path for f in data.files()[0]} if n > 1 else set()
        assert data.merge(spark.createDataFrame(batch, schema), update, [F.col("v")]) == n
        for k, side, v in sorted(batch, key=lambda r: r[2], reverse=not update):
            if update or (k, side) not in there or (k, side) in {x[:2] for x in batch} - kept.get(n - 1, {}).keys():
                there[k, side] = v
        kept[n] = dict(there)
        files = data.files()[0]
        assert n == 1 or 0 < len(before - {f.path for f in files}) < len(before) or len(before) < 3
        spans = sorted((-1 if f.least is None else int(f.least), int(f.most or -1)) for f in files)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and sum(f.rows for f in files) == len(there)
    for n, want in kept.items():
        assert {(r.k, r.side): r.v for r in data.read(n).collect()} == want
    whole = sorted(there, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(r.k, r.side) for r in data.page(20, 130).collect()] == whole[130:150] and [(r.k, r.side) for r in data.page(9, len(whole) - 3).collect()] == whole[-3:]
    assert len(data.page(5, 130).inputFiles()) <= 2 < len(data.files()[0]) and data.page(5, 10**6).count() == 0
    assert [r.k for r in data.after(500, 7).collect()] == [k for k, _ in whole if k is not None and k > 500][:7] and len(data.after(500, 7).inputFiles()) <= 2
    assert data.merge(spark.createDataFrame([], schema)) == 7 and data.files()[0] == data.files(6)[0] and data.versions() == list(range(1, 8))
    with pytest.raises(ValueError, match="no version"):
        data.read(99)


def test_readers_and_writers_at_the_same_time(spark, tmp_path):
    """Two writers: both merges count. A reader that began before sees its version to the end."""
    data = snapshots.Dataset(spark, str(tmp_path / "d"), ("k",), rows_per_file=20)
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k int, v string")
    data.merge(rows(range(100), "old"))
    reader = data.read()
    threads = [threading.Thread(target=data.merge, args=(rows(ks, v),)) for ks, v in ((range(0, 50), "one"), (range(40, 110), "two"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert data.versions() == [1, 2, 3] and Counter(r.v for r in reader.collect()) == {"old": 100}
    now = {r.k: r.v for r in data.read().collect()}
    assert sorted(now) == list(range(110)) and all(now[k] == "one" for k in range(40)) and all(now[k] == "two" for k in range(50, 110)) and {now[k] for k in range(40, 50)} <= {"one", "two"} and len({now[k] for k in range(40, 50)}) == 1


def test_buckets_need_no_shuffle(spark, tmp_path):
    """A comparison of bucketed runs, and results with their rows, have no exchange in their plans; the result is that of plain tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rng = random.Random(5)
        schema = "row_id long, result_id long, is_pass boolean, error string, mean double"
        runs = [spark.createDataFrame([(rng.choice([None, *range(60)]), k, rng.choice([True, False, None]), rng.choice([None, "e"]), rng.random()) for k in range(150)], schema) for _ in range(2)]
        rows = spark.createDataFrame([(k, f"text {k}", "x") for k in range(40)], "row_id long, data string, error string")
        base, now, data = (buckets.bucketed(df, f"b_{name}_{tmp_path.name.replace('-', '_')}", f"{tmp_path}/{name}", buckets=8) for df, name in ((runs[0], "base"), (runs[1], "now"), (rows, "rows")))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        compared, joined = report.compare_runs(base, now), buckets.with_rows(now, data)
        assert "Exchange" not in plan(compared) and "Exchange" not in plan(joined) and "Exchange" in plan(report.compare_runs(*runs))
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert same(compared, report.compare_runs(*runs)) and same(joined, buckets.with_rows(runs[1], rows))
        assert joined.columns == ["row_id", "result_id", "is_pass", "error", "mean", "data"] and joined.count() == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("base", "now", "rows"):
            spark.sql(f"DROP TABLE IF EXISTS b_{name}_{tmp_path.name.replace('-', '_')}")
