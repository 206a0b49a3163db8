"""Column functions and operators on small inputs with known results."""

import csv
import glob
import io
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from evalspark.functions import scores as S
from evalspark.functions import text as T
from evalspark.operators import blind, corpus, ingest, judge, lifecycle, metrics, report, retrieval
from evalspark.sources import endpoint, files, sse
from evalspark.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize(("retrieved", "gold", "k", "want"), [("ab", "b", 2, 1.0), ("ab", "b", 1, 0.0), ("ab", "", 5, None), ("", "b", 5, 0.0)])
def test_hit_rate(spark, retrieved, gold, k, want):
    assert one(spark, S.hit_rate(arr(*retrieved), arr(*gold), k)) == want


@pytest.mark.parametrize(("retrieved", "gold", "want"), [("abc", "c", 0.3333), ("xy", "z", 0.0), ("z", "z", 1.0), ("a", "", None)])
def test_reciprocal_rank(spark, retrieved, gold, want):
    assert one(spark, S.reciprocal_rank(arr(*retrieved), arr(*gold))) == want


def calls(*cs):
    return F.from_json(F.lit(__import__("json").dumps([{"name": n, "args": a} for n, a in cs])), "array<struct<name:string,args:map<string,string>>>")


def test_tool_calls(spark):
    actual = [("query_order", {"id": "ORD-1"}), ("create_return", {"id": "ORD-2", "item": "x"}), ("query_order", {"id": "ORD-1"})]
    expected = [("query_order", {"id": "ORD-1"}), ("create_return", {"id": "ORD-1", "item": "x"})]
    texts = lambda cs: arr(*[f"{n}{sorted(a.items())}" for n, a in cs])
    assert one(spark, S.tool_call_accuracy(texts(expected), texts(actual))) == 0.5
    assert one(spark, S.argument_correctness(calls(*expected), calls(*actual))) == 0.75
    assert one(spark, S.step_efficiency(F.lit(2), F.lit(3))) == 0.6667
    assert one(spark, S.step_efficiency(F.lit(0), F.lit(3))) is None


def greedy(expected, actual):
    used, total = set(), 0.0
    for name, args in expected:
        best = None
        for i, (n, a) in enumerate(actual):
            if i in used or n != name:
                continue
            s = (1.0 if not a else 0.8) if not args else sum(a.get(k) == v for k, v in args.items()) / len(args)
            if best is None or s > best[0]:
                best = (s, i)
        if best:
            used.add(best[1])
            total += best[0]
    return round(total / len(expected), 4) if expected else None


def test_argument_correctness_is_greedy(spark):
    rng = random.Random(3)
    call = lambda: (rng.choice("pq"), {k: rng.choice("12") for k in rng.sample("xyz", rng.randint(0, 2))})
    cases = [([call() for _ in range(rng.randint(0, 3))], [call() for _ in range(rng.randint(0, 4))]) for _ in range(60)]
    import json

    pack = lambda cs: json.dumps([{"name": n, "args": a} for n, a in cs])
    df = spark.createDataFrame([(i, pack(e), pack(a)) for i, (e, a) in enumerate(cases)], "i int, e string, a string")
    kind = "array<struct<name:string,args:map<string,string>>>"
    got = {r.i: r.s for r in df.select("i", S.argument_correctness(F.from_json("e", kind), F.from_json("a", kind)).alias("s")).collect()}
    for i, (e, a) in enumerate(cases):
        assert got[i] == pytest.approx(greedy(e, a), abs=1e-4) if e else got[i] is None


def test_clamp_keeps_null(spark):
    assert one(spark, T.clamp(F.lit(None).cast("double"))) is None
    assert one(spark, S.cosine(F.array().cast("array<double>"), arr(1.0))) == 0.0
    assert one(spark, S.cosine(arr(1.0, 0.0, 5.0), arr(1.0, 0.0))) == 1.0


def test_tokens(spark):
    assert one(spark, T.bigram_tokens(F.lit("BM25 Index v1.5"))) == ["bm25", "index", "v1", "5"]
    assert one(spark, T.bigram_tokens(F.lit("云"))) == ["云"]
    assert one(spark, T.bigram_tokens(F.lit("云购物"))) == ["云购", "购物"]
    assert one(spark, T.bigram_tokens(F.lit("???"))) == []
    for s in ("AB c DEFG", "ab", "", "𝒜bcdefg"):
        flat = "".join(s.split()).lower()
        want = list(dict.fromkeys(flat[i : i + 5] for i in range(max(1, len(flat) - 4)))) if flat else []
        assert one(spark, T.char_ngrams(F.lit(s))) == want
    assert one(spark, T.norm(F.lit("　a   b\n"))) == "a b"
    assert one(spark, T.strip(F.lit("　a  b\n"))) == "a  b"


def test_json(spark):
    assert one(spark, T.json_object(F.lit('sure: {"score": 0.5} ok'))) == '{"score":0.5}'
    assert one(spark, T.json_object(F.lit("[1]"))) is None
    assert one(spark, T.json_object(F.lit("no"))) is None
    assert one(spark, T.coerce_float(F.lit("about -0.25 of it"))) == -0.25
    assert one(spark, T.coerce_float(F.lit("True"))) == 1.0
    assert one(spark, T.coerce_float(F.lit("x"))) is None
    assert one(spark, T.path_get(F.lit('{"a":[{"b":7}]}'), "a.0.b")) == "7"
    assert one(spark, T.list_text(F.lit("a\nb"))) == ["a", "b"]
    assert one(spark, T.list_text(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(spark, T.render("{x}-{y}-{{z}}", {"x": F.lit("1")})) == "1--{{z}}"
    assert one(spark, T.mask_secret(F.lit("sk-0123456789abcdef"))) == "sk-01234****cdef"


def test_labels(spark):
    allowed = arr("Good", "Bad")
    assert [one(spark, S.discrete(F.lit(x), allowed)) for x in ("Bad", "good", "it is bad", "none")] == ["Bad", "Good", "Bad", None]
    assert one(spark, S.numeric(F.lit(None).cast("double"), F.lit("Yes"))) == 1.0


def test_aggregates(spark):
    s = spark.createDataFrame([(1, 0, 0.8, "a"), (1, 1, 0.6, "b"), (1, 2, 0.7, "c")], "k int, idx int, score double, reason string")
    r = report.sampled(s, "k").first()
    assert (r.score, r.score_std, r.reason) == (0.7, 0.0816, "c")
    p = report.panel(s.withColumn("judge", F.col("reason")), "k").first()
    assert (p.score, p.judge_mad) == (0.7, 0.0667)
    v = spark.createDataFrame([(1, 0, "pass"), (1, 1, "fail"), (1, 2, "pass"), (2, 0, "x"), (2, 1, "y")], "k int, idx int, label string")
    assert {r.k: r.label for r in report.majority(v, "k").collect()} == {1: "pass", 2: "x"}
    w = spark.createDataFrame([("a", 0.9, 1.0), ("b", 0.5, 3.0), ("c", None, 1.0)], "metric string, mean double, weight double")
    r = report.weighted_total(w).first()
    assert (r.weighted_total, r.metric_count) == (0.6, 2)
    rows = [("pass", True)] * 4 + [("fail", False)] * 4 + [("pass", False), ("fail", True), (None, True)]
    a = report.agreement(spark.createDataFrame([(m, x, None) for m, x in rows], "manual string, is_pass boolean, error string")).first()
    assert (a.n, a.agreement, a.kappa, a.suggest_review) == (10, 0.8, 0.6, True)


def test_correlation(spark):
    import pandas as pd

    rng = random.Random(1)
    pdf = pd.DataFrame({"x": [float(rng.randint(0, 9)) for _ in range(200)], "y": [rng.random() for _ in range(200)]})
    r = report.correlation(spark.createDataFrame(pdf)).first()
    assert r.pearson == pytest.approx(pdf.x.corr(pdf.y), abs=1e-4)
    assert r.spearman == pytest.approx(pdf.x.rank().corr(pdf.y.rank()), abs=1e-4)
    flat = report.correlation(spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")).first()
    assert flat.pearson is None and flat.spearman is None


def test_bm25(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(10)] + [(99, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "words"), (2, "other")], "query_id long, text string")
    got = sorted((r.query_id, r.doc_id, r["rank"]) for r in retrieval.bm25(docs, queries, 3).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_recall(spark):
    rows = spark.createDataFrame([(1, "alpha beta；gamma delta", ["alpha beta x"]), (2, "a", []), (3, None, ["a"])], "id long, reference string, contexts array<string>")
    assert {r.id: r.rule_recall for r in retrieval.rule_recall(rows, "id", "reference", "contexts").collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def loop(weights, total):
    """Allocation by the plain loop."""
    some = [w for w in weights if w[1] > 0]
    want = total or max(1, round(sum(w[1] for w in some)))
    order = sorted(some, key=lambda w: (-w[1], -w[2], w[0]))
    got = {w[0]: 0 for w in some}
    for w in order[:want]:
        got[w[0]] += 1
    rest = max(0, want - len(some))
    share = sorted(some, key=lambda w: (max(0, w[1] * want / sum(x[1] for x in some) - 1), w[0]), reverse=True)
    for k in range(rest):
        got[share[k % len(share)][0]] += 1
    return got


def test_allocation(spark):
    rng = random.Random(5)
    for total in (None, 3, 40):
        chunks = [(i, rng.randint(0, 2), rng.randint(1, 5)) for i in range(12)]
        df = spark.createDataFrame([(0, *c) for c in chunks], "job int, chunk int, n_questions int, n_chars int")
        assert {r.chunk: r.allocated for r in corpus.allocate(df, "job", "chunk", total=total).collect()} == loop(chunks, total)


def test_quality(spark):
    texts = ["第 3 页 / 共 9 页", "编制：甲 审核人：乙 版本号 1", "家长签名：____ 学生姓名：____", "sdf KJHk wer", "学生应当遵守下列规则：上课前五分钟进入教室，迟到者由班主任登记；请假须提前一天提出书面申请，经批准后方可离校。连续三次迟到的，学校可以通知监护人。"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "i int, text string")
    got = {r.i: (r.quality, r.label, r.n_questions) for r in corpus.quality(df).collect()}
    assert [got[i][2] for i in range(4)] == [0, 0, 0, 0]
    assert got[4][1] in ("filtered", "good") and got[5] == got[6] == (0.0, "filtered", 0)
    plain = corpus.quality(df.where("i = 4").withColumn("text", F.regexp_replace("text", "班主任", "老师"))).first()
    assert plain.label == "good" and plain.n_questions >= 1


def test_pages(spark):
    pages = spark.createDataFrame([(1, 1, "手册标题内容\n第 1 页\n学生应当准时到校上课"), (1, 2, "手册标题内容\n第 2 页\n请假须提前一天申请"), (1, 3, None)], "doc int, page int, text string")
    got = {r.page: r.text for r in corpus.clean_pages(pages, "doc", "page").collect()}
    assert got == {1: "学生应当准时到校上课", 2: "请假须提前一天申请", 3: ""}


def test_lines_take_their_normal_form_once(spark):
    """A page of many long lines: making their normal form for every word of every rule took minutes."""
    odd = "".join(map(chr, (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x202F, 0x205F, 0x3000)))
    texts = [None, "", "\n", f"a{odd}b{odd}\n{odd}\n{odd}c", "x\u200by\n é  漢 "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.normal_lines("text").alias("got"), F.transform(F.split("text", "\n"), T.norm).alias("want")).collect()
    assert all(r.got == r.want for r in rows) and rows[3].got == ["a b", "", "c"]
    line = "wörter ohne  Ende " * 20_000
    pages = spark.createDataFrame([(1, k, "\n".join([f"{line}{k}{j}" for j in range(5)] + ["12", "kurz und gut"])) for k in range(8)], "doc int, page int, text string")
    began = time.time()
    got = corpus.clean_pages(pages, "doc", "page").collect()
    assert {r.page: r.text for r in got} == {k: "\n".join(" ".join(f"{line}{k}{j}".split()) for j in range(5)) for k in range(8)}
    assert time.time() - began < 40


def test_path_set_names_its_map_once(spark):
    """Each level's map is computed once: named again in lambdas, three levels parsed a row's JSON over and over."""
    rows = spark.createDataFrame([('{"a": {"b": {"x": 1}, "y": [1]}, "k": 2}',), ('{"a": 5}',), ('{"k": null}',), (None,), ("no json",)], "j string")
    put = T.json_text(T.path_set(T.json_map("j"), "a.b.c", F.lit("7")))
    got = [r[0] for r in rows.select(put.alias("w")).collect()]
    assert got == ['{"a":{"b":{"c":7,"x":1},"y":[1]},"k":2}', '{"a":{"b":{"c":7}}}', '{"a":{"b":{"c":7}},"k":null}', None, None]
    plan = rows.select(put.alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("JsonToStructs") <= 8


def test_chunks(spark):
    body = "这一节说明具体的办理步骤和需要注意的事项，内容足够长以便单独成为一个条目。"
    text = "\n".join(f"{n} 标题{n}\n{body}" for n in ("4.2.1", "4.2.2", "4.3.1"))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.content for r in corpus.chunk(one, size=420).orderBy("chunk_index").collect()]
    assert any("4.2.1" in c and "4.2.2" in c for c in got) and not any("4.2.1" in c and "4.3.1" in c for c in got)
    long = "x" * 2000
    cut = corpus.length_chunks(long, 900, 120)
    assert all(len(c) <= 900 for c in cut) and cut[0] == "x" * 900 and len("".join(cut)) >= 2000
    assert corpus.length_chunks("  ") == [] and corpus.length_chunks("a\n\nb", 900) == ["a\n\nb"]
    df = spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string")
    assert corpus.chunk(df).groupBy("doc_id").count().collect()[0][1] == len(cut)


def test_import(spark):
    have = spark.createDataFrame([("q", "a", 0)], "user string, answer string, row_index long")
    new = spark.createDataFrame([("q", "a", 0), ("n", "b", 1), ("q", "a", 2)], "user string, answer string, line long")
    assert [(r.user, r.row_index) for r in ingest.import_new(have, new, ["user", "answer"], "line").collect()] == [("n", 1)]
    empty = have.where("false")
    assert sorted(r.row_index for r in ingest.import_new(empty, new, ["user", "answer"], "line").collect()) == [0, 1]
    rows = spark.createDataFrame([("", "x", None)], "a string, n string, c string")
    fields = [{"name": "a", "required": True}, {"name": "n", "type": "number"}, {"name": "zz", "required": True}]
    assert ingest.validate(rows, fields).first().errors == ["a: missing", "n: not a number", "zz: missing"]
    assert rows.select(ingest.missing_fields(rows, ["n", "c", "b"]).alias("m")).first().m == ["b", "c"]


def test_blind(spark):
    rows = spark.createDataFrame([(1, "x", "y", "left", ["b", "a"]), (1, "x", None, "skip", ["a", "b"]), (1, None, None, None, None)], "t int, answer_a string, answer_b string, vote string, display_order array<string>")
    r = blind.tally(rows, "t").first()
    assert (r.total, r.completed, r.voted, r.wins_a, r.wins_b, r.pending, r.no_answer) == (3, 2, 1, 0, 1, 2, 1)


def test_judge(spark):
    rows = spark.createDataFrame([(1, "red car", "red car", ["the red car"], {"hidden": 1}), (2, "red", None, None, None)], "id int, user_input string, response string, retrieved_contexts array<string>, generation_meta map<string,int>")
    got = {r.id: r for r in judge.judge(rows, ["id"], "faithfulness", judge.Offline()).collect()}
    assert got[1].score == 1.0 and got[1].error is None and got[2].score is None and got[2].reason.startswith("missing")
    sent = rows.select(judge.payload("faithfulness", rows).alias("p")).first().p
    assert "generation_meta" not in sent and "user_input" not in sent

    class Silent:
        def answer(self, task, requests):
            return ["no idea" for _ in requests]

    assert judge.judge(rows, ["id"], "faithfulness", Silent()).where("error IS NOT NULL").count() == 1
    claims = {r.id: (r.score, r.n_claims) for r in judge.claim_faithfulness(rows, "id", judge.Offline()).collect()}
    assert claims == {1: (1.0, 1), 2: (None, 0)}
    swapped = judge.swap_lists(spark.createDataFrame([("q", ["a", "b"])], "u string, c array<string>")).first()
    assert (swapped.u, swapped.c) == ("q", ["b", "a"])


def test_questions(spark):
    c = spark.createDataFrame([(1, 0, "What is it?", 2), (1, 1, "what is  IT?", 2), (1, 2, "文档提到了什么", 2), (1, 3, "Why?", 2), (1, 4, "How?", 2)], "chunk int, no int, question string, allocated int")
    v = spark.createDataFrame([(1, "Why?", True, 0.9), (1, "How?", False, 1.0)], "chunk int, question string, keep boolean, score double")
    assert {(r.question, r.score) for r in judge.select_questions(c, v, "chunk", "no").collect()} == {("Why?", 0.9), ("What is it?", 0.5)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('q,tags,v\n"x\ny","[""A""]",NaN\n')
    r = files.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert (r.q, r.tags, r.v) == ("x\ny", '["A"]', None)
    (tmp_path / "b.txt").write_bytes("云购物平台说明文件内容".encode("gbk"))
    (tmp_path / "c.md").write_text("  \n")
    assert [(r["name"], r.text) for r in files.read_texts(spark, str(tmp_path), "*.{txt,md}").collect()] == [("b", "云购物平台说明文件内容")]
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json_rows(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "e.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a list"):
        files.read_json_rows(spark, str(tmp_path / "e.json")).collect()


def test_sse(spark):
    said = ['data: {"text": "a"}', "", 'data: {"text":', 'data: "b"}', "", "data: [DONE]"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(said)] + [(2, 0, 'data: {"text": "x"}'), (2, 1, "data: "), (2, 2, 'data: {"final_answer": "whole"}')], "r int, n int, line string")
    assert {x.r: x.answer for x in sse.answers(sse.frames(df.where("r = 1"), "r", "n"), "r", "n").collect()} == {1: "ab"}
    assert sse.answers(sse.data_lines(df.where("r = 2"), "r", "n"), "r", "n").first().answer == "whole"


def test_endpoint(spark):
    p = F.lit('{"data": {"answer": "yes", "docs": ["1"]}}')
    r = spark.range(1).select(*endpoint.fields(p, {"docs": "data.docs"}), endpoint.errors(p, {"docs": "data.docs", "z": "z"}).alias("bad")).first()
    assert (r.response, r.docs, r.bad) == ("yes", '["1"]', ["z"])


def test_endpoint_long_answer(spark, monkeypatch):
    """Fields are read from the whole of a long answer; only the raw copy is cut."""
    body = json.dumps({"data": {"answer": "é" * 30_000, "docs": ["1"]}}, ensure_ascii=False)
    monkeypatch.setattr(endpoint.urllib.request, "urlopen", lambda *a, **k: io.BytesIO(body.encode()))
    df = spark.createDataFrame([(endpoint.Endpoint("http://x").answer("", ["{}"])[0],)], "p string")
    r = df.select(*endpoint.fields(F.col("p"), {"docs": "data.docs"}), endpoint.raw(F.col("p")).alias("raw")).first()
    assert (r.response, r.docs, r.raw) == ("é" * 30_000, '["1"]', body[:20_000])


def test_stale(spark):
    runs = spark.sql("SELECT * FROM VALUES (1, 'running', timestamp'2024-01-01 00:00:00'), (2, 'running', timestamp'2024-01-01 00:00:00'), (3, 'completed', timestamp'2024-01-01 00:00:00') t(run, status, started_at)")
    beats = spark.sql("SELECT 2 AS run, timestamp'2024-01-01 01:50:00' AS ts")
    assert [r.run for r in progress.stale(runs, beats, F.expr("timestamp'2024-01-01 02:00:00'"), "run").collect()] == [1]


def test_compare(spark):
    base = spark.createDataFrame([(1, 1, True, None, 0.5), (2, 2, False, None, 0.4), (3, 3, True, None, 0.8), (3, 2, False, None, 0.0)], "row_id int, result_id int, is_pass boolean, error string, mean double")
    now = spark.createDataFrame([(1, 1, False, None, 0.5), (2, 2, True, None, 0.85), (4, 4, None, "e", None)], "row_id int, result_id int, is_pass boolean, error string, mean double")
    assert {r.row_id: r.bucket for r in report.compare_runs(base, now).collect()} == {1: "new_failures", 2: "fixed", 3: "missing_current", 4: "missing_baseline"}


def test_docx(spark, tmp_path):
    import zipfile

    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(b"no")
    assert {r["name"]: r.text for r in files.read_docx(spark, str(tmp_path)).collect()} == {"a": "one\ntwo", "b": None}
    blocks = spark.createDataFrame([(5.0, 20.0, 1000.0, 100.0, 10.0, "第 1 页"), (500.0, 520.0, 1000.0, 100.0, 10.0, "学生应当准时到校上课，不得迟到"), (500.0, 900.0, 1000.0, 500.0, 400.0, "x")], "y0 double, y1 double, page_height double, width double, height double, text string")
    assert files.body_blocks(blocks).count() == 1


def test_sync(spark):
    rows = spark.createDataFrame([(10, 0, "a"), (11, 1, "b")], "row_id long, row_index long, data string")
    samples = spark.createDataFrame([(1, 11, "B"), (3, None, "d"), (2, None, "c")], "sample_id long, dataset_row_id long, data string")
    assert sorted(map(tuple, ingest.sync_samples(rows, samples).collect())) == [(10, 0, "a"), (11, 1, "B"), (12, 2, "c"), (13, 3, "d")]
    chunks = spark.createDataFrame([(1, 2, "done"), (2, 1, "failed"), (3, 0, "done"), (4, 1, "done")], "chunk_id long, allocated int, status string")
    done = spark.createDataFrame([(1, True), (2, True)], "chunk_id long, selected boolean")
    assert sorted(r.chunk_id for r in ingest.chunk_scope(chunks, done).collect()) == [4]
    assert sorted(r.chunk_id for r in ingest.chunk_scope(chunks, done, "retry_failed").collect()) == [2, 4]
    d = spark.createDataFrame([(1, "rag", ["q", "r"])], "dataset_id long, sample_type string, fields array<string>")
    s = spark.createDataFrame([(7, "rag", ["q", "z", "r", "y"]), (8, "agent", ["q"])], "scenario_id long, sample_type string, required array<string>")
    assert [(r.scenario_id, r.lacking) for r in ingest.compatible(d, s, ["y"]).collect()] == [(7, ["z"])]


def test_write_back(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "1"})], "id int, data map<string,string>")
    found = spark.createDataFrame([(1, {"b": "3", "c": "4"})], "id int, data map<string,string>")
    assert {r.id: r.data for r in ingest.write_back(rows, found, "id").collect()} == {1: {"a": "1", "b": "3", "c": "4"}, 2: {"a": "1"}}
    sent = rows.select(judge.custom_payload(F.col("data"), ["b"]).alias("p")).first().p
    assert sent == '{"b":"2","a":"1"}'


# ---------------------------------------------------------------- chunking, by hand

REGULATION = """适用范围：本办法适用于全部车间的设备点检与保养工作。
4.2 点检安排
4.2.1 日检：操作人员应当在开机之前完成点检，并把结果写入点检卡。
4.2.2 周检：维修人员每周五下午检查润滑、紧固与安全防护。
4.2.3 同一台设备当月出现三次以上异常的，车间应当停机检修。
4.3
保养事务
4.3.1 保养计划由设备科在每月月底之前下发到各个车间。
4.3.2 没有按照计划完成保养的，设备科可以通报并要求限期整改。"""


def _chunks(spark, text, **how):
    rows = corpus.chunk(spark.createDataFrame([(1, text)], "doc_id long, text string"), **how).orderBy("chunk_index").collect()
    assert [r.chunk_key for r in rows] == [f"doc-1-chunk-{i}" for i in range(len(rows))] and all(r.char_count == len(r.content) for r in rows)
    return [r.content for r in rows]


def test_sections_by_hand(spark):
    """A short intro joins the first section; sections of one parent merge, under one heading of their parent; a number of its own takes the next line."""
    lines = REGULATION.split("\n")
    assert _chunks(spark, REGULATION, size=420) == ["\n".join(lines[:5]), "\n".join(["4.3 保养事务", *lines[7:]])]
    # lines of a section that stand anywhere in the earlier one stay: only those at the same place go
    same = "1.1 甲乙丙丁\n请各部门按照要求执行本规定。\n第一条内容如下所述。\n1.2 戊己庚辛\n第一条内容如下所述。\n请各部门按照要求执行本规定。"
    assert _chunks(spark, same, size=420) == [same]
    # two sections, of which one is a form: one entry is left, so the text is cut by length
    form = "1.1 家长签名\n学生姓名"
    assert _chunks(spark, form, size=420) == [form]
    # a section above others counts on its own if it says something
    above = "2.1 总述\n" + "本章规定了各部门在执行制度时应当遵守的步骤与流程，包括申请、审批与归档。" + "\n2.1.1 申请\n员工应当提前三天提交申请。\n2.1.2 审批\n部门负责人应当在一天内审批。"
    got = _chunks(spark, above, size=100)
    assert got[0].startswith("2.1 总述\n本章") and "2.1 总述\n2.1.1 申请" in "\n".join(got)


def test_lengths_by_hand(spark):
    text = "a" * 500 + "。" + "b" * 600
    assert _chunks(spark, text, structured=False) == ["a" * 500 + "。", "a" * 119 + "。" + "b" * 600]
    # the first kind of break wins, not the last place; one too early doesn't count
    text = "x" * 300 + "。" + "y" * 300 + "；" + "z" * 100 + "，" + "w" * 500
    assert _chunks(spark, text, structured=False)[0] == "x" * 300 + "。" + "y" * 300 + "；"
    # the rest of a long paragraph gathers the next ones
    text = "p" * 950 + "\n" + "q" * 100 + "\n\n" + "r" * 640
    assert _chunks(spark, text, structured=False) == ["p" * 900, "p" * 170 + "\n" + "q" * 100, "r" * 640]
    assert corpus.length_chunks("a" * 10, 5, 4) == ["aaaaa"] * 6


def test_quality_reasons(spark):
    rows = spark.createDataFrame([(0, "第 3 页"), (1, "操作人员应当遵守要求。"), (2, "家长签名与学生姓名回执"), (3, "lorem ipsum dolor sit amet"), (4, None)], "i int, text string")
    got = {r.i: r.reasons for r in corpus.quality(rows).collect()}
    assert got[0] == got[4] == ["页眉页脚/页码噪声"] and got[1] == ["文本过短", "正文特征较弱", "包含规则/流程型正文"] and got[2] == ["表单/回执字段"] and got[3] == ["OCR 乱码或低可读文本"]
    letters = spark.createDataFrame([(0, "éàü" * 3 + "汉字汉字汉字汉字")], "i int, text string")
    assert letters.select(corpus.is_garbled(F.col("text")).alias("g")).first().g is False  # over six Chinese characters
    assert spark.createDataFrame([(0, "éàüéà 汉字")], "i int, text string").select(corpus.is_garbled(F.col("text")).alias("g")).first().g  # letters with accents count as signs
    assert spark.createDataFrame([(0, " " + "1.2" + ".3" * 3)], "i int, text string").select(corpus.is_header(F.col("text")).alias("g")).first().g


# ---------------------------------------------------------------- clients, reports, exports, streams


def test_clients(spark, monkeypatch):
    sent = []

    class Reply(io.BytesIO):
        pass

    def urlopen(request, timeout):
        body = json.loads(request.data)
        sent.append((request.headers, body))
        if "input" in body:
            return Reply(json.dumps({"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}).encode())
        return Reply(json.dumps({"choices": [{"message": {"content": "said " + body["messages"][-1]["content"]}}]}).encode())

    monkeypatch.setattr(endpoint.urllib.request, "urlopen", urlopen)
    chat = endpoint.Chat("http://x", model="m", prompts={"t": "be brief"}, parallel=3)
    assert chat.answer("t", ["a", "b", "c", "d"]) == ["said a", "said b", "said c", "said d"]
    assert sent[0][1]["messages"][0] == {"role": "system", "content": "be brief"} and sent[0][1]["response_format"] == {"type": "json_object"}
    sent.clear()
    assert endpoint.Embeddings("http://x", model="e").embed(["a" * k for k in range(130)]) == [[float(k)] for k in range(130)] and [len(b["input"]) for _, b in sent] == [64, 64, 2]
    assert endpoint.Endpoint("http://x", stream=True)._headers()["Accept"] == "text/event-stream"
    rows = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in endpoint.embed(rows, "text", endpoint.Hashed(8)).collect()}
    assert got[2] is None and sum(got[1]) == 3


def test_prior_report(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"metrics": {"a": {"scores": [0.5, None, 1]}, "b": {"scores": [1]}}}))
    found = lifecycle.prior_report(spark, str(path), ["a"], 3)
    assert sorted((r.row_index, r.score) for r in found.collect()) == [(0, 0.5), (1, None), (2, 1.0)]
    for name in ("b", "c"):
        with pytest.raises(Exception, match="not 3 scores"):
            lifecycle.prior_report(spark, str(path), [name], 3).collect()


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", ["x"]), (0, 'a "q", é', None)], "row_index long, name string, tags array<string>")
    lifecycle.write_lines(lifecycle.json_lines(rows, "row_index"), str(tmp_path / "j"), "row_index")
    text = next((tmp_path / "j").glob("part-*.txt")).read_text("utf-8")
    assert json.loads(text) == [{"name": 'a "q", é', "tags": None}, {"name": "b", "tags": ["x"]}] and text.startswith("[\n  {\n")
    lifecycle.write_lines(lifecycle.csv_lines(rows, ["name", "tags"], "row_index"), str(tmp_path / "c"), "row_index")
    raw = next((tmp_path / "c").glob("part-*.txt")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname,tags") and list(csv.reader(io.StringIO(raw.decode("utf-8-sig")))) == [["name", "tags"], ['a "q", é', ""], ["b", '["x"]']]
    lifecycle.append_results(rows.withColumn("run", F.lit(1)), str(tmp_path / "t"), "run")
    lifecycle.append_results(rows.withColumn("run", F.lit(2)), str(tmp_path / "t"), "run")
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("run").count().count() == 2


def test_refusals(spark):
    run = lambda d, s, m: F.struct(F.lit(d).alias("dataset_id"), F.lit(s).alias("scenario_id"), F.array(*map(F.lit, m)).alias("metrics"))
    cases = [run(1, 1, ["b", "a"]), run(2, 1, ["a", "b"]), run(1, 2, ["a", "b"]), run(1, 1, ["a"])]
    got = spark.range(1).select(*[lifecycle.refusal(run(1, 1, ["a", "b"]), c).alias(str(k)) for k, c in enumerate(cases)]).first()
    assert list(got) == [None, "dataset", "scenario", "metrics"]
    a = spark.createDataFrame([("m", 1, 0.5)], "metric string, row long, score double")
    with pytest.raises(Exception, match="different rows"):
        lifecycle.merge_reports(a, a.withColumn("row", F.col("row") + 1), ["row"], ["m"]).collect()
    with pytest.raises(Exception, match="no rows for 9"):
        files.keyed(spark.range(3), [1, 9], "id").collect()
    with pytest.raises(Exception, match="too many metrics"):
        lifecycle.scoring_grid(spark.range(1).withColumn("scenario_id", F.lit(1)), spark.range(3).select(F.lit(1).alias("scenario_id"), "id"), 2).collect()


def test_life_of_runs(spark):
    runs = spark.createDataFrame([(1, "running", None, None, 7, None), (2, "completed", None, None, 7, ["old"])], "run int, status string, error string, finished_at timestamp, scenario_id int, snapshot array<string>")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    got = {r.run: (r.status, r.error) for r in lifecycle.orphaned(runs, now).collect()}
    assert got == {1: ("failed", lifecycle.ORPHANED), 2: ("completed", None)}
    scenarios = spark.createDataFrame([(7, ["new"])], "scenario_id int, metrics array<string>")
    assert {r.run: r.snapshot for r in lifecycle.with_snapshots(runs, scenarios).collect()} == {1: ["new"], 2: ["old"]}
    left = spark.range(1).select(lifecycle.remaining(F.lit("2024-01-01 11:50:00").cast("timestamp"), now).alias("a"), lifecycle.remaining(F.lit(None).cast("timestamp"), now).alias("b"), lifecycle.remaining(F.lit("2024-01-01 10:00:00").cast("timestamp"), now).alias("c")).first()
    assert tuple(left) == (300, 900, 0)
    rows = spark.createDataFrame([(k,) for k in ("z", "b", "a")], "m string")
    assert [r.m for r in rows.orderBy(*lifecycle.listed_first(rows, "m", ["b"])).collect()] == ["b", "a", "z"]
    results = spark.createDataFrame([(1, 1), (1, 5), (2, 9)], "run int, ts int")
    stops = spark.createDataFrame([(1, 3)], "run int, ts int")
    assert sorted(map(tuple, progress.cancelled(results, stops, "run").collect())) == [(1, 1), (2, 9)]


def test_progress_files(spark, tmp_path):
    """State goes to files, batch by batch; the last one counts."""
    source = tmp_path / "in"
    schema = "run string, ts timestamp, error string"
    make = lambda rows: spark.createDataFrame(rows, "run string, t string, error string").select("run", F.col("t").cast("timestamp").alias("ts"), "error").coalesce(1).write.mode("append").parquet(str(source))
    make([("a", "2024-01-01 10:00:00", None), ("b", "2024-01-01 10:00:00", "x")])
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(source))
        progress.to_files(progress.progress(stream, "run"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        make([("a", "2024-01-01 11:00:00", None)])
    got = {r.run: (r.done, r.errors) for r in progress.current(spark.read.parquet(str(tmp_path / "out")), "run").collect()}
    assert got == {"a": (2, 0), "b": (1, 1)}


def test_custom_metric_requests(spark):
    """What a prompt holds already isn't sent again; hidden and internal fields never; long values are cut."""

    class Echo:
        def answer(self, task, requests):
            return [json.dumps({"score": 1, "reason": r}) for r in requests]

    rows = spark.createDataFrame([(1, "q", "r" * 3000, ["c"] * 20, "secret", "in", 3)], "id int, user_input string, response string, retrieved_contexts array<string>, generation_meta string, _x string, extra int")
    m = metrics.Custom("m", "numeric", "{dataset.user_input}: {extra} of {metric.score_range} {{keep}} {nothing}", bounds=(0, 5))
    asked = json.loads(json.dumps({}))
    got = metrics.custom_judge(rows, ["id"], m, Echo()).first()
    asked = got.reason
    assert got.score == 1.0 and '"prompt":"q: 3 of 0 到 5 {{keep}} "' in asked and "secret" not in asked and '"_x"' not in asked and "user_input" not in asked.split('"sample"')[1] and "extra" not in asked.split('"sample"')[1]
    sent = rows.select(judge.payload("faithfulness", rows).alias("p")).first().p
    v = json.loads(sent)
    assert list(v) == ["response", "retrieved_contexts"] and v["response"] == "r" * 2400 + "...[truncated]" and len(v["retrieved_contexts"]) == 12
    override = judge.judge(rows, ["id"], "faithfulness", Echo(), required=(), prompt="own words").first().reason
    assert '"criteria":"own words"' in override
    assert set(judge.CRITERIA) == set(judge.CATALOG) and len(judge.CATALOG) == 17


# ---------------------------------------------------------------- ties and repeats


def test_ties_are_decided(spark):
    """Equal order values: the same row whatever the partitions, in every operator that picks one."""
    votes = [(1, 7, "R"), (1, 7, "N"), (1, 7, "R"), (1, 7, "N"), (2, 3, "b"), (2, 3, "a"), (3, 1, None), (3, 1, "z")]
    samples = [(1, 7, 0.5, "b"), (1, 7, 0.5, "a"), (1, 7, 0.5, "c")]
    for n in (1, 3, 7):
        v = spark.createDataFrame(votes, "k int, idx int, label string").repartition(n)
        assert {r.k: r.label for r in report.majority(v, "k").collect()} == {1: "N", 2: "a", 3: "None"}
        s = spark.createDataFrame(samples, "k int, idx int, score double, reason string").repartition(n)
        assert report.sampled(s, "k").collect()[0].reason == "a"
        rows = spark.createDataFrame([(1, 5, "x", {"a": 1}), (1, 5, "y", {"a": 2})], "k int, o int, v string, m map<string,int>").repartition(n)
        assert report.last_of(rows, ["k"], "o").collect()[0].v == "y" and lifecycle.latest(rows, [F.col("o")], "k").collect()[0].v == "x"


def test_ranges(spark):
    rng = random.Random(3)
    for values in ([rng.gauss(0, 1) for _ in range(3000)], [1.0] * 50, list(range(700)), []):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = sorted((r.x, r._p) for r in report.with_range(df, df, "x", 256).collect())
        assert [p for _, p in got] == sorted(p for _, p in got) and len(got) == len(values)
        assert {x: p for x, p in got} == dict(got) and (len(values) < 700 or len({p for _, p in got}) > 200)


def test_exports_with_ties(spark, tmp_path):
    """Rows of one row_index, equal rows, numbers beyond 2^53, null indexes: valid JSON, every row once."""
    big = 2**60
    given = [(big + 1, "c"), (big, "b"), (big, "b"), (big, "a"), (None, "n"), (None, None)]
    df = spark.createDataFrame(given, "row_index long, name string").repartition(3)
    lifecycle.write_lines(lifecycle.json_lines(df, "row_index"), str(tmp_path / "j"), "row_index")
    (path,) = glob.glob(f"{tmp_path}/j/part-*")
    assert [x["name"] for x in json.load(open(path))][2:] == ["a", "b", "b", "c"] and len(json.load(open(path))) == 6
    lifecycle.write_lines(lifecycle.json_lines(df.where("false"), "row_index"), str(tmp_path / "e"), "row_index")
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "e")).collect())) == []
    lifecycle.write_lines(lifecycle.csv_lines(df, ["name"], "row_index"), str(tmp_path / "c"), "row_index")
    (path,) = glob.glob(f"{tmp_path}/c/part-*")
    assert open(path, encoding="utf-8-sig").read().split("\n")[0] == "name" and sorted(open(path, encoding="utf-8-sig").read().split("\n")[1:-1]) == ["", "a", "b", "b", "c", "n"]


def test_upsert_of_repeated_and_null_keys(spark):
    schema = "k string, v int, at int"
    there = spark.createDataFrame([("a", 1, 0), (None, 2, 0)], schema)
    batch = spark.createDataFrame([("a", 10, 1), ("b", 20, 1), ("b", 21, 2), ("b", 22, 2), (None, 30, 1), ("c", None, 1)], schema).repartition(3)
    found = lambda df: sorted(((r.k, r.v) for r in df.collect()), key=str)
    assert found(lifecycle.upsert(there, batch, ["k"], order=[F.col("at")])) == [("a", 1), ("b", 20), ("c", None), (None, 2)]
    assert found(lifecycle.upsert(there, batch, ["k"], update=True, order=[F.col("at")])) == [("a", 10), ("b", 22), ("c", None), (None, 30)]
    assert found(lifecycle.upsert(there, batch, ["k"], update=True)) == [("a", 10), ("b", 22), ("c", None), (None, 30)]


def test_characters(spark):
    """The counts of one pass are those of the regular expressions."""
    rng = random.Random(6)
    texts = ["".join(rng.choices([" ", "\n", "\t", "\x1c", " ", "　", "a", "Z", "7", "。", "!", ";", "：", "漢", "é", "𝒜", "_", "​", "￿"], k=rng.randint(0, 30))) for _ in range(400)] + ["", " \n ", "x" * 100_000]
    c, s = T.compact("t"), T.strip("t")
    want = [F.length(c), F.length(s), T.chars_of("t", corpus.MARKS[1:-1]), T.chars_of(c, corpus.CJK_RANGE), T.chars_of(c, "A-Za-z"), T.chars_of(c, "0-9"), T.chars_of(s, "。！？.!?;\n")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(corpus.characters(F.col("t")).alias("got"), F.struct(*[w.cast("int") for w in want]).alias("want")).collect()
    assert all(tuple(r.got) == tuple(r.want) for r in rows)
