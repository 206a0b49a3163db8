"""License scans, centroid clusters and fill-in-middle against plain code, and their queries against SQL."""

import glob
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from evalspark.llm import clusters, fim, licenses, queries
from test_llm import DOCS, ODD, docs


# ---------------------------------------------------------------- 11


def plain(text, fill):
    """The wording as text: regions kept or left out, replaceable ones filled, as `fill` says."""
    text = re.sub(r'<<var;name="[^"]*";words="(\d+)-(\d+)">>', lambda m: " ".join(["somebody"] * fill.choice([int(m[1]), int(m[2])])), text)
    while "<<beginOptional>>" in text:
        text = re.sub(r"<<beginOptional>>((?:(?!<<beginOptional>>).)*?)<<endOptional>>", lambda m: m[1] if fill.random() < 0.5 else "", text)
    return text


def slow_places(words, markup, phrase=False):
    """Leftmost longest runs, by a regular expression over the words; a phrase's places may overlap."""
    joined, out, at = "".join(f" {w}" for w in words) + " ", [], 0
    regex = re.compile(licenses.pattern(markup, {} if phrase else licenses.SPELLINGS))
    begins = [m.start() for m in re.finditer(" (?=[^ ])", joined)]
    for k, b in enumerate(begins):
        if k < at:
            continue
        ends = [e for e in range(k + 1, len(begins) + 1) if regex.fullmatch(joined, b, (begins[e] if e < len(begins) else len(joined) - 1) + 1)]
        if ends:
            out.append((k, ends[-1]))
            at = k + 1 if phrase else ends[-1]
    return out


@pytest.mark.parametrize("label", sorted(licenses.WORDINGS))
def test_every_wording(label):
    rng = random.Random(label)
    scanner = licenses._scanner(*(tuple(d.items()) for d in (licenses.WORDINGS, licenses.PHRASES, licenses.SPELLINGS)))
    automaton = next(a for name, _, a in scanner.automata if name == label)

    def accepted(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        from evalspark.llm.common import word_bounds

        starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
        return automaton.longest(scanner.fold[scanner.numbers(data, starts, ends)].tolist()) == len(words)

    regex = re.compile(licenses.pattern(licenses.WORDINGS[label]))
    for _ in range(10):
        words = licenses.words_of(plain(licenses.WORDINGS[label], rng))
        assert accepted(words)
        for k in rng.sample(range(len(words)), min(8, len(words))):  # one word less, one more, another one
            for other in (words[:k] + words[k + 1 :], [*words[:k], "strange", *words[k:]], [*words[:k], "strange", *words[k + 1 :]]):
                assert accepted(other) == bool(regex.fullmatch("".join(f" {w}" for w in other) + " "))


def test_markup():
    assert licenses.parse('A <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;name="n";words="0-2">>d-e') == ["a", ["b", ["c"]], (0, 2), "d", "e"]
    for wrong in ("a b <<beginOptional>> c", "a b c <<endOptional>>", "a b <<var>>", 'a b <<var;name="x";words="3-2">>', 'a <<var;name="x";words="0-2">> b', "a", "a <<beginOptional>>b<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.Automaton(wrong)


def test_random_wordings(spark):
    """Small vocabulary, many ambiguous regions: places against regular expressions."""
    rng = random.Random(11)
    for _ in range(6):
        def region(depth=0):
            kind = rng.random()
            if kind < 0.55 or depth > 2:
                return rng.choice("abcd")
            if kind < 0.75:
                return f'<<var;name="x";words="{rng.randint(0, 1)}-{rng.randint(1, 3)}">>'
            return "<<beginOptional>>" + " ".join(region(depth + 1) for _ in range(rng.randint(1, 3))) + "<<endOptional>>"

        wordings = {f"w{k}": "a b " + " ".join(region() for _ in range(rng.randint(0, 5))) for k in range(3)}
        phrases, spellings = {"a b a": "aba", "c d": "cd"}, {"z": "a"}
        texts = [" ".join(rng.choices("abcdz", k=rng.randint(0, 40))).replace("b a", "b, A") for _ in range(60)]
        got = licenses.scan(docs(spark, texts), ["doc_id"], wordings, phrases, spellings).collect()
        for r in got:
            words = licenses.words_of(texts[r.doc_id])
            folded = ["a" if w == "z" else w for w in words]
            want = {(label, False, *p) for label, m in wordings.items() for p in slow_places(folded, m)} | {(label, True, *p) for m, label in phrases.items() for p in slow_places(words, m, phrase=True)}
            assert {(f.label, f.phrase, f.first_word, f.end_word) for f in r.found} == want and len(r.found) == len(want)


def test_licenses(spark):
    mit = licenses.WORDINGS["mit-text"].replace('<<var;name="liable";words="1-15">>', "THE AUTHORS OR COPYRIGHT HOLDERS").replace("<<beginOptional>>(including the next paragraph)<<endOptional>>", "")
    texts = [
        f"Copyright (c) 2020 Ä\n\n{mit}\nend", mit.replace("sublicense", "sublicence"), mit.replace("NONINFRINGEMENT", "INFRINGEMENT"), "Straße: the MIT\nLicence. mit-LICENSE mit license", "the GNU general public\tLicense, Version 3; apache license",
        "emit license", "mit licenses", "mitlicense", *ODD, "MIT License " * 30_000, mit + " " + "permission is hereby " * 20_000,
    ]
    df = docs(spark, texts).withColumn("Found", F.lit("clash"))
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert all(r.Found == "clash" and r.text == texts[i] for i, r in rows.items())
    assert [sorted({f.label for f in rows[i].found_}) for i in range(8)] == [["mit-text"], ["mit-text"], [], ["mit"], ["apache", "gpl", "gpl-3.0-statement"], [], [], []]
    for i, t in enumerate(texts):
        r = rows[i]
        assert r.n_words == len(licenses.words_of(t or ""))
        for f in r.found_[:50]:
            assert licenses.words_of(t[f.start : f.end]) == licenses.words_of(t)[f.first_word : f.end_word]
    assert [f.first_word for f in rows[3].found_] == [4, 6] and texts[0][rows[0].found_[0].start :].startswith("Permission")
    long = rows[len(texts) - 2].found_
    assert len(long) == 30_000 and [f.first_word for f in long] == list(range(0, 60_000, 2)) and len(rows[len(texts) - 1].found_) == 1
    assert rows[2].license_score == 0 and rows[3].license_score == 0.75 and rows[4].license_score == 1
    assert licenses.scan(df.where("false")).count() == 0 and licenses.scan(df.union(df)).count() == 2 * len(texts)


# ---------------------------------------------------------------- 12


def slow_kmeans(rows, k, rounds, scale=1024, seed=3):
    """Every vector against every centroid, in Python's whole numbers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) == 4]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))  # noqa: E731, B023
    for _ in range(rounds if centroids else 0):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    per = [sum(d for _, c, d in last if c == n) for n in range(len(centroids))]
    return sorted(((i, c, d, per[c], sum(per), tuple(centroids[c])) for i, c, d in last), key=str)


@pytest.mark.parametrize("case", ["spread", "ties", "few", "huge"])
def test_kmeans(spark, case):
    rng = random.Random(case)
    value = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: rng.choice([-1, 0, 1]) / 1024, "few": lambda: rng.random(), "huge": lambda: rng.choice([-1, 1]) * rng.random() * 60_000}[case]
    n = {"few": 3}.get(case, 120)
    rows = [(k % (n - 3) if case == "ties" else k, [value() for _ in range(4)]) for k in range(n)]
    rows += [(None, [value() for _ in range(4)]), (500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan")] * 4), (505, [float("inf"), 0.0, 0.0, 0.0]), rows[0], rows[0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(5)
    for k in (1, 5, 8):
        got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in clusters.annulus_kmeans(df, k=k, rounds=4, dim=4).collect()]
        assert sorted(got, key=str) == slow_kmeans(rows, k, 4)
    assert clusters.annulus_kmeans(df.where("false"), dim=4).count() == 0


def test_annulus(spark):
    """Far fewer comparisons than vectors x centroids where norms differ, and always the nearest, ties included."""
    rng = np.random.default_rng(12)
    for scale in (3, 1000, 2**25):
        centroids = rng.integers(-scale, scale, (40, 6)) * np.arange(1, 41)[:, None] // 40
        centroids[7] = centroids[21]  # equal ones: the smaller number wins
        x = np.concatenate([centroids[rng.integers(0, 40, 500)] + rng.integers(-1, 2, (500, 6)), rng.integers(-scale, scale, (500, 6))])
        d = ((x[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
        search = clusters.Annuli(centroids)
        best, dist = search.nearest(x)
        assert dist.tolist() == d.min(1).tolist() and best.tolist() == [row.tolist().index(row.min()) for row in d]
        assert scale == 3 or search.compared < 0.7 * d.size


def test_too_large(spark):
    with pytest.raises(Exception, match="64 bits"):
        clusters.annulus_kmeans(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dim=2).collect()


# ---------------------------------------------------------------- 13


def slow_fim(doc_id, text, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim(spark):
    rng = random.Random(13)
    pieces = ["\n", "\n\n", "a", "𝒜é", "<", "<P", "S>", "M>", "\r\n", " ", "line\n", "<<S", " "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(300)] + [*ODD, "\n", "no newline", "x<P>y", "<S>", "<M>\n", "line\n" * 200_000, "x" * 1_000_000 + "\ny"]
    df = docs(spark, texts).union(spark.createDataFrame([(None, "a\nb\nc", None, None, None), (5, texts[5], "en", "s", 0)], DOCS)).withColumn("N", F.lit("clash"))
    for rate, spm in ((100, 50), (40, 0), (0, 50), (100, 100)):
        got = fim.fill_in_middle(df, rate=rate, spm=spm)
        rows = got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            assert (r.n_, r.form, r.prefix_chars, r.middle_chars, r.output) == slow_fim(r.doc_id, r.text, rate, spm)
            assert r.back == (r.text or "") and r.N == "clash"
    forms = {r.form for r in fim.fill_in_middle(df).collect()}
    assert forms == {"plain", "spm", "psm"} and fim.fill_in_middle(df.where("false")).count() == 0


@pytest.mark.parametrize(("unit", "regex"), [("line", r"[^\n]*\n|[^\n]+"), ("word", r"\S+\s*|\s+"), ("char", r"(?s).")])
def test_units(unit, regex):
    rng = random.Random(unit)
    for _ in range(300):
        text = "".join(rng.choices([" ", "\n", "a", "bc", "𝒜", "\t", "　"], k=rng.randint(0, 12)))
        at = fim.boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4"), fim.UNITS[unit]).tolist()
        assert [text[a:b] for a, b in zip(at, at[1:])] == re.findall(regex, text)


def test_sentinels():
    for wrong in (("<P>", "<P>x", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError, match="told apart"):
            fim.check_sentinels(wrong)
    fim.check_sentinels(fim.SENTINELS)


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", ["op11_licenses", "op12_clusters", "op13_fim"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(queries.ORACLES[name])
    columns = want.columns
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_sql_of_odd_texts(spark, tmp_path):
    """The twins on texts the tables don't hold."""
    mit = licenses.words_of(plain(licenses.WORDINGS["mit-text"], random.Random(1)))
    texts = [*ODD, " ".join(mit).upper(), "a\n\nb\n", "\n", "<P>", "Under the terms of the MIT Licence", "CC BY-NC v4.0 é", "general public license general public license v3"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op11_licenses", "op13_fim"):
        want, got = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, str(tmp_path))
        assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
