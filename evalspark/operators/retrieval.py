"""Retrieval over inverted indexes: BM25, hit scenarios, n-gram and embedding contamination."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions import scores as S
from evalspark.functions import text as T
from evalspark.functions.stored import MOST, among, handed, release, stored

K1, B = 1.5, 0.75
BLOCK, LEAD = 64, 4  # ids a block of postings spans; blocks a query scores before it knows its k-th score
NGRAM_LIMIT, COSINE_LIMIT = 0.8, 0.92
CELLS, SENT = 1 << 20, 256  # cosines, or weights, that a task holds at a time; queries that it deals out at a time, each to any number of cells


def postings(docs: DataFrame, doc: str, text: str, wanted: Broadcast | None = None) -> DataFrame:
    """(doc, len, terms, tfs): each row once, with its length (null: no text) and (of `wanted`) its terms' hashes and numbers."""
    keyed = docs.select(F.struct(F.col(doc).alias("id"), F.col(text).isNull().alias("void")).alias("_k"), text)
    return T.term_counts(keyed, "_k", text, wanted).select(F.col("_k.id").alias(doc), F.when(~F.col("_k.void"), F.col("len")).alias("len"), "terms", "tfs")


def _block(doc: str, kind: ty.DataType, size: int) -> Column:
    """The range of ids a document is in; ids that aren't numbers are dealt out."""
    return F.floor(F.col(doc) / size).cast("long") if isinstance(kind, ty.IntegralType) else F.pmod(F.xxhash64(doc), F.lit(1 << 20))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, doc: str = "doc_id", query: str = "query_id", text: str = "text", block: int = BLOCK, most: int = MOST) -> DataFrame:
    """The k best documents of each query: query, doc, score, rank (ties to the smaller doc). Documents without a positive score are not returned.

    The average length counts empty documents too, but no null texts. Texts are read once. Tasks are handed the queries'
    terms if these are few enough: each scores its documents piece by piece and sends a query's k best
    only, so what it holds follows the queries, not the documents. Else weights and terms meet by a
    join: they lie in blocks of `block` ids by term, each with its highest weight; what these add up
    to bounds a block's scores for a query. A query scores the blocks of its highest bounds first; the
    k-th score there, at least, is the k-th of all, so only blocks whose bound reaches it are scored
    besides. Both are exact. Rows that share an id are one document, or one query.
    """
    asked = stored(_asked(queries, query, text), "bm25-asked")
    few = asked.limit(most + 1).toArrow()
    if few.num_rows <= most:
        scored = _scored(docs, few, asked.schema[query], k, doc, text)
        release(asked)
    else:
        found = _pruned(docs, asked, k, doc, query, text, block)
        scored = found["first"].unionByName(found["rest"])
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last(doc)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _asked(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term): each once."""
    return T.term_counts(queries, query, text).select(query, F.explode("terms").alias("term")).distinct()


def _exploded(counts: DataFrame, doc: str) -> DataFrame:
    """(doc, len, term, tf) of `postings`."""
    return counts.select(doc, "len", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(doc, "len", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


def _weight() -> Column:
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def _counted(docs: DataFrame, doc: str, text: str, wanted: Broadcast | None, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame, list[DataFrame]]:
    """`postings` of the ids that have one row; (doc, term, w) of the others, or None; (term, idf, avg_len); the tables that these read.

    Rows of one id and length are one, whose numbers add up; rows of one id and several lengths are several, whose weights add up.
    """
    whole = stored(postings(docs, doc, text, wanted), "bm25-counts")
    asked = lambda hits: hits if wanted is not None else hits.join(terms.distinct(), "term", "left_semi")
    again = stored(whole.groupBy(doc).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(doc).alias("_d")), "bm25-again")
    tables, once, twice = [whole, again], whole, None
    if not again.isEmpty():
        same = F.col(doc).eqNullSafe(F.col("_d"))
        once = whole.join(again, same, "left_anti")
        merged = asked(_exploded(whole.join(again, same, "left_semi"), doc)).groupBy(doc, "len", "term").agg(F.sum("tf").alias("tf"))
        twice = stored(merged, "bm25-twice")
        tables.append(twice)
    hits = asked(_exploded(once, doc)).select("term")
    df = (hits if twice is None else hits.unionByName(twice.select("term"))).groupBy("term").agg(F.count("*").alias("df"))
    stats = whole.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    idf = stored(df.crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len"), "bm25-idf")  # stats is one row
    sums = None if twice is None else twice.join(idf, "term").groupBy(doc, "term").agg(F.sum(_weight()).alias("w"))
    return once, sums, idf, [*tables, idf]


def _scored(docs: DataFrame, asked: pa.Table, name: ty.StructField, k: int, doc: str, text: str) -> DataFrame:
    """(query, doc, score): of each query of `asked` (query, term) the k best of every task."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(np.unique(asked.column("term").to_numpy()))
    once, sums, idf, tables = _counted(docs, doc, text, wanted)
    shared = _handed_terms(asked, idf)
    send = lambda rows, weighs: rows.mapInArrow(_best_scored(shared, k, weighs), ty.StructType([name, docs.schema[doc], ty.StructField("score", ty.DoubleType())]))
    best = send(once.select(doc, "terms", "tfs", "len"), True)
    if sums is not None:
        lists = sums.groupBy(doc).agg(F.collect_list(F.struct("term", "w")).alias("x"))  # at most the terms of `wanted`
        best = best.unionByName(send(lists.select(doc, "x.term", "x.w"), False))
    best = stored(best, "bm25-best")
    release(*tables)
    return best


def _handed_terms(asked: pa.Table, idf: DataFrame) -> Broadcast:
    """For every task: the terms that documents have, sorted, their idf and the average length; where each term's queries begin, those queries, and the queries' names."""
    known = idf.toArrow().sort_by("term")
    terms = known.column("term").to_numpy()
    named = asked.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
    code, term = named.indices.to_numpy(), asked.column("term").to_numpy()
    there = among(term, terms)
    code, term = code[there], term[there]
    order = np.argsort(term, kind="stable")
    cuts = np.append(np.searchsorted(term[order], terms), len(term))
    mean = known.column("avg_len")[0].as_py() if len(terms) else 1.0
    return idf.sparkSession.sparkContext.broadcast((terms, known.column("idf").to_numpy(), mean, cuts, code[order], named.dictionary))


def _first_of_each(q: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, by score and then by place; a query's own stand together, in that order."""
    order = np.lexsort((place, -score, q))
    start = np.flatnonzero(np.diff(q[order], prepend=-1))
    return order[np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k]


def _best_scored(shared: Broadcast, k: int, weighs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (doc, terms, numbers, len), or (doc, terms, weights) if it needn't weigh: each query's k best of all of them.

    It holds some CELLS weights, or one document's, and a few times the k best of each query.
    """

    def places(docs: pa.Array) -> np.ndarray:
        out = np.empty(len(docs), np.int64)
        out[pc.sort_indices(docs, null_placement="at_end").to_numpy()] = np.arange(len(docs))
        return out

    def pieces(fan: np.ndarray, lens: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of documents that have no more than CELLS weights, or of one."""
        total = np.concatenate(([0], np.cumsum(fan)))[np.concatenate(([0], np.cumsum(lens)))]
        lo = 0
        while lo < len(lens):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CELLS, "right")) - 1)
            yield lo, hi
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, mean, cuts, codes, names = shared.value
        n, least, parts, waiting = len(names), np.zeros(len(names)), [], 0

        def best() -> tuple:
            q, s, d = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts])
            at = _first_of_each(q, s, places(d), k)
            q, s = q[at], s[at]
            last = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
            least[q[last]] = s[last]
            return q, s, d.take(pa.array(at))

        for batch in batches:
            docs, lists = batch.column(0), batch.column(1)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.cumsum(lens)))
            t = np.searchsorted(terms, lists.flatten().to_numpy())
            w = batch.column(2).flatten().to_numpy()
            if weighs:
                w = idf[t] * w * (K1 + 1) / (w + K1 * (1 - B + B * np.repeat(pc.fill_null(batch.column(3), 0).to_numpy(), lens) / mean))
            fan, order = cuts[t + 1] - cuts[t], places(docs)
            for lo, hi in pieces(fan, lens):
                a, b = first[lo], first[hi]
                f = fan[a:b]
                q = codes[np.repeat(cuts[t[a:b]] - np.concatenate(([0], np.cumsum(f)[:-1])), f) + np.arange(f.sum())] if a < b else np.zeros(0, np.int64)
                cell = np.repeat(np.repeat(np.arange(hi - lo), lens[lo:hi]), f) * n + q
                if (hi - lo) * n <= 4 * len(cell):
                    total = np.bincount(cell, np.repeat(w[a:b], f), (hi - lo) * n)
                    cell = np.arange(len(total))
                else:
                    cell, at = np.unique(cell, return_inverse=True)
                    total = np.bincount(at, np.repeat(w[a:b], f), len(cell))
                total = np.floor(total * 1e6 + 0.5) / 1e6
                row, q = np.divmod(cell, max(n, 1))
                some = np.flatnonzero((total > 0) & (total >= least[q]))
                row, q, total = row[some] + lo, q[some], total[some]
                at = _first_of_each(q, total, order[row], k)
                if not len(at):
                    continue
                parts.append((q[at], total[at], docs.take(pa.array(row[at]))))
                waiting += len(at)
                if waiting > len(parts[0][0]):  # the best so far come first
                    parts, waiting = [best()], 0
        if parts:
            q, s, d = best()
            for a in range(0, len(q), 1 << 16):
                z = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[z])), d.slice(a, 1 << 16), pa.array(s[z])], names=["query", "doc", "score"])

    return run


def scored_share(docs: DataFrame, queries: DataFrame, k: int = 5, doc: str = "doc_id", query: str = "query_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row: (query, term, document) weights that `bm25` adds up where it joins, those that there are, and the share."""
    found = _pruned(docs, stored(_asked(queries, query, text), "bm25-asked"), k, doc, query, text, block)
    n = lambda df: df.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    both = n(found["taken"]).select(F.col("n").alias("scored")).crossJoin(n(found["bounds"]).select(F.col("n").alias("all")))  # one row each
    return both.select("scored", "all", F.round(F.try_divide("scored", "all"), 4).alias("share"))


def _pruned(docs: DataFrame, asked: DataFrame, k: int, doc: str, query: str, text: str, block: int) -> dict[str, DataFrame]:
    wanted = handed(asked.select("term"))
    once, sums, idf, _ = _counted(docs, doc, text, wanted, asked.select("term"))
    weights = _exploded(once, doc).join(idf, "term").select(doc, "term", _weight().alias("w"))
    weights = weights if sums is None else weights.unionByName(sums)
    weighted = stored(weights.select("term", F.coalesce(_block(doc, docs.schema[doc].dataType, block), F.lit(-1)).alias("_b"), doc, "w"), "bm25-weights")
    highest = weighted.groupBy("term", "_b").agg(F.max("w").alias("_m"), F.count("*").alias("_n"))
    bounds = stored(asked.join(highest, "term").groupBy(query, "_b").agg(F.sum("_m").alias("_u"), F.sum("_n").alias("_n")), "bm25-bounds")

    def score(chosen: DataFrame) -> DataFrame:
        cells = asked.join(chosen.select(F.col(query).alias("_q"), "_b"), F.col(query).eqNullSafe(F.col("_q"))).select(query, "term", "_b")
        return cells.join(weighted, ["term", "_b"]).groupBy(query, doc).agg(F.round(F.sum("w"), 6).alias("score")).where("score > 0")

    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_u"), "_b"))
    leading = bounds.withColumn("_k", place).where(F.col("_k") <= LEAD)
    first = stored(score(leading), "bm25-first")
    nth = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score")))
    least = first.withColumn("_k", nth).where(F.col("_k") == k).select(query, F.col("score").alias("_least"))
    ranked = bounds.withColumn("_k", place).join(least, query, "left")
    left = ranked.where((F.col("_k") > LEAD) & (F.coalesce("_least", F.lit(0.0)) <= F.col("_u") + 1e-5))  # scores are rounded
    return {"first": first, "rest": score(left), "bounds": bounds, "taken": leading.select(query, "_n").unionByName(left.select(query, "_n"))}


def retrieval_means(hits: DataFrame, queries: DataFrame, k: int = 5, query: str = "query_id", doc: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean H@1, H@3, H@k and reciprocal rank of retrieved lists (query, doc, rank) against queries' gold ids (array `gold`); queries without gold are left out."""
    lists = hits.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", doc))), lambda x: x[doc]).alias("ids"))  # at most k a query
    rows = queries.join(lists, query, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return rows.groupBy(*by).agg(F.count(S.hit_rate("ids", "gold", 1)).alias("n"), mean(S.hit_rate("ids", "gold", 1), "h1"), mean(S.hit_rate("ids", "gold", 3), "h3"), mean(S.hit_rate("ids", "gold", k), "hk"), mean(S.reciprocal_rank("ids", "gold", None), "mrr"))


def _best_shared(asked: pa.Table, corpus: DataFrame, name: ty.StructField, n: int) -> DataFrame:
    """(text id, corpus id, _c): of each text the corpus rows that may be its best in their task, with the number of distinct n-grams they share.

    A row is sent if its share is higher than any before, or no more than a rounding lower; of equal
    ones only a smaller id. What a task holds follows the texts, not the corpus.
    """
    named = asked.column(0).combine_chunks().dictionary_encode()
    code, gram = named.indices.to_numpy(), asked.column("gram").to_numpy()
    order = np.argsort(gram, kind="stable")
    grams, first = np.unique(gram[order], return_index=True)
    shared = corpus.sparkSession.sparkContext.broadcast((grams, np.append(first, len(gram)), code[order], np.bincount(code, minlength=len(named.dictionary)), named.dictionary))
    key = corpus.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, cuts, codes, sizes, names = shared.value
        best, least = np.zeros(len(sizes)), np.full(len(sizes), np.iinfo(np.int64).max)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
            sent = [[np.zeros(0, np.int64)] * 3]
            for k, t in enumerate(batch.column(1).to_pylist()):
                h = np.unique(T.rolled(t, n)) if t and len(grams) else np.zeros(0, np.int64)
                at = np.flatnonzero(among(h, grams))
                if not len(at):
                    continue
                g = np.searchsorted(grams, h[at])
                lens = cuts[g + 1] - cuts[g]
                places = np.repeat(cuts[g] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
                u, c = np.unique(codes[places], return_counts=True)
                share = c / sizes[u]
                some = (share > best[u]) | ((share == best[u]) & (ids[k] < least[u])) | ((share < best[u]) & (share >= best[u] - 1.01e-4))
                u, c, share = u[some], c[some], share[some]
                top = share >= best[u]
                best[u[top]], least[u[top]] = share[top], ids[k]
                sent.append([u, np.full(len(u), k), c])
            u, k, c = map(np.concatenate, zip(*sent, strict=True))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(u)), batch.column(0).take(pa.array(k)), pa.array(c.astype(np.int64))], names=[name.name, key.name, "_c"])

    return corpus.mapInArrow(run, ty.StructType([name, key, ty.StructField("_c", ty.LongType())]))


def ngram_overlap(texts: DataFrame, corpus: DataFrame, text_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", n: int = 5, most: int = MOST) -> DataFrame:
    """Highest share of a text's n-grams that one corpus row has: text_id, overlap, doc_id (smallest on ties), contaminated. Texts that share nothing: 0.

    Tasks are handed the texts' n-grams if they are few enough: each counts its corpus rows one by
    one and sends a text's best only. Else n-grams meet by a join on their hash.
    """
    asked = T.gram_hashes(texts.where(F.col(text_id).isNotNull()), text_id, text, n).distinct()
    size = asked.groupBy(text_id).agg(F.count("*").alias("_n"))
    few = asked.limit(most + 1).toArrow()
    if few.num_rows <= most and isinstance(corpus.schema[doc_id].dataType, ty.IntegralType):
        shared = _best_shared(few, corpus.select(doc_id, T.question_key(text).alias("_t")), asked.schema[text_id], n)
    else:
        there = T.gram_hashes(corpus, doc_id, text, n).join(asked.select("gram").distinct(), "gram", "left_semi")
        shared = asked.join(there, "gram").groupBy(text_id, doc_id).agg(F.count("*").alias("_c"))
    rated = shared.join(size, text_id).select(text_id, doc_id, F.round(F.col("_c") / F.col("_n"), 4).alias("overlap"))
    best = rated.groupBy(text_id).agg(F.max(F.struct("overlap", (-F.col(doc_id)).alias("_d"))).alias("_b"))
    out = texts.select(text_id).join(best, text_id, "left").select(text_id, F.coalesce("_b.overlap", F.lit(0.0)).alias("overlap"), (-F.col("_b._d")).alias(doc_id))
    return out.withColumn("contaminated", F.col("overlap") >= NGRAM_LIMIT)


def contamination_tally(found: DataFrame, *by: str) -> DataFrame:
    """How many texts were held against the corpus, how many are contaminated, their share, and the highest overlap."""
    hit = F.count_if("contaminated")
    return found.groupBy(*by).agg(F.count("*").alias("n"), hit.alias("contaminated"), F.round(F.try_divide(hit, F.count("*")), 4).alias("share"), F.max("overlap").alias("highest"))


def _units(lists: pa.Array, n: int) -> np.ndarray:
    m = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of (unit or zero) rows to unit pivots."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + 1 - 2 * x @ pivots.T, 0))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, a shard's vectors before the queries that it may answer: vectors are held, queries stream past."""
    held, ids, parts = None, [], []
    for batch in batches:
        shard, asked, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (asked[1:] != asked[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if lo == hi:
                continue
            rows = batch.column(3).slice(lo, hi - lo)
            if not asked[lo]:
                if shard[lo] != held:
                    held, ids, parts = shard[lo], [], []
                ids.append(key[lo:hi])
                parts.append(_units(rows, hi - lo))
            elif shard[lo] == held:
                if len(parts) > 1:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                x, step = _units(rows, hi - lo), max(1, CELLS // len(ids[0]))
                for a in range(0, hi - lo, step):
                    q = key[lo:hi][a : a + step]
                    c = np.round(np.clip(x[a : a + step] @ parts[0].T, 0, 1), 6)
                    c[q[:, None] == ids[0][None]] = -1
                    at = c.argmax(1)  # the smallest id of equal ones: a shard is sorted by id
                    best = c[np.arange(len(q)), at]
                    found = best >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(q[found]), pa.array(ids[0][at][found]), pa.array(best[found])], names=["query_id", "vec_id", "cosine"])


def cosine_max(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", shard: int = 8192, pivots: int = 64) -> DataFrame:
    """The nearest other vector of each query by cosine (0 to 1): query_id, vec_id (smallest on ties), cosine.

    Some vectors, of the smallest hashes, are pivots. Every vector is dealt once, to its nearest
    pivot's shards of about `shard` rows. A query's cosine with a pivot is one that can be reached;
    the triangle inequality bounds those within a shard, by the query's distance from its pivot and
    the distances there; the query goes to the shards only whose bound is no lower. Exact. Vectors
    that are null or hold null or NaN components take no part; zero vectors have cosine 0.
    """
    columns = [F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")]
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("v") > 0)
    own, asked = (df.select(*columns).where(fine) for df in (vectors, queries))
    chosen = own.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id", "v").limit(pivots).collect()  # at most `pivots`
    if not chosen:
        chosen = own.limit(1).collect()
    if not chosen:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, cosine double, contaminated boolean")
    names, points = np.array([r.id for r in chosen]), np.array([r.v for r in chosen])
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _apart(_units(batch.column(1), batch.num_rows), points)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(d[np.arange(len(cell)), cell]), *batch.columns], names=["cell", "d", "id", "v"])

    dealt = stored(own.mapInArrow(deal, "cell long, d double, id long, v array<double>"), "cosine-cells")
    sizes = {r.cell: (r.n, r.lo, r.hi) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()}  # at most `pivots`
    cells = np.array(sorted(sizes))
    low, high = (np.array([sizes[c][k] for c in cells.tolist()]) for k in (1, 2))
    parts = {c: -(-sizes[c][0] // shard) for c in sizes}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, SENT) for b in batches for a in range(0, b.num_rows, SENT)):
            q, x = batch.column(0).to_numpy(), _units(batch.column(1), batch.num_rows)
            dots = np.where(q[:, None] == names[None], -np.inf, np.clip(x @ points.T, 0, 1))
            d = _apart(x, points)[:, cells]
            gap = np.maximum(np.maximum(d - high, low - d) - 1e-9, 0)
            bound = np.maximum(1 - gap * gap / 2, 0)
            row, cell = np.nonzero(bound >= dots.max(1)[:, None] - 2e-6)  # cosines are rounded to six digits
            for k in range(max(parts.values())):
                some = np.array([k < parts[c] for c in cells.tolist()])[cell]
                at = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([pa.array(cells[cell[some]] << 32 | k), batch.column(0).take(at), batch.column(1).take(at)], names=["shard", "id", "v"])

    sub = F.pmod(F.xxhash64("id"), F.element_at(F.create_map(*[F.lit(int(x)) for c in parts.items() for x in c]), F.col("cell")))
    left = dealt.select((F.shiftleft(F.col("cell"), 32) + sub).alias("shard"), F.lit(False).alias("asked"), "id", "v")
    right = asked.mapInArrow(send, "shard long, id long, v array<double>").select("shard", F.lit(True).alias("asked"), "id", "v")
    found = left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "asked", "id").mapInArrow(_nearest, "query_id long, vec_id long, cosine double")
    top = found.groupBy("query_id").agg(F.max(F.struct("cosine", (-F.col("vec_id")).alias("_v"))).alias("_b"))
    return top.select("query_id", (-F.col("_b._v")).alias("vec_id"), F.round("_b.cosine", 4).alias("cosine")).withColumn("contaminated", F.col("cosine") >= COSINE_LIMIT)


def rule_recall(rows: DataFrame, row: str, reference: str, contexts: str, least: float = 0.4) -> DataFrame:
    """Share of a reference's sentences of which some context covers `least` of the bigram tokens; 0 without a reference or contexts."""
    cut = lambda c: F.filter(F.split(c, "[。；\n]+"), lambda s: T.strip(s) != "")
    sentences = rows.select(row, contexts, F.explode_outer(cut(F.col(reference))).alias("_s")).withColumn("_t", F.array_distinct(T.bigram_tokens("_s")))
    cover = lambda s: F.try_divide(F.size(F.array_intersect(F.col("_t"), T.bigram_tokens(s))), F.size("_t")) >= least
    hit = F.exists(F.flatten(F.transform(F.coalesce(contexts, F.array().cast("array<string>")), cut)), lambda s: F.coalesce(cover(s), F.lit(False)))
    return sentences.groupBy(row).agg(F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 4).alias("rule_recall"))
