"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as a word embedding (hashed vocabulary) beside the mean of its character
3- and 4-gram embeddings (hashed too). Windows of `WIDTH` words, `STRIDE` apart and so overlapping,
cover the whole text; both directions of the recurrent layer are pooled by a learned attention,
and a document's score is its highest window score.

Training uses a bounded sample of labelled rows: at most `positives` toxic and `negatives` clean
documents of at most `max_chars` characters, chosen by a hash of the id among the rows that are
not held out (crc32 of the id's text mod 5 is not 0). Embeddings start from document log-odds; all
parameters are then fitted by back-propagation through time with Adam.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import SLICE_BYTES, released, slices, word_bounds, word_hashes

WIDTH, STRIDE, BUCKETS, DIM, HIDDEN = 32, 24, 1 << 14, 6, 8
POSITIVES, NEGATIVES, MAX_CHARS = 800, 4800, 8_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[ord(c) for c in ".,;:!?\"'()"]] = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def vocabulary(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of folded texts: per word its row and its number among the distinct ones; per distinct word its bucket, its n-gram buckets and where these start."""
    data = _FOLD[data]
    parts, lo, n = [], 0, len(offsets) - 1
    while lo < n:  # a slice at a time: the arrays of a slice are many times its bytes
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        cut = data[offsets[lo] : offsets[hi]]
        s, e, r = word_bounds(cut, offsets[lo : hi + 1] - offsets[lo])
        parts.append((s + offsets[lo], e + offsets[lo], r + lo, word_hashes(cut, s, e)))
        lo = hi
    starts, ends, rows, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    code, distinct = pd.factorize(hashes)
    first = np.full(len(distinct), len(code), np.int64)
    np.minimum.at(first, code, np.arange(len(code)))
    lens = (ends - starts)[first] + 2  # with a mark on either side
    at = np.cumsum(lens) - lens
    chars = np.full(int(lens.sum()), 2, np.uint64)
    inner = np.arange(int((lens - 2).sum())) - np.repeat(np.cumsum(lens - 2) - (lens - 2), lens - 2)
    chars[np.repeat(at + 1, lens - 2) + inner] = data[np.repeat(starts[first], lens - 2) + inner]
    owner = np.repeat(np.arange(len(lens)), lens)
    grams, owners = [], []
    for n in (3, 4):
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(1_000_003) + chars[j : j + len(h)]
        ok = owner[: len(h)] == owner[n - 1 :]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        grams.append(h[ok].astype(np.int64))
        owners.append(owner[: len(ok)][ok])
    gram, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owners))
    order = np.argsort(own, kind="stable")
    return rows, code, (distinct >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), gram[order], np.searchsorted(own[order], np.arange(len(lens)))


def embed(model: dict, bucket: np.ndarray, gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(bucket):
        return np.zeros((0, 2 * DIM), np.float32)
    n = np.diff(np.append(at, len(gram)))
    return np.hstack([model["word"][bucket], np.add.reduceat(model["gram"][gram], at, axis=0) / n[:, None]]).astype(np.float32)


def windows(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of every window; each row has one at least, of no words if it has none."""
    count = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(count) - count
    n = np.maximum(1, -(-(count - WIDTH) // STRIDE) + 1)
    row = np.repeat(np.arange(n_rows), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[row] + k * STRIDE
    return row, start, np.minimum(WIDTH, begin[row] + count[row] - start)


def forward(model: dict, proj: tuple[np.ndarray, np.ndarray], index: np.ndarray, keep: bool = False):
    """Window logits. proj: the input projections of each distinct word for both directions; the last row of each is for no word. index: (windows, WIDTH) numbers of words, -1 for none."""
    b, states, traces = len(index), [], []
    mask = (index >= 0).astype(np.float32)
    for d in (0, 1):
        u, h = model["u"][d], np.zeros((b, HIDDEN), np.float32)
        out = np.zeros((WIDTH, b, HIDDEN), np.float32)
        for t in range(WIDTH) if d == 0 else range(WIDTH - 1, -1, -1):
            x = proj[d][index[:, t]]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            z = z * mask[:, t : t + 1]  # no word: the state stays
            new = h + z * (c - h)
            if keep:
                traces.append((d, t, h, zr, c, z))
            h = out[t] = new
        states.append(out)
    both = np.concatenate(states, 2)  # WIDTH, b, 2 HIDDEN
    e = np.tanh(both @ model["v"]) @ model["a"]
    e = np.where(mask.T > 0, e, -1e9)
    w = np.exp(e - e.max(0))
    w = w * mask.T / np.maximum((w * mask.T).sum(0), 1e-9)
    pooled = (w[:, :, None] * both).sum(0)
    logit = pooled @ model["o"] + model["bias"][0]
    return (logit, both, w, pooled, traces, mask) if keep else logit


def project(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    zero = np.zeros((1, 3 * HIDDEN), np.float32)
    return tuple(np.vstack([x @ model["w"][d] + model["c"][d], zero]) for d in (0, 1))


def gradients(model: dict, x: np.ndarray, index: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean log loss by back-propagation through time; 'x' is that of the distinct words' inputs."""
    proj = project(model, x)
    logit, both, w, pooled, traces, mask = forward(model, proj, index, keep=True)
    b, H = len(y), HIDDEN
    d_logit = (_sigmoid(logit) - y) / b
    g = {k: np.zeros_like(v) for k, v in model.items() if k not in ("word", "gram")}
    g["bias"][0], g["o"] = d_logit.sum(), pooled.T @ d_logit
    d_pool = d_logit[:, None] * model["o"][None, :]
    d_both = w[:, :, None] * d_pool[None]
    d_w = (both * d_pool[None]).sum(2)
    d_e = w * (d_w - (w * d_w).sum(0))
    act = np.tanh(both @ model["v"])
    g["a"] = np.einsum("tb,tbk->k", d_e, act)
    d_act = d_e[:, :, None] * model["a"] * (1 - act * act)
    g["v"] = np.einsum("tbi,tbk->ik", both, d_act)
    d_both = d_both + d_act @ model["v"].T
    d_x = np.zeros_like(x)
    for d in (1, 0):
        d_h, d_proj, u = np.zeros((b, H), np.float32), np.zeros_like(proj[d]), model["u"][d]
        for dd, t, h, zr, c, z in reversed(traces):
            if dd != d:
                continue
            d_h = d_h + d_both[t][:, d * H : d * H + H]
            r, raw = zr[:, H:], zr[:, :H]
            d_z = d_h * (c - h) * mask[:, t : t + 1] * raw * (1 - raw)
            d_c = d_h * z * (1 - c * c)
            d_rh = d_c @ u[:, 2 * H :].T
            d_r = d_rh * h * r * (1 - r)
            g["u"][d][:, 2 * H :] += (r * h).T @ d_c
            d_zr = np.hstack([d_z, d_r])
            g["u"][d][:, : 2 * H] += h.T @ d_zr
            d_h = d_h * (1 - z) + d_rh * r + d_zr @ u[:, : 2 * H].T
            np.add.at(d_proj, index[:, t], np.hstack([d_zr, d_c]))
        d_proj = d_proj[:-1]
        g["w"][d], g["c"][d] = x.T @ d_proj, d_proj.sum(0)
        d_x += d_proj @ model["w"][d].T
    g["x"] = d_x
    return g


def _log_odds(model: dict, rows: np.ndarray, code: np.ndarray, bucket: np.ndarray, gram: np.ndarray, at: np.ndarray, size: np.ndarray, toxic: np.ndarray) -> None:
    """Start each bucket's first dimension from how much likelier a toxic document has it; shrunk where few documents do."""
    seen = {k: np.zeros((2, BUCKETS)) for k in ("word", "gram")}
    cuts = np.searchsorted(rows, np.arange(0, len(toxic) + 100, 100))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # a hundred documents at a time
        pair = np.unique(rows[lo:hi] * len(bucket) + code[lo:hi])
        row, word = pair // len(bucket), pair % len(bucket)
        n = size[word]
        flat = np.repeat(at[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        for k, who, what in (("word", row, bucket[word]), ("gram", np.repeat(row, n), gram[flat])):
            once = np.unique(who * BUCKETS + what)
            hot = toxic[once // BUCKETS] > 0
            for side, m in enumerate((hot, ~hot)):
                seen[k][side] += np.bincount(once[m] % BUCKETS, minlength=BUCKETS)
    for k, (t, c) in seen.items():
        lo = np.log((t + 0.5) / (toxic.sum() + 1)) - np.log((c + 0.5) / ((toxic == 0).sum() + 1))
        model[k][:, 0] = np.clip(lo * (t + c) / (t + c + 4), -2, 5)


def train(texts: list[str], labels: list[int], epochs: int = 3, batch: int = 64, rate: float = 0.01, steps: int = 250) -> dict:
    """Fit the network to whole labelled texts: `epochs` passes, more while under `steps` steps. With one class only, it scores that class."""
    rng = np.random.default_rng(7)
    y = np.array(labels, np.float32)
    model = {
        "word": rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        "gram": rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        "w": rng.normal(0, 0.3, (2, 2 * DIM, 3 * HIDDEN)).astype(np.float32),
        "u": rng.normal(0, 0.2, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "c": np.zeros((2, 3 * HIDDEN), np.float32),
        "v": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)).astype(np.float32),
        "a": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        "o": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        model["o"][:] = 0
        model["bias"][0] = 20.0 if share else -20.0
        return model
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    rows, code, bucket, gram, at = vocabulary(np.frombuffer(b"".join(raw), np.uint8), off)
    size = np.diff(np.append(at, len(gram)))
    _log_odds(model, rows, code, bucket, gram, at, size, y)
    row, start, n = windows(rows, len(texts))
    index = start[:, None] + np.arange(WIDTH)
    index = np.where(np.arange(WIDTH) < n[:, None], code[np.minimum(index, max(0, len(code) - 1))] if len(code) else -1, -1)
    x = embed(model, bucket, gram, at)
    signal = np.append(np.maximum(x[:, 0], 0) + np.maximum(x[:, DIM], 0), 0)
    strength = np.sort(signal[index], 1)[:, -3:].sum(1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items()}
    step = epoch = 0
    while epoch < epochs or step < steps:
        if epoch >= 2:  # from then on the network itself names each document's leading windows
            strength = np.concatenate([forward(model, project(model, embed(model, bucket, gram, at)), part) for part in np.array_split(index, max(1, len(index) // 4096))])
        epoch += 1
        order = np.lexsort((-strength, row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        chosen = order[(rank < np.where(y[row[order]] > 0, 1, 3)) | ((y[row[order]] == 0) & (rng.random(len(order)) < 0.1))]
        rng.shuffle(chosen)
        for part in np.array_split(chosen, max(1, len(chosen) // batch)):
            used, local = np.unique(index[part], return_inverse=True)
            local = local.reshape(len(part), WIDTH)
            if used[0] < 0:
                used, local = used[1:], local - 1
            sizes = size[used]
            lo = np.cumsum(sizes) - sizes
            grams = gram[np.repeat(at[used] - lo, sizes) + np.arange(int(sizes.sum()))]
            g = gradients(model, embed(model, bucket[used], grams, lo), local, y[row[part]])
            d_x = g.pop("x")
            g["word"], g["gram"] = np.zeros_like(model["word"]), np.zeros_like(model["gram"])
            np.add.at(g["word"], bucket[used], d_x[:, :DIM])
            np.add.at(g["gram"], grams, np.repeat(d_x[:, DIM:] / np.maximum(1, sizes)[:, None], sizes, 0))
            step += 1
            for k, v in model.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def score_texts(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, code, bucket, gram, at = vocabulary(data, offsets)
    proj = project(model, embed(model, bucket, gram, at))
    row, start, n = windows(rows, len(offsets) - 1)
    best = np.full(len(offsets) - 1, -np.inf)
    for lo in range(0, len(row), 4096):
        at = start[lo : lo + 4096, None] + np.arange(WIDTH)
        index = np.where(np.arange(WIDTH) < n[lo : lo + 4096, None], code[np.minimum(at, len(code) - 1)] if len(code) else -1, -1)
        np.maximum.at(best, row[lo : lo + 4096], forward(model, proj, index))
    return _sigmoid(best)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, max_chars: int = MAX_CHARS) -> dict:
    """Train on the bounded sample of labelled rows that are not held out (ids null or without a text: left out; of an id's texts the least, of its labels the highest)."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.select("doc_id", F.length("text").alias("chars")).where(F.col("chars") <= max_chars).select("doc_id").distinct()
    known = labels.join(short, "doc_id")
    picked = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, positives), (0, negatives))]
    ids = picked[0].unionByName(picked[1])  # at most positives + negatives rows: small enough to broadcast
    sample = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
        held = io.BytesIO()
        np.savez(held, **train([r["text"] for r in rows], [r["toxic"] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()])], names=["model"])

    # one task holds the sample, which is bounded by the three parameters
    found = sample.coalesce(1).mapInArrow(lambda b: released(run(b)), "model binary").collect()
    return dict(np.load(io.BytesIO(found[0]["model"]))) if found else train([], [])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts score as a window without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(shared.value, data, off).astype(np.float64))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: released(run(b)), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score in 0..1, predicted (1 from 0.5 on).

    Null ids (not held out), null and empty texts, and repeated rows are scored like any other, each
    by its own whole text; extra columns are ignored; an empty table gives none. Without a label the
    model is the untrained one, which calls nothing toxic.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of docs that score below `at`, with all their columns as they are; rows without a text stay, repeated rows and null ids are judged by their text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch):
                yield part.filter(pa.array(score_texts(model.value, data, off) < at))

    has_text = F.length("text") > 0
    return docs.where(has_text).mapInArrow(lambda b: released(run(b)), docs.schema).unionByName(docs.where(~F.coalesce(has_text, F.lit(False))))
