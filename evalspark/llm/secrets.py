"""Secret scans: plain rules, and a linear-chain conditional random field decoded by Viterbi.

Tokens are the words of a text (runs outside ``\\x20\\x09-\\x0D``), tagged O, B (a secret begins)
or I (inside). Features: the token's shape (length class, which kinds of characters, how often
the kind changes, whether it has an assignment sign, or the sign of an address), whether the one or two words before
it name a secret or end in an assignment, and file features (share of digits and of assignment signs in the text). The
model is trained here, by the exact log likelihood (forward-backward in numpy), on generated
lines, of which the number is a parameter; no corpus row is needed.

Decoding is exact: a token whose O score beats its others by more than their transitions could ever
give back is O in every best path, so it cuts the chain, and Viterbi runs over the stretches that
are left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import bounds, free, released, slices, word_bounds, word_hashes

#: The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
LINES = 1500

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def rule_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start, then kind. Matches that are too short are dropped.

    A flag is false where the caller knows that the text can't hold that kind.
    """
    out = []
    if assign:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if access:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hexes:
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# ---------------------------------------------------------------- features

_CLASS = np.zeros((256, 5), np.int64)  # lower, upper, digit, sign, assignment
_CLASS[97:123, 0] = _CLASS[65:91, 1] = _CLASS[48:58, 2] = 1
_CLASS[[ord(c) for c in "+/_-."], 3] = _CLASS[[ord(c) for c in "=:"], 4] = 1
_KIND = np.where(_CLASS[:, 2] > 0, 2, np.where(_CLASS[:, 1] > 0, 1, 0)).astype(np.int8)
_FIELD = 21  # bits of a count; three counts are summed in one integer
_PACK = [_CLASS[:, k] + (_CLASS[:, k + 1] << _FIELD) + ((_CLASS[:, k + 2] << 2 * _FIELD) if k == 0 else 0) for k in (0, 3)]  # the third place of the second is for changes of kind
FEATURES = 26


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


_CUES = _hash_words(["password", "passwd", "secret", "token", "key", "apikey", "api_key", "credential", "credentials", "password:", "token:", "secret:", "key:", "bearer", "password=", "token=", "secret=", "authorization:"])
_CUE_STARTS = np.array(sorted({(w[0] << 16) + (w[1] << 8) + w[2] for w in (b"pas", b"sec", b"tok", b"key", b"api", b"cre", b"bea", b"aut")}))
_SIGNS = np.array(sorted(int.from_bytes(w, "big") for w in (b"=", b":", b":=", b"=>", b'="', b"is", b"->")))


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each token, its row, and the features: a row each, a column a token."""
    starts, ends, rows = word_bounds(data, offsets)
    n = len(starts)
    x = np.zeros((FEATURES, n), np.float32)
    if not n:
        return starts, ends, rows, x
    lens = ends - starts
    kind = _KIND[data]
    packed = _PACK[1][data]
    plain = data < 128  # a letter outside ASCII is no change of kind
    packed[1:] += ((kind[1:] != kind[:-1]) & plain[1:] & plain[:-1]).astype(np.int64) << 2 * _FIELD
    counts = np.empty((6, n), np.float32)  # lower, upper, digit, sign, assignment, changes of kind
    if lens.max() < 1 << _FIELD:
        for at, each in ((0, _PACK[0][data]), (3, packed)):
            sums = np.cumsum(each)
            both = sums[ends - 1] - sums[starts] + _PACK[at // 3][data[starts]]  # the first byte, without a change of kind
            for k in range(3):
                counts[at + k] = (both >> k * _FIELD) & ((1 << _FIELD) - 1)
    else:  # a token's counts might not fit in their bits
        for k in range(6):
            each = _CLASS[data, k] if k < 5 else packed >> 2 * _FIELD
            sums = np.cumsum(each)
            counts[k] = sums[ends - 1] - sums[starts] + (each[starts] if k < 5 else 0)
    address = data == 64  # an @, or the second of two slashes
    address[1:] |= (data[1:] == 47) & (data[:-1] == 47)
    marks = np.cumsum(address)
    change = counts[5]
    share = counts[:5] / lens
    low = _LOWER[data]
    s2 = np.minimum(starts + 1, len(data) - 1)
    s3 = np.minimum(starts + 2, len(data) - 1)
    head = (low[starts].astype(np.int64) << 16) + (low[s2].astype(np.int64) << 8) + low[s3]
    cue = np.zeros(n, np.float32)
    maybe = np.flatnonzero((lens >= 3) & (lens <= 16) & _in(head, _CUE_STARTS))
    if len(maybe):
        cue[maybe] = _in(word_hashes(low, starts[maybe], ends[maybe]), _CUES)
    sign = (((lens == 1) & _in(head >> 16, _SIGNS)) | ((lens == 2) & _in(head >> 8, _SIGNS))).astype(np.float32)
    same1, same2 = np.zeros(n, bool), np.zeros(n, bool)
    same1[1:] = rows[1:] == rows[:-1]
    same2[2:] = rows[2:] == rows[:-2]
    x[0] = 1
    for k, edge in enumerate((4, 8, 12, 16, 20, 32, 48)):
        x[1 + k] = lens >= edge
    x[8:13] = share
    x[13] = marks[ends - 1] - marks[starts] + address[starts] > 0
    x[14] = (share[2] > 0) & (share[0] + share[1] > 0)
    x[15] = (share[1] > 0) & (share[0] > 0) & (share[2] > 0)
    x[16] = np.minimum(change / 8, 2)
    x[17, 1:] = cue[:-1] * same1[1:]
    x[18, 2:] = cue[:-2] * same2[2:] * sign[1:-1]
    x[19, 1:] = sign[:-1] * same1[1:]
    x[20] = cue
    x[21] = (counts[4] > 0) & (share[2] > 0.1)
    x[22] = (lens >= 16) & (share[2] >= 0.1) & (change >= 4)
    x[23] = (share[2] > 0.95) | (change == 0)
    size = np.maximum(1, np.bincount(rows, minlength=len(offsets) - 1))
    x[24] = np.minimum(4, np.bincount(rows, share[2], minlength=len(offsets) - 1) / size * 10)[rows]
    x[25] = np.minimum(4, np.bincount(rows, counts[4] > 0, minlength=len(offsets) - 1) / size * 10)[rows]
    return starts, ends, rows, x


# ---------------------------------------------------------------- the random field


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 120, rate: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features x 3) and transitions (3 x 3) by Adam on the exact log likelihood."""
    t = max(len(y) for _, y in sequences)
    b = len(sequences)
    x, y, mask = np.zeros((t, b, FEATURES), np.float64), np.zeros((t, b), np.int64), np.zeros((t, b), bool)
    for k, (f, tags) in enumerate(sequences):
        x[: len(tags), k], y[: len(tags), k], mask[: len(tags), k] = f, tags, True
    w, tr = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    state = [np.zeros_like(v) for v in (w, w, tr, tr)]
    for step in range(1, steps + 1):
        e = x @ w
        alpha, beta = np.zeros((t, b, 3)), np.zeros((t, b, 3))
        alpha[0] = e[0]
        for i in range(1, t):
            alpha[i] = np.where(mask[i][:, None], _lse(alpha[i - 1][:, :, None] + tr[None], 1) + e[i], alpha[i - 1])
        z = _lse(alpha[-1], 1)
        for i in range(t - 2, -1, -1):
            beta[i] = np.where(mask[i + 1][:, None], _lse(tr[None] + (e[i + 1] + beta[i + 1])[:, None, :], 2), 0)
        gold = np.eye(3)[y] * mask[:, :, None]
        p = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
        g_w = np.einsum("tbf,tbk->fk", x, p - gold) / b + penalty * w
        pair = np.exp(alpha[:-1, :, :, None] + tr + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]) * mask[1:, :, None, None]
        g_t = (pair.sum((0, 1)) - np.einsum("tbi,tbj->ij", gold[:-1] * mask[1:, :, None], gold[1:])) / b + penalty * tr
        for v, g, m, s in ((w, g_w, state[0], state[1]), (tr, g_t, state[2], state[3])):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return w, tr


def generated(lines: int = LINES, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Labelled training lines: prose, dates, versions, numbers, identifiers, and secrets of several shapes with and without a cue."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    lower, digits, upper = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = []
    for _ in range(lines):
        words, tags = [], []

        def say(word: str, tag: int = 0, words=words, tags=tags) -> None:
            words.append(word)
            tags.append(tag)

        def prose(n: int, say=say) -> None:
            for _ in range(n):
                u = rng.random()
                if u < 0.86:
                    w = chars(lower, int(rng.integers(1, 13)))
                    say(pick([w, w, w, w.capitalize(), w + ".", w + ",", w + "é" + w, w + pick(["***", "$$$", "%%%", "###"]), w.upper()]))
                elif u < 0.9:
                    say(chars(digits, int(rng.integers(1, 17))) + pick(["", "", "", "***", "###", "."]))
                elif u < 0.93:
                    say(pick(["", "", "", "###", "$$$", ","]).join([pick([f"{rng.integers(256)}.{rng.integers(256)}.{rng.integers(256)}.{rng.integers(256)}", f"v{rng.integers(9)}.{rng.integers(20)}.{rng.integers(9)}", f"20{rng.integers(10, 30)}-0{rng.integers(1, 9)}-1{rng.integers(9)}", f"+{rng.integers(9)}", f"({rng.integers(999)})", f"{rng.integers(999)}-{rng.integers(9999)}"]), ""]))
                elif u < 0.945:
                    n = int(rng.integers(2, 12))
                    name = pick([chars(lower, n) + pick([".", "_", "-", "+"]) + str(rng.integers(9999)), chars(lower, n).capitalize() + str(rng.integers(99)), chars(lower, n) + "." + chars(lower, n)])
                    say(name + "@" + pick(["", chars(lower, 4) + "."]) + f"mail{rng.integers(99)}." + pick(["example.com", "example.org", "co.uk", "net"]) + pick(["", "", ".", ","]))
                elif u < 0.955:
                    say(pick(["https://", "http://", "ftp://"]) + chars(lower, 9) + pick([".example.org/", ".net/", ".com/"]) + pick([chars(lower, 6), chars(lower, 5) + "/" + chars(lower + digits, 14), chars(lower, 4) + "?id=" + chars(digits, 9), chars(lower, 3) + "/" + chars(lower + upper + digits, 22)]))
                elif u < 0.965:
                    say(pick([chars(lower, 6) + "_" + chars(lower, 7) + str(rng.integers(9)), chars(lower, 4).capitalize() + chars(lower, 6).capitalize() + "()", "/" + chars(lower, 4) + "/" + chars(lower, 8) + "-" + chars(digits, 3) + ".txt"]))
                elif u < 0.98:
                    say(pick(["password", "token", "secret", "key", "the", "is"]))
                else:
                    say(pick(["=", ":", "is", "->"]))

        prose(int(rng.integers(3, 14)))
        if rng.random() < 0.6:
            mixed = lower + upper + digits
            secret = pick([lambda: "AKIA" + chars(upper + digits, 16), lambda: chars("0123456789abcdef", pick([18, 32, 40, 64])), lambda: chars(mixed, int(rng.integers(20, 44))), lambda: pick(["ghp_", "sk-", "xoxb-", "glpat-"]) + chars(mixed, int(rng.integers(20, 40))), lambda: chars(mixed + "+/", 40) + "="])()
            form = rng.random()
            if form < 0.3:
                say(pick(["password", "token", "secret", "api_key", "passwd"]) + pick(["=", ":"]) + secret, 1)
            elif form < 0.6:
                say(pick(["password", "token", "secret", "api_key", "key", "credential"]))
                say(pick(["=", ":", "is", ":="]))
                say(pick(['"{}"', "{}", "'{}'"]).format(secret), 1)
            elif form < 0.7:
                say(pick(["Bearer", "token:", "password:", "key:"]))
                say(secret, 1)
            elif form < 0.75:
                say("secret:")
                say(chars(mixed, 12), 1)
                for _ in range(int(rng.integers(1, 3))):
                    say(chars(mixed, 12), 2)
            else:
                say(secret, 1)
        prose(int(rng.integers(2, 14)))
        out.append((" ".join(words), tags))
    return out


@lru_cache(maxsize=1)
def model(lines: int = LINES) -> tuple[np.ndarray, np.ndarray]:
    made = generated(lines)
    raw = [t.encode() for t, _ in made]
    offsets = np.cumsum([0, *map(len, raw)])
    _, _, rows, x = features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    cut = np.searchsorted(rows, np.arange(len(made) + 1))
    return fit([(x[:, cut[k] : cut[k + 1]].T, np.array(made[k][1])) for k in range(len(made))])


def viterbi(e: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """The best tags of one chain; on ties the lower tag."""
    n = len(e)
    back = np.zeros((n, 3), np.int64)
    s = e[0].copy()
    for i in range(1, n):
        step = s[:, None] + tr
        back[i] = step.argmax(0)
        s = step.max(0) + e[i]
    out = np.zeros(n, np.int64)
    out[-1] = int(s.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def tag(x: np.ndarray, rows: np.ndarray, w: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Viterbi tags of many chains (a column of x each token), decoded where a tag other than O is possible."""
    e = (w.T.astype(np.float32) @ x).T.astype(np.float64)
    out = np.zeros(len(e), np.int64)
    # what the transitions to and from another tag than O can make good at most (at an end of the chain: one of them)
    slack = np.maximum(0, (tr[:, 1:] - tr[:, :1]).max(0)) + np.maximum(0, (tr[1:] - tr[:1]).max(1))
    loose = np.flatnonzero((e[:, :1] - e[:, 1:] <= slack).any(1))
    if not len(loose):
        return out
    jump = np.flatnonzero((np.diff(loose) > 1) | (np.diff(rows[loose]) != 0)) + 1
    for run in np.split(loose, jump):
        lo, hi = int(run[0]), int(run[-1]) + 1
        lo -= lo > 0 and rows[lo - 1] == rows[lo]  # the sure O on either side takes part
        hi += hi < len(e) and rows[hi] == rows[hi - 1]
        part = e[lo:hi].copy()
        for k in {0, hi - lo - 1}:
            if lo + k not in run:
                part[k, 1:] = -np.inf
        out[lo:hi] = np.maximum(out[lo:hi], viterbi(part, tr))
    return out


def _occurrences(needle: bytes, text: bytes) -> Iterator[int]:
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + 1)


def _outside(text: str, spans: list[tuple[int, int]], known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of spans that no known span covers (both by start; one pass over both), without white space around; one that only quotes or signs are left of isn't a part."""
    i = 0
    for lo, hi in spans:
        while i < len(known) and known[i][1] <= lo:
            i += 1
        k = i
        if k == len(known) or known[k][0] >= hi:
            yield lo, hi
            continue
        while lo < hi:
            s, t = known[k][:2] if k < len(known) and known[k][0] < hi else (hi, hi)
            part = text[lo : max(lo, s)]
            if re.search(r"[^\W_]", part):
                yield lo + len(part) - len(part.lstrip()), lo + len(part.rstrip())
            lo = max(lo, t)
            k += 1


def _union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans (by start) in one."""
    out: list[tuple[int, int, int]] = []
    for s, t, k in spans:
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(t, out[-1][1]), k
        else:
            out.append((s, t, k))
    return out


def scan_slice(data: np.ndarray, offsets: np.ndarray, texts: list[str], w: np.ndarray, tr: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: the rules', then the field's, as far as no rule has found the place. Linear in the text."""
    starts, ends, rows, x = features(data, offsets)
    tags = tag(x, rows, w, tr)
    low = _LOWER[data].tobytes()
    row_of = lambda needle, text: {int(np.searchsorted(offsets, p, "right")) - 1 for p in _occurrences(needle, text)}
    named = set().union(*(row_of(n, low) for n in (b"passw", b"secret", b"token", b"apikey", b"api_key")))
    keyed = row_of(b"AKIA", data.tobytes())
    long = set(rows[ends - starts >= 32].tolist())
    found = [rule_spans(t, k in named, k in keyed, k in long) for k, t in enumerate(texts)]
    begin = np.flatnonzero(tags == 1)
    if len(begin):
        # a span ends before the next token that isn't inside, or of another text
        stop = np.append(np.flatnonzero((tags != 2) | np.append(True, rows[1:] != rows[:-1])), len(tags))
        last = stop[np.searchsorted(stop, begin, "right")] - 1
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before each byte
        base = points[offsets[rows[begin]]]
        lo, hi = points[starts[begin]] - base, points[ends[last]] - base
        cut = bounds(rows[begin])
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            k = int(rows[begin[s]])
            new = [(a, b, 3) for a, b in _outside(texts[k], list(zip(lo[s:e].tolist(), hi[s:e].tolist(), strict=True)), _union(found[k]))]
            found[k] = sorted([*found[k], *new], key=lambda s: (s[0], s[2]))
    return found


def scan(docs: DataFrame, lines: int = LINES, text: bool = False) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of every row, by start, then kind; code points, end exclusive.

    Null texts count as empty; texts of any length are read whole, in time linear in them. Repeated
    rows and null doc_ids stay; extra columns are ignored; an empty table gives none. With `text`, the
    whole row comes back with the spans added, under a name that no column has: the last one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model(lines))
    kept = docs.columns if text else ["doc_id", "text"]
    kinds = np.array(KINDS)
    (name,) = free(kept, "_spans")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, tr = shared.value
        for batch in batches:
            for part, data, off in slices(batch):
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                found = scan_slice(data, off, texts, w, tr)
                spans = pa.array([[{"kind": kinds[k], "start": s, "end": e} for s, e, k in x] for x in found], span)
                if text:
                    yield pa.RecordBatch.from_arrays([*part.columns, spans], names=[*part.schema.names, name])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), spans], names=["doc_id", "spans"])

    rows = docs.select(*kept) if text else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "array<struct<kind:string,start:long,end:long>>"
    if text:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(lambda b: released(run(b)), f"{fields}, `{name}` {kind}")
    return rows.mapInArrow(lambda b: released(run(b)), f"doc_id long, spans {kind}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans."""
    n = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "crf")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """The documents with every span replaced by `<secret>`; n_chars follows. No document goes, and no other column changes."""
    found = scan(docs, lines, text=True)
    spans = found.columns[-1]
    # overlapping spans count as one; what lies between the spans is kept
    pieces = F.expr(
        f"""aggregate(`{spans}`, named_struct('out', cast('' as string), 'at', 0L),
        (a, s) -> CASE WHEN s.end <= a.at THEN a WHEN s.start < a.at THEN named_struct('out', a.out, 'at', s.end)
        ELSE named_struct('out', concat(a.out, substring(text, cast(a.at + 1 as int), cast(s.start - a.at as int)), '<secret>'), 'at', s.end) END,
        a -> concat(a.out, substring(text, cast(a.at + 1 as int), 2147483647)))"""
    )
    clean = F.when(F.size(spans) > 0, pieces).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
