"""Fill-in-middle: a text is cut into prefix, middle and suffix at unit boundaries, and rearranged around sentinels.

A text becomes an array of code points (UTF-32); every code point has a class, and a unit starts
wherever the classes of two neighbours say so. Three ranks drawn from a keyed hash of the row's
id choose the boundaries, so a row's cut depends on nothing but its id, its text and the seed:
tasks may be repeated anywhere. `restore` is the way back, in columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import free, slices

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
#: Code points that separate words: the ASCII ones and Unicode's White_Space.
SPACES = np.array([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


@dataclass(frozen=True)
class Unit:
    """Classes of code points, and for each pair of neighbouring classes whether a unit starts between them."""

    classes: Callable[[np.ndarray], np.ndarray]
    breaks: tuple[tuple[bool, ...], ...]


UNITS = {
    "line": Unit(lambda cp: (cp == 10).astype(np.uint8), ((False, False), (True, True))),  # after each newline
    "word": Unit(lambda cp: np.isin(cp, SPACES).astype(np.uint8), ((False, False), (True, False))),  # where spaces end
    "char": Unit(lambda cp: np.zeros(len(cp), np.uint8), ((True,),)),
}


def boundaries(cp: np.ndarray, unit: Unit) -> np.ndarray:
    """Where units start, then the length: one more than there are units; of an empty text, 0 alone."""
    if not len(cp):
        return np.zeros(1, np.int64)
    c = unit.classes(cp)
    inner = np.flatnonzero(np.array(unit.breaks)[c[:-1], c[1:]]) + 1
    return np.concatenate(([0], inner, [len(cp)]))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be found again whatever stands beside them: none may be empty, hold another, or begin with another's end."""
    for a in range(3):
        for b in range(3):
            x, y = sentinels[a], sentinels[b]
            if not x or (a != b and x in y) or any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"sentinels {x!r} and {y!r} can't be told apart")


def _piece(cp: np.ndarray) -> str:
    return cp.tobytes().decode("utf-32-le")


def rearrange(text: str, h: tuple[int, int, int, int], unit: Unit, sentinels: tuple[str, str, str], rate: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text; h are four unsigned numbers."""
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = boundaries(cp, unit)
    n = len(at) - 1
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = (int(at[k]) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = _piece(cp[:lo]), _piece(cp[lo:hi]), _piece(cp[hi:])
    p, s, m = sentinels
    if h[3] % 100 < spm:
        return n, "spm", lo, hi - lo, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", lo, hi - lo, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(
    docs: DataFrame,
    columns: list[str] | None = None,
    unit: str = "line",
    seed: int = 7,
    rate: int = 100,
    spm: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS,
    key: str = "doc_id",
) -> DataFrame:
    """Every row's `columns` (all, unless given) with n, form, prefix_chars, middle_chars and output.

    `rate` per cent of the texts are rearranged, `spm` per cent of those suffix first; the others,
    empty ones, and texts that hold a sentinel stay as they are (`plain`; no lengths). A null text
    is an empty one; a null key hashes as an empty one; repeated rows give equal rows; an empty
    table gives none. Columns of the new names get them lengthened. One text at a time is decoded,
    whole, into four bytes a code point.
    """
    check_sentinels(sentinels)
    columns = docs.columns if columns is None else columns
    text, *hashes = free(docs.columns, "_text", "_h1", "_h2", "_h3", "_h4")
    new = free(columns, "n", "form", "prefix_chars", "middle_chars", "output")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(*[docs[c] for c in columns], F.coalesce("text", F.lit("")).alias(text), *[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(h) for k, h in enumerate(hashes)])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, text):
                given = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (text, *hashes))
                out = [rearrange(t, h, UNITS[unit], sentinels, rate, spm) for t, *h in zip(*given, strict=True)]
                made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *made], names=[*columns, *new])

    schema = docs.select(*[docs[c] for c in columns], *[F.lit(None).cast(t).alias(c) for c, t in zip(new, ("long", "string", "long", "long", "string"), strict=True)]).schema
    return rows.mapInArrow(run, schema)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of `fill_in_middle` was made of: the first sentinel of each kind is the one put there."""
    p, s, m = sentinels

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(output, second, 1)
        tail = F.substr(output, F.length(head) + F.lit(len(second) + 1))
        mid = F.substring_index(tail, m, 1)
        return F.substr(head, F.lit(len(first) + 1)), mid, F.substr(tail, F.length(mid) + F.lit(len(m) + 1))

    prefix, suffix, middle = between(p, s)
    suffix2, prefix2, middle2 = between(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
