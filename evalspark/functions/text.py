"""Column functions over strings and JSON: normalization, parsing, tokens, templates, masks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions.stored import among

CJK = r"[\x{4e00}-\x{9fff}]"
#: White space of any kind, as one character class: much cheaper than the Unicode mode of \\s.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def orderable(rows: DataFrame, names: list[str]) -> list[str]:
    """Those of the columns that can be compared: what decides between rows that an order leaves equal."""
    def fine(kind: ty.DataType) -> bool:
        if isinstance(kind, ty.ArrayType):
            return fine(kind.elementType)
        if isinstance(kind, ty.StructType):
            return all(fine(f.dataType) for f in kind)
        return not isinstance(kind, (ty.MapType, ty.VariantType))

    return [n for n in names if fine(rows.schema[n].dataType)]


def count_of(c: Column | str, pattern: str) -> Column:
    """How often a pattern matches (long)."""
    return F.regexp_count(col(c), F.lit(pattern)).cast("long")


def chars_of(c: Column | str, kept: str) -> Column:
    """How many characters a class (its inside) holds: what is left when the runs of others go. One match a run, not one a character."""
    return F.length(F.regexp_replace(col(c), f"[^{kept}]+", "")).cast("long")


def strip(c: Column | str) -> Column:
    """Without white space (any Unicode kind) at both ends."""
    return F.regexp_replace(col(c), f"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def norm(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def normal_lines(c: Column | str) -> Column:
    """A text's lines, each as `norm` makes it (array; null for a null text): Python's split takes the same white space as SPACE, at a small part of a regex's cost."""

    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [" ".join(line.split()) for line in t.split("\n")] for t in texts], dtype=object)

    return F.pandas_udf(split, "array<string>")(col(c))


def compact(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(col(c), f"{SPACE}+", "")


def question_key(c: Column | str) -> Column:
    return F.lower(compact(c))


def json_object(c: Column | str) -> Column:
    """The JSON object of a judge's answer as canonical text: the whole answer, else its widest {...} span; null if neither is an object."""
    whole = F.try_parse_json(col(c))
    inner = F.try_parse_json(F.regexp_extract(col(c), r"(?s)\{.*\}", 0))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.coalesce(F.when(is_object(whole), F.to_json(whole)), F.when(is_object(inner), F.to_json(inner)))


def path_get(c: Column | str, path: str, kind: str = "string") -> Column:
    """A value at a dotted path (`a.b.0`) of JSON text; null where there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.try_variant_get(F.try_parse_json(col(c)), f"${steps}", kind)


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def coerce_float(c: Column | str) -> Column:
    """true and false count as 1 and 0; otherwise the first signed decimal number in the text."""
    low = F.lower(F.trim(col(c)))
    return F.when(low == "true", 1.0).when(low == "false", 0.0).otherwise(F.regexp_extract(col(c), r"-?\d+(?:\.\d+)?", 0).try_cast("double"))


def clean_reason(c: Column | str, most: int = 800) -> Column:
    return F.substring(strip(c), 1, most)


def limit_text(c: Column | str, most: int | Column) -> Column:
    """At most so many characters, and a mark where some are cut off."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), F.lit(1), most), F.lit("...[truncated]"))).otherwise(col(c))


#: Fixed values of the judge's size budget: characters of a text, least of a list's item, of a map's value; items of a list, entries of a map.
BUDGET, ITEM_LEAST, VALUE_BUDGET, MOST_ITEMS, MOST_ENTRIES = 2400, 300, 700, 12, 20


def budgeted(c: Column | str, kind: ty.DataType, most: int | Column = BUDGET) -> Column:
    """A value within the size budget, whatever its type: texts are cut, lists and maps shortened, all the way down.

    A list shares its budget among all of its items, the dropped ones too.
    """
    c = col(c)
    most = F.lit(most) if isinstance(most, int) else most
    if isinstance(kind, ty.StringType):
        return limit_text(c, most)
    if isinstance(kind, ty.ArrayType):
        each = F.greatest(F.lit(ITEM_LEAST), F.floor(most / F.greatest(F.size(c), F.lit(1))).cast("int"))
        return bind(F.struct(c.alias("v"), each.alias("m")), lambda x: F.transform(F.slice(x["v"], 1, MOST_ITEMS), lambda v: budgeted(v, kind.elementType, x["m"])))
    if isinstance(kind, ty.MapType):
        return F.when(c.isNotNull(), F.map_from_entries(F.transform(F.slice(F.map_entries(c), 1, MOST_ENTRIES), lambda e: F.struct(e["key"], budgeted(e["value"], kind.valueType, VALUE_BUDGET)))))
    if isinstance(kind, ty.StructType):
        return F.when(c.isNotNull(), F.struct(*[budgeted(c[f.name], f.dataType, VALUE_BUDGET).alias(f.name) for f in kind.fields[:MOST_ENTRIES]]))
    return c


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Within lo and hi; null stays null (greatest and least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def mask_secret(c: Column | str) -> Column:
    """The first eight and last four characters of a long value, stars between; short ones all stars; an empty or null one is empty."""
    c = col(c)
    return F.when(F.length(c) > 16, F.concat(F.substring(c, 1, 8), F.lit("****"), F.substring(c, -4, 4))).when(F.length(c) > 0, F.lit("****")).otherwise(F.lit(""))


#: Names of fields that hold secrets.
SENSITIVE = ("authorization", "api_key", "apikey", "access_token", "refresh_token", "secret", "password")


def redacted(c: Column | str, kind: ty.DataType) -> Column:
    """A value without its secrets, all the way down: a field or key of a secret's name is null, and <name>_masked stands beside it if there was one.

    A map without texts as values can't hold the mask: there the key's value is null only.
    """
    c = col(c)
    known = lambda k: F.replace(F.lower(k), F.lit("-"), F.lit("_")).isin(*SENSITIVE)
    if isinstance(kind, ty.ArrayType):
        return F.transform(c, lambda v: redacted(v, kind.elementType))
    if isinstance(kind, ty.StructType):
        out = []
        for f in kind.fields:
            if f.name.lower().replace("-", "_") not in SENSITIVE:
                out.append(redacted(c[f.name], f.dataType).alias(f.name))
                continue
            masked = mask_secret(c[f.name].cast("string"))
            out += [F.lit(None).cast(f.dataType).alias(f.name), F.nullif(masked, F.lit("")).alias(f"{f.name}_masked")]
        return F.when(c.isNotNull(), F.struct(*out))
    if isinstance(kind, ty.MapType):
        value = kind.valueType
        if not isinstance(value, ty.StringType):
            return F.transform_values(c, lambda k, v: F.when(~known(k), redacted(v, value)))
        one = lambda e: F.when(known(e["key"]), F.array_compact(F.array(F.struct(e["key"].alias("key"), F.lit(None).cast("string").alias("value")), F.when(mask_secret(e["value"]) != "", F.struct(F.concat(e["key"], F.lit("_masked")).alias("key"), mask_secret(e["value"]).alias("value")))))).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))
        return F.when(c.isNotNull(), F.map_from_entries(F.flatten(F.transform(F.map_entries(c), one))))
    return c


def mask_key(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.length(c) > 8, F.concat(F.substring(c, 1, 3), F.lit("****"), F.substring(c, -4, 4))).when(c.isNotNull(), F.lit("****"))


def is_missing(c: Column | str, kind: str = "string") -> Column:
    """Null, or an empty string, array or map."""
    c = col(c)
    return c.isNull() | ((c == "") if kind == "string" else (F.size(c) == 0))


def list_text(c: Column | str) -> Column:
    """A list out of text: a JSON array, else its non-blank lines, else null for blank text."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x != "")
    return F.coalesce(F.when(F.trim(col(c)).startswith("["), F.from_json(col(c), "array<string>")), F.when(F.size(lines) > 0, lines))


def json_type(c: Column | str) -> Column:
    """What a JSON value is stored as: array, json (an object), number (booleans too), else text."""
    kind = F.schema_of_variant(F.try_parse_json(col(c)))
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    return F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "json").when(number, "number").otherwise("text")


def path_set(c: Column | str, path: str, value: Column) -> Column:
    """A map of JSON texts with the value (JSON text) at a dotted path; what stands in the way and is no object is replaced. An empty path changes nothing."""
    steps = [p for p in path.split(".") if p]
    if not steps:
        return col(c)

    def put(m: Column) -> Column:
        inner = value
        if len(steps) > 1:
            below = bind(F.try_element_at(m, F.lit(steps[0])), lambda there: F.coalesce(F.when(json_type(there) == "json", json_map(there)), F.create_map().cast("map<string,string>")))
            inner = json_text(path_set(below, ".".join(steps[1:]), value))
        return F.map_concat(F.map_filter(m, lambda k, v: k != steps[0]), F.create_map(F.lit(steps[0]), inner))

    return bind(col(c), put)


def json_map(c: Column | str) -> Column:
    """A JSON object's keys, each with the JSON text of its value."""
    return F.transform_values(F.from_json(col(c), "map<string,variant>"), lambda k, v: F.to_json(v))


def quoted(c: Column) -> Column:
    """A text as JSON text."""
    listed = F.to_json(F.array(c))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def json_text(c: Column) -> Column:
    """A map of JSON texts as one JSON object, its keys in order."""

    def written(m: Column) -> Column:
        fields = F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(quoted(k), F.lit(":"), F.coalesce(F.try_element_at(m, k), F.lit("null"))))
        return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))

    return bind(c, written)


def bigram_tokens(c: Column | str) -> Column:
    """Lower-case ASCII words first, then bigrams of CJK runs (a single character stays)."""
    low = F.lower(col(c))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK + "+"), F.lit(0))  # short: a substring starts at its own first character
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.when(low.rlike(CJK), F.concat(words, pairs)).otherwise(words)


def token_count(c: Column | str) -> Column:
    """The number of bigram_tokens, without making them."""
    low = F.lower(col(c))
    pairs = F.aggregate(F.regexp_extract_all(low, F.lit(CJK + "+"), F.lit(0)), F.lit(0), lambda n, r: n + F.greatest(F.lit(1), F.length(r) - 1))
    return F.regexp_count(low, F.lit("[a-z0-9]+")) + F.when(low.rlike(CJK), pairs).otherwise(0)


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's body is otherwise computed again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def char_ngrams(c: Column | str, n: int = 5) -> Column:
    """Distinct character n-grams of the lower-case text without white space; a shorter text is its own only one."""
    by_character = lambda ch: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ch) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(ch, i, n), ""))

    def grams(s: Column) -> Column:
        # one regex pass; it steps by UTF-16 units, so texts with characters beyond these go by character
        plain = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.when(F.length(s) <= n, F.array(s)).when(s.rlike(r"[\x{10000}-\x{10FFFF}]"), bind(F.split(s, ""), by_character)).otherwise(plain)

    none = F.array().cast("array<string>")
    return bind(question_key(c), lambda s: F.when(s == "", none).when(s.isNotNull(), F.array_distinct(grams(s))))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def rolled(t: str, n: int) -> np.ndarray:
    """64-bit hashes of a text's character n-grams, one a place; of a shorter text one in all."""
    x = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = min(n, len(x))
    h = np.full(len(x) - m + 1, m, np.uint64)
    for j in range(m):
        h = (h ^ x[j : j + len(h)]) * _ODD
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def gram_hashes(texts: DataFrame, key: str, text: str, n: int = 5, wanted: Broadcast | None = None) -> DataFrame:
    """(key, gram): 64-bit hashes of a text's distinct character n-grams, of the lower-case text without white space; a shorter text is its own only one.

    Hashed by a rolling sum over code points in Arrow batches: no string is made for a gram. With
    `wanted` (a sorted array of hashes) only those leave the task. Blank and null texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                h = rolled(t, n)
                if wanted is not None:
                    h = h[among(h, wanted.value)]
                ids.append(np.unique(h))
                keys.append(np.full(len(ids[-1]), k))
            for lo in range(0, len(ids), 64):  # bounded batches out
                at = np.concatenate(keys[lo : lo + 64])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(ids[lo : lo + 64]))], names=[key, "gram"])

    rows = texts.select(key, question_key(text).alias("_t"))  # blank ones are passed over there: a filter here would make every key twice
    return rows.mapInArrow(run, ty.StructType([rows.schema[0], ty.StructField("gram", ty.LongType())]))


_LETTER = np.zeros(256, bool)
_LETTER[[1, *range(0x30, 0x3A), *range(0x61, 0x7B)]] = True  # and the mark of `_plain`
_SIGNS = re.compile("[\u4e00-\u9fff]+")
PIECE = 1 << 19  # characters of texts that are counted at a time; a longer text is a piece of its own


def _plain(text: str | None) -> bytes:
    """Bytes whose runs of `_LETTER` are the text's tokens: ASCII words as they are, behind them the bigrams of CJK runs, spelt with a mark that no word has."""
    low = (text or "").lower().replace("\x01", " ")
    runs = _SIGNS.findall(low)
    pairs = [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]
    spelt = [" " + "".join(f"\x01{ord(c):x}" for c in p) for p in pairs]
    return "".join([low, *spelt]).encode("utf-8", "surrogatepass")


def term_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of `_LETTER` starts, and its 64-bit hash."""
    solid = np.concatenate(([False], _LETTER[data], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, lens = edges[::2], edges[1::2] - edges[::2]
    h = np.full(len(starts), 0x51_7C_C1_B7, np.uint64)
    live = np.arange(len(starts))
    for j in range(int(lens.max()) if len(lens) else 0):
        live = live[lens[live] > j]
        h[live] = (h[live] ^ data[starts[live] + j]) * _ODD
        h[live] ^= h[live] >> np.uint64(29)
    return starts, h.view(np.int64)


def term_counts(texts: DataFrame, key: str, text: str, wanted: Broadcast | None = None) -> DataFrame:
    """(key, len, terms array<long>, tfs array<int>): 64-bit hashes of a text's distinct `bigram_tokens` with their numbers, in one pass over the bytes.

    `len` counts all tokens; with `wanted` (a sorted array of hashes) only those terms are listed. A
    null text has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_, at = batch.column(1).to_pylist(), 0
            while at < len(texts_):
                end, size = at, 0
                while end < len(texts_) and (end == at or size + len(texts_[end] or "") <= PIECE):
                    size += len(texts_[end] or "")
                    end += 1
                parts = [_plain(t) for t in texts_[at:end]]
                offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
                starts, h = term_hashes(np.frombuffer(b"\n".join(parts), np.uint8))
                rows = np.searchsorted(offsets, starts, "right") - 1
                lens = np.bincount(rows, minlength=len(parts)).astype(np.int32)
                if wanted is not None:
                    keep = among(h, wanted.value)
                    rows, h = rows[keep], h[keep]
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
                tfs = np.diff(np.append(first, len(h))).astype(np.int32)
                cuts = pa.array(np.searchsorted(rows[first], np.arange(len(parts) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (h[first], tfs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(lens), *lists], names=[key, "len", "terms", "tfs"])
                at = end

    rows = texts.select(key, F.col(text).alias("_t"))
    more = [ty.StructField("len", ty.IntegerType()), ty.StructField("terms", ty.ArrayType(ty.LongType())), ty.StructField("tfs", ty.ArrayType(ty.IntegerType()))]
    return rows.mapInArrow(run, ty.StructType([rows.schema[0], *more]))


_VARIABLE = re.compile(r"(?<!\{)\{([A-Za-z_][\w.]*)\}(?!\})")


def prompt_variables(template: str) -> list[str]:
    """Names of a template's variables in order, once each."""
    return list(dict.fromkeys(_VARIABLE.findall(template)))


def render(template: str, columns: dict[str, Column]) -> Column:
    """A template with {name} variables, compiled once into a column; an unknown or null variable is empty. Complex values become JSON."""
    parts, at = [], 0
    for m in _VARIABLE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(columns[m[1]].cast("string"), F.lit("")) if m[1] in columns else F.lit(""))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
