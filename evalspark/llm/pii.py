"""PII: surrogates for detected entities, keyed, consistent with their type, and distinct.

Entities: e-mail addresses, IPv4 addresses, card numbers, phone numbers (with a country code, of
national forms with a leading zero, and 3-3-4 digits), social security numbers, and names: any
number of words behind a title or a listed given name, and every later or earlier mention of such a
word in the same text. Only DataFrame functions are used.

A surrogate is a keyed permutation of the entity, so two entities of one type and form never
share one, and one entity has the same surrogate wherever it stands:

* letters and digits are shifted within their own alphabet (script and case stay) by a Feistel
  network over the even and the odd places; separators, top-level domain, country code and first
  card digit stay, a card's Luhn remainder too, octets stay below 256;
* names go word by word, so that "Mr Smith", "John Smith" and "Smith" stay one person: a listed given
  name or surname goes to another of its list (gender and script stay), in an order that the key
  decides; a name that is in no list is shifted letter by letter; titles and particles stay.

What a permutation can't exclude is checked on the table of all distinct entities (of names: of
their words): a surrogate that is itself an entity of the corpus, or that two entities share after a
second draw, is drawn again, with the number of the draw in the key. Where a form is full, drawing
can't help: after `WIDEN` draws addresses and names get a letter more for every `WIDEN` draws. Other
forms have a fixed length; if one is so full that `DRAWS` draws don't end it, an error says so. Listed names
are exempt from the first test: their lists are closed, and they stay distinct as they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import free, materialize, release

KINDS = ("email", "ip", "card", "phone", "ssn", "name")
KEY = "surrogates"  # in production: a secret parameter
ROUNDS = 4
WIDEN, DRAWS = 8, 40

MALE = ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Paul", "Hans", "Karl", "Jürgen", "Pierre", "Jean", "Luis", "Carlos", "José", "Juan", "Miguel")
FEMALE = ("Mary", "Anna", "Linda", "Susan", "Sarah", "Karen", "Laura", "Emma", "Julia", "Maria", "Ingrid", "Ursula", "Claire", "Sophie", "Camille", "Lucía", "Carmen", "Elena", "Isabel", "Alice")
SURNAMES = ("Smith", "Johnson", "Brown", "Taylor", "Wilson", "Clark", "Müller", "Schmidt", "Schneider", "Fischer", "Weber", "Martin", "Bernard", "Dubois", "Moreau", "García", "López", "Martínez", "Sánchez", "Pérez")
MALE_CYRILLIC = ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай")
FEMALE_CYRILLIC = ("Анна", "Ольга", "Елена", "Мария", "Наталья", "Ирина")
LISTS = (MALE, FEMALE, SURNAMES, MALE_CYRILLIC, FEMALE_CYRILLIC)

TITLES = ("Mrs", "Mr", "Ms", "Miss", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señora", "Señor", "Господин", "Госпожа")
PARTICLES = ("von", "van", "der", "den", "de", "la", "del", "di", "da", "du", "zu")
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßšž",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŒŠŽ",
    "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αάβγδεέζηήθιίκλμνξοόπρςστυύφχψωώ",
    "ΑΆΒΓΔΕΈΖΗΉΘΙΊΚΛΜΝΞΟΌΠΡΣΤΥΎΦΧΨΩΏ",
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = r"(?:" + "|".join(TITLES) + r")\.?"
_GIVEN = "(?:" + "|".join((*MALE, *FEMALE, *MALE_CYRILLIC, *FEMALE_CYRILLIC)) + ")"
_WORD = r"\p{Lu}(?:\.(?= \p{Lu})|\p{L}*+(?:(?:-|'(?!s\b))\p{L}++)*+)"
_MORE = r"(?: (?:(?:" + "|".join(PARTICLES) + rf") ){{0,3}}{_WORD})"
#: No part can be tried again with fewer characters over a long run: texts of any length take linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "abroad": r"(?<![0-9A-Za-z])\+(?=(?:[^0-9\n]{0,2}[0-9]){7})(?:[0-9]{7,15}+|[0-9]{1,3}+(?: ?\([0-9]{1,5}\))?(?:[ ./-][0-9]{1,8}+){1,6}+)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "national": r"(?<![0-9A-Za-z+])(?![0-9]{2}[ /-][0-9]{2}[ /-][0-9]{4}(?![0-9]))(?=0(?:[ /-]?[0-9]){8})0[0-9]{1,4}+(?:[ /-][0-9]{2,8}+){1,5}+(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])",
}
NAME = rf"(?<!\p{{L}})(?:{_TITLE}{_MORE}++|{_GIVEN}(?!\p{{L}}){_MORE}++)"
PLAIN = "|".join(PATTERNS.values())
PATTERN = PLAIN + "|" + NAME
MAYBE_NAME = rf"(?:{_TITLE}|{_GIVEN}) (?:\p{{Lu}}|{'|'.join(PARTICLES)})"  # a name needs this


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind(e: str) -> str:
    """SQL: the type of a matched entity `e`."""
    return (
        f"CASE WHEN contains({e}, '@') THEN 'email' WHEN {e} rlike '^[^0-9]+$' THEN 'name' WHEN {e} rlike '^[0-9.]+$' AND length({e}) - length(replace({e}, '.', '')) = 3 THEN 'ip' "
        f"WHEN {e} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn' WHEN {e} rlike '^[1-9][0-9 -]+$' AND length(regexp_replace({e}, '[^0-9]', '')) > 12 THEN 'card' ELSE 'phone' END"
    )


#: SQL: whether the word `w` of a name goes to a surrogate. Titles and particles stay.
def _is_name(w: str) -> str:
    return f"({w} rlike '^\\\\p{{Lu}}' AND NOT {w} rlike '^{_TITLE}$')".replace("\\.?", "[.]?")


# ---------------------------------------------------------------- permutations, as SQL over lambda variables


def _offset(digest: str, i: str) -> str:
    return f"CAST(conv(substr({digest}, 1 + (shiftright({i}, 1) % 32) * 4, 4), 16, 10) AS int)"


def _shifted(c: str, by: str) -> str:
    whens = " ".join(f"WHEN instr('{a}', {c}) > 0 THEN substr('{a}', (instr('{a}', {c}) - 1 + {by}) % {len(a)} + 1, 1)" for a in ALPHABETS)
    return f"CASE {whens} ELSE {c} END"


def _feistel(value: str, key: str, draw: str) -> str:
    """Shift the letters and digits of `value`: in each round one half, by a digest of the other."""
    other = "array_join(filter(split(s, ''), (c, i) -> i % 2 <> r % 2), '')"
    digest = f"sha2(concat_ws(':', {_quoted(key)}, {draw}, r, {other}), 512)"
    moved = f"array_join(transform(split(s, ''), (c, i) -> CASE WHEN i % 2 <> r % 2 THEN c ELSE {_shifted('c', _offset('d', 'i'))} END), '')"
    return f"aggregate(sequence(1, {ROUNDS}), {value}, (s, r) -> transform(array({digest}), d -> {moved})[0])"


def _octets(value: str, key: str, draw: str) -> str:
    other = "array_join(filter(s, (c, i) -> i % 2 <> r % 2), '.')"
    digest = f"sha2(concat_ws(':', {_quoted(key)}, 'ip', {draw}, r, {other}), 512)"
    moved = f"transform(s, (c, i) -> CASE WHEN i % 2 <> r % 2 THEN c ELSE CAST((CAST(c AS int) + {_offset('d', 'i')}) % 256 AS string) END)"
    return f"array_join(aggregate(sequence(1, {ROUNDS}), split({value}, '[.]'), (s, r) -> transform(array({digest}), d -> {moved})[0]), '.')"


def _luhn(digits: str) -> str:
    """Luhn sum of a string of digits whose last one counts once."""
    n = f"length({digits})"
    return f"aggregate(transform(split({digits}, ''), (c, i) -> CASE WHEN ({n} - 1 - i) % 2 = 0 THEN CAST(c AS int) WHEN c > '4' THEN CAST(c AS int) * 2 - 9 ELSE CAST(c AS int) * 2 END), 0, (a, x) -> a + x)"


def _card(value: str, key: str, draw: str) -> str:
    """First digit and form stay; the last digit keeps the Luhn remainder."""
    plain = lambda x: f"regexp_replace({x}, '[^0-9]', '')"
    moved = f"concat(substr({value}, 1, 1), {_feistel(f'substr({value}, 2, length({value}) - 2)', key + ':card', draw)})"
    last = f"CAST(((({_luhn(plain(value))}) - ({_luhn(plain('concat(m, ' + repr('0') + ')'))})) % 10 + 10) % 10 AS string)"
    return f"transform(array({moved}), m -> concat(m, {last}))[0]"


def _names(key: str) -> str:
    """SQL map of listed names: the next one of the list in the key's order."""
    pairs = []
    for names in LISTS:
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}:{n}".encode()).digest())
        pairs += [f"{_quoted(a)}, {_quoted(b)}" for a, b in zip(order, order[1:] + order[:1], strict=True)]
    return f"map({', '.join(pairs)})"


def surrogate(value: str, kind_: str, key: str = KEY, draw: int = 0) -> str:
    """SQL: the surrogate of an entity (of a name: of one of its words) in its `draw`-th draw. `value` and `kind_` are names of columns or lambda variables."""
    tail = f"regexp_extract({value}, '[.][A-Za-z]+$', 0)"
    code = f"regexp_extract({value}, '^(?:[+][0-9]{{1,3}}(?=[ .(/-])|0)', 0)"
    wider, turn = draw // WIDEN, f"'{draw}'"
    head = f"substr({value}, 1, length({value}) - length({tail}))"
    address = f"concat('{'x' * wider}', {head})" if wider else head
    name = f"concat({value}, '{'a' * wider}')" if wider else value
    listed = f"coalesce(try_element_at({_names(key)}, {value}), {_feistel(name, key + ':name', turn)})" if not wider else _feistel(name, key + ":name", turn)
    return (
        f"CASE {kind_} WHEN 'email' THEN concat({_feistel(address, key + ':email', turn)}, {tail}) "
        f"WHEN 'ip' THEN {_octets(value, key, turn)} WHEN 'card' THEN {_card(value, key, turn)} WHEN 'name' THEN {listed} "
        f"WHEN 'phone' THEN concat({code}, {_feistel(f'substr({value}, length({code}) + 1)', key + ':phone', turn)}) ELSE {_feistel(value, key + ':ssn', turn)} END"
    )


# ---------------------------------------------------------------- detection


def _apart(docs: DataFrame, parts: str, flag: str) -> DataFrame:
    """Add every text taken apart: what stands before its first entity, the entity, what stands between, and so on; null where it has none.

    A mark that the text can't hold (it has a digest of the text) is put around every match, so that
    the pattern runs once. Where a name may be found (the flag, a column of its own, so that it is
    computed once), the words of all names make a pattern of their own for the rest of the text; all
    other texts are held against the other patterns only.
    """
    t = F.col("text")
    mark = F.concat(F.lit("\ufdd0"), F.substring(F.sha2(t, 256), 1, 24))
    words = F.expr(f"array_distinct(filter(flatten(transform(regexp_extract_all(text, {_quoted(NAME)}, 0), e -> split(e, ' '))), w -> length(w) > 2 AND {_is_name('w')}))")
    own = _bind(words, lambda w: F.when(F.size(w) > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}'-])(?:"), F.array_join(w, "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(PATTERN)))
    marked = lambda m, p: F.split(F.regexp_replace(t, p, F.concat(m, F.lit("$0"), m)), m, -1)
    plain = F.when((t.contains("@") | t.rlike("[0-9]")) & t.rlike(PLAIN), _bind(mark, lambda m: marked(m, F.lit(PLAIN))))
    named = _bind(F.struct(mark.alias("m"), own.alias("p")), lambda x: marked(x["m"], x["p"]))
    out = docs.withColumn(flag, t.rlike(MAYBE_NAME)).withColumn(parts, F.when(F.col(flag), named).otherwise(plain))
    return out.withColumn(parts, F.when(F.size(parts) > 1, F.col(parts))).drop(flag)


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _sql_entities(parts: str) -> str:
    return f"filter(`{parts}`, (x, i) -> i % 2 = 1)"


def entities(found: DataFrame, parts: str) -> DataFrame:
    """(kind, value): every distinct entity of a table of texts taken apart; of names every word."""
    each = found.where(F.col(parts).isNotNull()).select(F.explode(F.expr(_sql_entities(parts))).alias("e")).distinct().select("e", F.expr(kind("e")).alias("kind"))
    names = each.where("kind = 'name'").select("kind", F.explode(F.expr(f"filter(split(e, ' '), w -> {_is_name('w')})")).alias("value"))
    return each.where("kind <> 'name'").select("kind", F.col("e").alias("value")).unionByName(names).distinct()


def redrawn(known: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, surrogate) of the entities whose first surrogate fails the checks, with one that passes.

    known: a stored table (kind, value) of distinct entities. Each round holds the surrogates of
    that draw against all entities and all surrogates given so far; the entities that fail are
    drawn again. Ends when none fails, or with an error after DRAWS rounds.
    """
    listed = F.expr(f"kind = 'name' AND map_contains_key({_names(key)}, value)")
    drawn = known.select("kind", "value", listed.alias("listed"), F.expr(surrogate("value", "kind", key)).alias("surrogate"), F.lit(0).alias("draw"))
    drawn = materialize(drawn, "drawn")
    for draw in range(1, DRAWS + 2):
        taken = drawn.join(known.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi").where("NOT listed").select("kind", "value")
        # of the entities that share a surrogate the one of the earliest draw keeps it; a listed name always does
        keeps = drawn.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct(~F.col("listed"), "draw", "value")).alias("first")).where("n > 1")
        shared = drawn.join(keeps, ["kind", "surrogate"]).where("value <> first.value").select("kind", "value")
        failed = materialize(taken.unionByName(shared).distinct(), "failed")
        if failed.isEmpty():
            release(failed)
            return drawn.where("draw > 0").select("kind", "value", "surrogate")
        if draw > DRAWS:
            n = {r["kind"]: r["count"] for r in failed.groupBy("kind").count().collect()}
            raise ValueError(f"no free surrogates after {DRAWS} draws (entities by kind: {n}): a form of fixed length is full")
        again = failed.select("kind", "value", F.lit(False).alias("listed"), F.expr(surrogate("value", "kind", key, draw)).alias("surrogate"), F.lit(draw).alias("draw"))
        drawn, before = materialize(drawn.join(failed, ["kind", "value"], "left_anti").unionByName(again.select(*drawn.columns)), "drawn"), drawn
        release(before, failed)
    raise AssertionError("unreachable")


def pseudonymize(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with a surrogate in the place of each entity, and `entities` added.

    entities: array<struct<kind, start, end, value, surrogate>>, code points of the original text,
    end exclusive. Null texts stay null, without entities; rows without an entity are unchanged;
    texts of any length are read whole; repeated rows and null ids stay; extra columns of any name are
    carried along (but `entities`, which is replaced); n_chars follows the text where it is there; an
    empty table gives none. The texts taken apart are stored once, so the patterns run once.
    """
    kept = [c for c in docs.columns if c != "entities"]
    row, parts, mine, own, at = free([*kept, "entities"], "_row", "_parts", "_redrawn", "_own", "_at")
    found = _apart(docs.select(*kept), parts, at)
    found = materialize(found.withColumn("text", F.when(F.col(parts).isNull(), F.col("text"))).withColumn(row, F.monotonically_increasing_id()), "apart")
    known = materialize(entities(found, parts), "entities")
    exceptions = materialize(redrawn(known, key), "exceptions")
    release(known)
    if exceptions.isEmpty():
        rows = found.withColumn(mine, F.lit(None).cast("map<string,string>"))
    else:
        values = F.expr(f"flatten(transform({_sql_entities(parts)}, e -> CASE WHEN {kind('e')} = 'name' THEN split(e, ' ') ELSE array(e) END))")
        each = found.where(F.col(parts).isNotNull()).select(row, F.explode(F.array_distinct(values)).alias("value"))
        of_row = each.join(exceptions.select("value", "surrogate"), "value").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias(mine))
        rows = found.join(materialize(of_row, "redrawn"), row, "left")
    name = f"array_join(transform(split(e, ' '), w -> CASE WHEN {_is_name('w')} THEN coalesce(try_element_at(`{mine}`, w), transform(array('name'), n -> {surrogate('w', 'n', key)})[0]) ELSE w END), ' ')"
    other = f"coalesce(try_element_at(`{mine}`, e), {surrogate('e', 'q', key)})"
    drawn = f"transform(array({kind('e')}), q -> named_struct('kind', q, 'value', e, 'surrogate', CASE WHEN q = 'name' THEN {name} ELSE {other} END))[0]"
    rows = rows.withColumn(own, F.expr(f"transform({_sql_entities(parts)}, e -> {drawn})"))
    starts = f"aggregate(`{parts}`, named_struct('at', 0L, 'out', CAST(array() AS array<bigint>)), (a, x) -> named_struct('at', a.at + length(x), 'out', concat(a.out, array(a.at))), a -> a.out)"
    rows = rows.withColumn(at, F.expr(starts))
    told = F.expr(f"transform(`{own}`, (e, i) -> named_struct('kind', e.kind, 'start', `{at}`[2 * i + 1], 'end', `{at}`[2 * i + 1] + length(e.value), 'value', e.value, 'surrogate', e.surrogate))")
    none = F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint,value:string,surrogate:string>>)")
    new = F.when(F.col(parts).isNotNull(), F.expr(f"array_join(transform(`{parts}`, (p, i) -> CASE WHEN i % 2 = 1 THEN `{own}`[CAST((i - 1) / 2 AS int)].surrogate ELSE p END), '')")).otherwise(F.col("text"))
    out = rows.withColumn("entities", F.coalesce(told, none)).withColumn("text", new)
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.when(F.col(parts).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*kept, "entities")
