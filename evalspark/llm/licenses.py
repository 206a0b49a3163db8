"""License scans: wordings with optional and replaceable regions, compiled into automata over words.

A wording is text with markup: what stands in ``<<beginOptional>> ... <<endOptional>>`` may be
missing (regions may be nested), ``<<var;name="x";words="a-b">>`` stands for any a to b words, the
rest is mandatory and has to match word by word; case, punctuation and layout don't count. A
wording is compiled once, into states with their steps by word. A text's words are numbered by
the vocabulary of all wordings, exactly, and an automaton starts only where the first two words of
one stand. Every region is bounded, so a start costs at most the longest wording, and the work
grows with a text's words, whatever they are. Phrases are wordings without regions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import free, slices, word_bounds

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text: letters, digits, and everything beyond ASCII
MARKUP = re.compile(r'(<<beginOptional>>|<<endOptional>>|<<var;name="[^"]*";words="\d+-\d+">>)')

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Spellings that count as one word inside wordings (never inside phrases).
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "favour": "favor", "organisation": "organization", "https": "http"}

# Public license wordings, whole where they are short, else the notice that goes into files, and one-line statements.
_LIABLE = (
    'IN NO EVENT SHALL <<var;name="liable";words="1-15">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) '
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_PROVIDED = (
    'THIS SOFTWARE IS PROVIDED BY <<var;name="provider";words="1-15">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
)
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_ENDORSE = '<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="organization";words="1-20">> may be used to endorse or promote products derived from this software without specific prior written permission. '
WORDINGS = {
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        'IN NO EVENT SHALL <<var;name="liable";words="1-15">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
    "isc-text": (
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";words="1-10">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        'IN NO EVENT SHALL <<var;name="liable";words="1-10">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ),
    "bsd-2-clause-text": _CONDITIONS + _PROVIDED + _LIABLE,
    "bsd-3-clause-text": _CONDITIONS + _ENDORSE + _PROVIDED + _LIABLE,
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will <<var;name=\"author\";words=\"1-8\">> be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "<<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "<<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."
    ),
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0<<beginOptional>>.html<<endOptional>> '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "gpl-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": 'you can redistribute it and/or modify it under the terms of the GNU <<var;name="lesser or library";words="1-1">> General Public License as published by the Free Software Foundation',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit-statement": "under <<beginOptional>>the <<beginOptional>>terms of the<<endOptional>><<endOptional>> MIT License",
    "apache-2.0-statement": "Apache <<beginOptional>>Software<<endOptional>> License <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0",
    "gpl-2.0-statement": "General Public License <<beginOptional>>as published by the Free Software Foundation, <<beginOptional>>either<<endOptional>><<endOptional>> <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2",
    "gpl-3.0-statement": "General Public License <<beginOptional>>as published by the Free Software Foundation, <<beginOptional>>either<<endOptional>><<endOptional>> <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 3",
    "cc-by-4.0-statement": "CC BY <<beginOptional>>v<<endOptional>> 4.0",
    "cc-by-sa-4.0-statement": "CC BY-SA <<beginOptional>>v<<endOptional>> 4.0",
    "cc-by-nc-4.0-statement": "CC BY-NC <<beginOptional>>v<<endOptional>> 4.0",
}
ANY = None
FOUND = "array<struct<label:string,phrase:boolean,first_word:long,end_word:long,start:long,end:long>>"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def parse(markup: str) -> list:
    """Words, nested lists (optional regions) and pairs (least and most words of a replaceable one), in order."""
    stack: list[list] = [[]]
    for piece in MARKUP.split(markup):
        if piece == "<<beginOptional>>":
            stack.append([])
        elif piece == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError(f"an optional region ends that never began: {markup!r}")
            done = stack.pop()
            stack[-1].append(done)
        elif piece.startswith("<<var;"):
            least, most = map(int, re.search(r'words="(\d+)-(\d+)"', piece).groups())
            if not 0 <= least <= most or not most:
                raise ValueError(f"not a number of words: {piece}")
            stack[-1].append((least, most))
        elif "<<" in piece or ">>" in piece:
            raise ValueError(f"unknown markup in {piece!r}")
        else:
            stack[-1] += words_of(piece)
    if len(stack) > 1:
        raise ValueError(f"an optional region never ends: {markup!r}")
    return stack[0]


class Automaton:
    """States 0, 1, ... of one wording; `steps[s]` maps a word (ANY: whatever it is) to the states it leads to, those reached for nothing included."""

    def __init__(self, markup: str):
        self._edges: list[list[tuple]] = [[]]
        self._free: list[list[int]] = [[]]
        end = self._add(parse(markup), 0)
        closed = [self._closure(s) for s in range(len(self._edges))]
        self.start, self.end = closed[0], end
        self.steps: list[dict] = []
        for edges in self._edges:
            step: dict = {}
            for word, to in edges:
                step[word] = step.get(word, frozenset()) | closed[to]
            self.steps.append(step)
        firsts = {w: t for s in self.start for w, t in self.steps[s].items()}
        self.pairs = {(a, b) for a in firsts for s in set().union(*(self.steps[x].get(a, ()) for x in self.start)) for b in self.steps[s]}
        short = self.end in self.start or any(self.end in t for t in firsts.values())
        if short or any(ANY in p for p in self.pairs):
            raise ValueError(f"a wording begins with two words that are not replaceable: {markup!r}")

    def _state(self) -> int:
        self._edges.append([])
        self._free.append([])
        return len(self._edges) - 1

    def _add(self, items: list, at: int) -> int:
        for item in items:
            before = at
            if isinstance(item, str):
                at = self._state()
                self._edges[before].append((item, at))
            elif isinstance(item, list):
                at = self._add(item, before)
                if at != before:
                    self._free[before].append(at)
            else:
                least, most = item
                passed = [before]
                for _ in range(most):
                    at = self._state()
                    self._edges[passed[-1]].append((ANY, at))
                    passed.append(at)
                at = self._state()
                for s in passed[least:]:
                    self._free[s].append(at)
        return at

    def _closure(self, state: int) -> frozenset[int]:
        seen, open_ = {state}, [state]
        while open_:
            for to in self._free[open_.pop()]:
                if to not in seen:
                    seen.add(to)
                    open_.append(to)
        return frozenset(seen)

    def numbered(self, number: dict[str, int]) -> Automaton:
        """Steps by the vocabulary's numbers instead of words."""
        self.steps = [{ANY if w is ANY else number[w]: t for w, t in step.items()} for step in self.steps]
        self.pairs = {(number[a], number[b]) for a, b in self.pairs}
        return self

    def longest(self, ids: list[int]) -> int:
        """How many of the words, from the first on, the longest accepted run has; 0 if none is accepted."""
        now, most = self.start, 0
        for k, word in enumerate(ids):
            then: set[int] = set()
            for s in now:
                step = self.steps[s]
                then.update(step.get(word, ()))
                then.update(step.get(ANY, ()))
            if not then:
                break
            if self.end in then:
                most = k + 1
            now = then
        return most

    @property
    def length(self) -> int:
        """At most so many words a run has."""
        return len(self.steps)


class Scanner:
    """All wordings and phrases over numbered words."""

    def __init__(self, wordings: dict[str, str], phrases: dict[str, str], spellings: dict[str, str]):
        self.automata = [(label, True, Automaton(text)) for text, label in phrases.items()] + [(label, False, Automaton(text)) for label, text in wordings.items()]
        own = sorted({w for *_, a in self.automata for step in a.steps for w in step if w is not ANY} | set(spellings))
        number = {w: k + 1 for k, w in enumerate(own)}  # 0: no word of theirs
        self.fold = np.arange(len(own) + 1)
        for s, w in spellings.items():
            if w in number:
                self.fold[number[s]] = number[w]
        raw = [w.encode() for w in own]
        self._lengths = np.array([0, *map(len, raw)])
        self._bytes, self._first = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self._lengths) - self._lengths
        keys = np.array([self._key(w) for w in raw], np.uint64)
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        assert len(np.unique(keys)) == len(keys)
        self.automata = [(label, phrase, a.numbered(number)) for label, phrase, a in self.automata]
        v = len(own) + 1
        self.begins = {phrase: np.zeros((v, v), bool) for phrase in (True, False)}
        self.by_pair: dict[tuple, list] = {}
        for label, phrase, a in self.automata:
            for pair in a.pairs:
                self.begins[phrase][pair] = True
                self.by_pair.setdefault((phrase, *pair), []).append((label, a))
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.lower[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20

    @staticmethod
    def _key(word: bytes) -> int:
        """First and last four bytes and the length; equal keys are compared in full."""
        padded = word.ljust(4, b"\0")
        return int.from_bytes(padded[:4], "little") << 32 ^ int.from_bytes(padded[-4:], "little") << 6 ^ len(word)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, 0 if it isn't there; exact."""
        ids = np.zeros(len(starts), np.int64)
        if not len(starts):
            return ids
        lens = ends - starts
        head, tail = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        back = np.where(lens < 4, starts, ends - 4)
        for k in range(4):
            inside = k < lens
            shift = np.uint64(8 * k)
            head |= np.where(inside, data[np.minimum(starts + k, len(data) - 1)], 0).astype(np.uint64) << shift
            tail |= np.where(inside, data[np.minimum(back + k, len(data) - 1)], 0).astype(np.uint64) << shift
        key = (head << np.uint64(32)) ^ (tail << np.uint64(6)) ^ lens.astype(np.uint64)
        at = np.searchsorted(self._keys, key).clip(0, len(self._keys) - 1)
        hit = np.flatnonzero(self._keys[at] == key)
        number = self._order[at[hit]] + 1
        same = self._lengths[number] == lens[hit]
        hit, number = hit[same], number[same]
        if not len(hit):
            return ids
        n = lens[hit]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = data[np.repeat(starts[hit], n) + place] == self._bytes[np.repeat(self._first[number], n) + place]
        ok = np.logical_and.reduceat(equal, first)
        ids[hit[ok]] = number[ok]
        return ids

    def places(self, ids: np.ndarray, rows: np.ndarray) -> list[tuple[int, str, bool, int, int]]:
        """(row, label, phrase, first word, word after the last) by indexes into ids, in order of place.

        Every place of a phrase counts; a wording's places are the longest ones, from left to right, none inside another of its own.
        """
        out, last_of = [], np.append(np.flatnonzero(np.diff(rows)) + 1, len(rows))
        for phrase, seen in ((True, ids), (False, self.fold[ids])):
            begin = np.flatnonzero(self.begins[phrase][seen[:-1], seen[1:]] & (rows[:-1] == rows[1:])) if len(ids) else ids
            ends = last_of[np.searchsorted(last_of, begin, "right")] if len(begin) else begin
            done: dict[str, int] = {}
            for p, end in zip(begin.tolist(), ends.tolist(), strict=True):
                for label, a in self.by_pair.get((phrase, int(seen[p]), int(seen[p + 1])), ()):
                    if not phrase and p < done.get(label, 0):
                        continue
                    n = a.longest(seen[p : min(end, p + a.length)].tolist())
                    if n:
                        out.append((int(rows[p]), label, phrase, p, p + n))
                        done[label] = p + n
        return sorted(out, key=lambda x: (x[3], x[4], x[1], x[2]))


_scanners: dict[tuple, Scanner] = {}


def _scanner(*parts: tuple) -> Scanner:
    if parts not in _scanners:
        _scanners[parts] = Scanner(*map(dict, parts))
    return _scanners[parts]


def scan(docs: DataFrame, columns: list[str] | None = None, wordings: dict[str, str] = WORDINGS, phrases: dict[str, str] = PHRASES, spellings: dict[str, str] = SPELLINGS) -> DataFrame:
    """Every row's `columns` (all, unless given) with n_words, found and license_score.

    `found` has all places in order: label, whether a phrase or a wording, words and code points
    from first to behind the last. The score is 1 where a wording is accepted, else 1 - 0.5 ** the
    number of phrases. A null text is an empty one: no words, nothing found, score 0. Repeated rows
    give equal rows, an empty table none; columns of the new names get them lengthened. Texts of
    any length are read whole, in slices of rows.
    """
    columns = docs.columns if columns is None else columns
    (text,) = free(docs.columns, "_text")
    new = free(columns, "n_words", "found", "license_score")
    parts = tuple(tuple(d.items()) for d in (wordings, phrases, spellings))
    Scanner(*map(dict, parts))  # markup errors show here, not in a task
    schema = docs.select(*[docs[c] for c in columns], *[F.lit(None).cast(t).alias(c) for c, t in zip(new, ("long", FOUND, "double"), strict=True)]).schema
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scanner(*parts)
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                plain = s.lower[data]
                starts, ends, rows = word_bounds(plain, offsets)
                n_words = np.bincount(rows, minlength=part.num_rows)
                first_word = np.cumsum(n_words) - n_words
                found: list[list] = [[] for _ in range(part.num_rows)]
                places = s.places(s.numbers(plain, starts, ends), rows)
                if places:
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
                for row, label, phrase, a, b in places:
                    base, point = first_word[row], points[offsets[row]]
                    found[row].append({"label": label, "phrase": phrase, "first_word": a - base, "end_word": b - base, "start": points[starts[a]] - point, "end": points[ends[b - 1]] - point})
                score = [1.0 if any(not f["phrase"] for f in fs) else 1 - 0.5 ** len(fs) for fs in found]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(n_words.astype(np.int64)), pa.array(found, kind), pa.array(score, pa.float64())], names=[*columns, *new])

    return docs.select(*[docs[c] for c in columns], F.coalesce("text", F.lit("")).alias(text)).mapInArrow(run, schema)


def pattern(markup: str, spellings: dict[str, str] = SPELLINGS) -> str:
    """A regular expression of the wording, over words with a space before each and one at the end: for checks, and for SQL."""
    other: dict[str, list[str]] = {}
    for s, w in spellings.items():
        other.setdefault(w, []).append(s)

    def put(item) -> str:
        if isinstance(item, str):
            same = [item, *other.get(item, ())]
            return f" {item}" if len(same) == 1 else f" (?:{'|'.join(same)})"
        if isinstance(item, list):
            return f"(?:{''.join(map(put, item))})?"
        return f"(?: [^ ]+){{{item[0]},{item[1]}}}"

    return "".join(map(put, parse(markup))) + " "
