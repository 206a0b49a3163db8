"""Chat formatting: a finite-state machine over roles checks turn order; a declarative template
emits text segments, each with its loss flag.

Rows of a conversation are sorted within their partition and streamed, so a conversation of any
length costs one row of memory (state, digest), never a gathered group. Control strings of the
template start with `#` or `<`; both characters, and the backslash, are escaped inside texts with
a backslash, so that the formatted text reads back exactly (`read_turns`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, which roles carry loss, and which role may follow in which state.

    `order` maps a state to {role: next state}; a role that a state doesn't name is a violation:
    the turn is formatted all the same and the machine goes to that role's own state.
    """

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    head: str = "### {}: "
    tail: str = " </turn>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    final: frozenset[str] = frozenset({"assistant"})
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    def header(self, role: str) -> str:
        """A known role has its label; any other is written out behind an @, escaped."""
        return self.head.format(self.labels[role] if role in self.labels else "@" + escape(role))


TEMPLATE = Template()
_CONTROL = re.compile(r"[\\#<:]")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def segments(role: str, text: str, template: Template = TEMPLATE) -> list[tuple[str, bool]]:
    """(text, loss) segments of one turn: header, escaped text, tail."""
    return [(template.header(role), False), (escape(text), role in template.loss), (template.tail, False)]


def read_turns(parts: Iterable[str], template: Template = TEMPLATE) -> Iterator[tuple[str, str]]:
    """(role, text) turns out of formatted text, which may come in pieces of whole turns."""
    roles = {label: role for role, label in template.labels.items()}
    before, after = map(re.escape, template.head.split("{}"))
    turn = re.compile(before + r"((?:[^\\#<:]|\\.)*)" + after + r"((?:[^\\#<:]|\\.)*)" + re.escape(template.tail), re.DOTALL)
    for part in parts:
        at = 0
        while at < len(part):
            m = turn.match(part, at)
            if not m:
                raise ValueError(f"no turn at {at}: {part[at : at + 40]!r}")
            yield (unescape(m[1][1:]) if m[1].startswith("@") else roles[m[1]]), unescape(m[2])
            at = m.end()


def format_turns(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Format every conversation: one row per segment, in order of (conv_id, turn_no, segment).

    conv_id, turn_no (0.. in order of turn, nulls first, then role and text), segment (0 header,
    1 text, 2 tail), role, text, loss, ok (false at a turn the machine doesn't allow). Null roles
    and texts count as empty; rows with a null conv_id form one conversation; repeated rows stay.
    Rows come sorted within partitions, each conversation whole in one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, no, state = None, -1, template.start
        seen = False
        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not seen or c != conv:
                    conv, no, state, seen = c, -1, template.start, True
                no += 1
                ok = role in template.order.get(state, {})
                state = template.order[state][role] if ok else role
                out += [(c, no, k, role, s, loss, ok) for k, (s, loss) in enumerate(segments(role, text, template))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()))], names=["conv_id", "turn_no", "segment", "role", "text", "loss", "ok"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn_no long, segment int, role string, text string, loss boolean, ok boolean")


def digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation, read back from its segments: turns, their digest, the loss text's, lengths, validity.

    The input must be `format_turns`' output as it is (whole conversations, in order): it is
    streamed on without another shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def close(x: dict) -> tuple:
            return x["conv"], x["n"], x["turns"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"], x["ok"] and x["role"] in template.final, x["bad"]

        for batch in batches:
            done: list[tuple] = []
            conv, no, loss, ok = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("conv_id", "turn_no", "loss", "ok"))
            text = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for c, t, s, masked, good in zip(conv, no, text, loss, ok, strict=True):
                if now is None or c != now["conv"] or (t == 0 and now["no"] > 0):
                    if now:
                        done.append(close(now))
                    now = {"conv": c, "no": t, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "ok": True, "bad": None, "role": None, "open": []}
                now["no"] = t
                now["chars"] += len(s)
                now["open"].append(s)
                if masked:
                    plain = unescape(s)
                    now["loss"].update(plain.encode("utf-8", "surrogatepass"))
                    now["loss_chars"] += len(plain)
                if not good and now["ok"]:
                    now["ok"], now["bad"] = False, t
                if s == template.tail and len(now["open"]) == 3:
                    for role, plain in read_turns(["".join(now["open"])], template):
                        now["n"] += 1
                        now["role"] = role
                        now["turns"].update(f"{role}\n{plain}\n".encode("utf-8", "surrogatepass"))
                    now["open"] = []
            yield _closed(done)
        yield _closed([close(now)] if now else [])

    def _closed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_bad_turn"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_bad_turn long")
