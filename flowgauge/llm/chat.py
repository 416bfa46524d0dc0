"""Operator 1: chat formatting by schema fingerprints.

A record's nested field paths are hashed to a fingerprint, which selects a declarative
mapping of its layout to canonical turns (role, text). Turns are then rendered with a
template; control strings inside texts are escaped reversibly; a loss mask marks the texts
to learn from.

Records of one conversation are ordered by turn; a conversation is written in segments, one
per turn, and never held as a whole. Nulls and edge cases: null text is empty; a null role
stays null through the round trip; rows of a null conversation id form one conversation;
turns of equal number are ordered by role and text, and repeated rows are all kept; a
layout without mapping, broken JSON, or JSON nested too deep to read, gives no turns and
``layout`` null; half a surrogate pair, which no UTF-8 text can hold, becomes U+FFFD; an
empty table gives no rows; fields that no mapping names are ignored. Rows of one conversation
meet in one task, as a stream whose sort can spill; so do those without conversation id.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import map_rows, small_batches


@dataclass(frozen=True)
class Layout:
    """Turns of a record: of each element of ``each`` (or of the record itself), or of fixed fields.

    ``role`` and ``text`` are paths in the element. ``fixed`` lists (role, paths): the texts
    at these paths, joined by an empty line, are a turn; empty ones are left out. ``roles``
    renames roles.
    """

    name: str
    paths: tuple[str, ...]
    each: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: Half a surrogate pair.
LONE = re.compile("[\ud800-\udfff]")
NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = [
    Layout("turn", ("role", "text"), role="role", text="text"),
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content", roles=NAMES),
    Layout("system messages", ("system", "messages[].role", "messages[].content"), "messages", "role", "content", (("system", ("system",)),), NAMES),
    Layout("from value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=NAMES),
    Layout("instruction", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction input", ("instruction", "input", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system instruction", ("system", "instruction", "input", "output"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("completion", ("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system response", ("system", "prompt", "response"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("nested chat", ("chat.prompt", "chat.reply"), fixed=(("user", ("chat.prompt",)), ("assistant", ("chat.reply",)))),
]


def field_paths(value: Any, at: str = "") -> set[str]:
    """Nested paths of all leaves; elements of lists count as ``[]``."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


class Registry:
    def __init__(self, layouts: list[Layout] = LAYOUTS):
        self.known = {p for x in layouts for p in x.paths}
        self.by_print = {fingerprint(x.paths): x for x in layouts}

    def layout(self, record: Any) -> Layout | None:
        return self.by_print.get(fingerprint(field_paths(record) & self.known))

    def turns(self, text: str | None) -> tuple[str | None, list[tuple[str | None, str]]]:
        """The layout's name and the canonical turns of a JSON record."""
        try:
            record = json.loads(text or "")
            x = self.layout(record)
        except (ValueError, RecursionError):
            return None, []
        if x is None:
            return None, []
        roles, out = dict(x.roles), []
        for role, paths in x.fixed:
            said = [s for p in paths if (s := _text(_at(record, p)))]
            if said or role != "system":
                out.append((role, "\n\n".join(said)))
        if x.role:
            for e in (_at(record, x.each) or []) if x.each else [record]:
                role = _at(e, x.role)
                role = role if role is None else _text(role)
                out.append((roles.get(role, role), _text(_at(e, x.text))))
        return x.name, out


def _at(value: Any, path: str) -> Any:
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value: Any) -> str:
    if value is None:
        return ""
    return sound(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def sound(text: str) -> str:
    """``text`` with U+FFFD for each half of a surrogate pair."""
    return text if text.isascii() else LONE.sub("\ufffd", text)


#: The template: ``### role: text </turn>`` and a line end. In texts a backslash precedes each
#: backslash and the first character of each control string, so neither starts inside a text.
OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"
IN_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
IN_ROLE = re.compile(r"[\\:#<\n]")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
NO_ROLE = r"\0"
LEARN = "assistant"


def escape(text: str) -> str:
    return IN_TEXT.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text lies in it."""
    head = OPEN + (NO_ROLE if role is None else IN_ROLE.sub(r"\\\g<0>", role)) + MID
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted text; raises if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((None if m[1] == NO_ROLE else unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def canonical_turns(records: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """conv_id, turn, pos, layout, role, text of records (conv_id, turn, record as JSON).

    A record without mapping gives one row with ``layout`` and ``pos`` null."""

    def make():
        registry = Registry(layouts)

        def step(cols):
            out: dict[str, list] = {k: [] for k in ("conv_id", "turn", "pos", "layout", "role", "text")}
            for conv, turn, record in zip(cols["conv_id"], cols["turn"], cols["record"], strict=True):
                name, turns = registry.turns(record)
                for pos, (role, text) in enumerate(turns) if name else [(None, (None, None))]:
                    for k, v in zip(out, (conv, turn, pos, name, role, text), strict=True):
                        out[k].append(v)
            return out

        return step

    return map_rows(records.select("conv_id", "turn", "record"), "conv_id long, turn long, pos long, layout string, role string, text string", make)


SEGMENT = "conv_id long, seq long, start long, formatted string, loss_start long, loss_end long"


def format_turns(turns: DataFrame) -> DataFrame:
    """Segments of conversations: the formatted turns in order, each with its offset in the whole
    and the span of the loss mask (null but for the assistant's), in code points."""
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = object()
        seq = start = 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, seq, start = conv, 0, 0
                said, lo, hi = render(role, text or "")
                mask = (start + lo, start + hi) if role == LEARN else (None, None)
                out.append((conv, seq, start, said, *mask))
                seq, start = seq + 1, start + len(said)
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string() if k == 3 else pa.int64() for k in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SEGMENT.split(", ")])

    rows = turns.where("layout is not null").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "pos", "role", "text")
    return rows.mapInArrow(run, SEGMENT)


def whole(segments: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: one row a conversation, for conversations that fit in one."""
    s = F.array_sort(F.collect_list(F.struct("seq", "formatted", "loss_start", "loss_end")))
    out = segments.groupBy("conv_id").agg(s.alias("s"))
    mask = F.transform(F.filter("s", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end")))
    return out.select("conv_id", F.array_join(F.transform("s", lambda x: x["formatted"]), "").alias("formatted"), mask.alias("mask"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame) -> DataFrame:
    """Read the formatted text back: turns by parsing it, learned text by the mask.

    ``segments`` must come from ``format_turns``: they pass in order, and only the state of a
    hash is kept of the conversation that is being read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row():
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def rows(out):
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string() if k in (2, 4) else pa.int64() for k in range(6)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

        for batch in batches:
            out: list[tuple] = []
            cols = (batch.column(k).to_pylist() for k in ("conv_id", "start", "formatted", "loss_start", "loss_end"))
            for conv, start, said, lo, hi in zip(*cols, strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(said):
                    state[1] += 1
                    state[2].update(f"{role or ''}\n{text}\n".encode())
                if lo is not None:
                    learned = unescape(said[lo - start : hi - start])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] = start + len(said)
            yield rows(out)
        if state is not None:
            yield rows([row()])

    return segments.mapInArrow(run, DIGEST)


def oracle(rows: str) -> str:
    """DuckDB SQL of the digests of the conversations of ``rows``, SQL for (conv_id, turn, role, text)."""
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text"
    assistant = f"FILTER (role = '{LEARN}')"
    runs = "coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0)"
    body = rf"length(text) + length(text) - length(replace(text, '\', '')) + {runs} + len(string_split(text, '</turn>')) - 1"
    role = r"CASE WHEN role IS NULL THEN 2 ELSE length(regexp_replace(role, '[\\:#<\n]', '..', 'g')) END"
    fixed = len(OPEN + MID + CLOSE)
    return f"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM ({rows}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) {assistant}, 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) {assistant}, '')) AS loss_sha256,
  sum({fixed} + {role} + {body})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
