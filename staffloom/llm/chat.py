"""Chat formatting in budgeted windows of whole turns.

Turns of a conversation, in order, are marked by a template and cut into windows of at most ``budget`` tokens: a
running prefix sum of turn tokens tells how far a window's span of new turns reaches.  Every window begins with the
conversation's system turn; later ones then repeat the last turns before their span, up to ``history`` tokens.  The
loss mask covers assistant texts, and each only in the window where its turn is new: repeated targets are masked.

Control strings inside texts are escaped by one backslash after each ``<`` that begins one, which reading takes away.
Rows are dealt by conversation, sorted, and streamed, so memory holds one window and not a conversation.

Defined results: a null text or role is empty; turns that tie are ordered by role and text, repeated rows stay; a null
turn comes first, rows without conv_id are one conversation; a turn larger than the budget is a window of its own
(with the system turn); an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import columns_of

BUDGET, HISTORY = 1024, 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TARGET, SYSTEM = "assistant", "system"
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
WINDOWS = "conv_id long, window_no long, text string, loss array<struct<start:int,end:int>>, n_repeated int, n_tokens long"


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Turn:
    """A formatted turn: its text, tokens, and the span of its target in that text, if it has one."""

    role: str
    body: str
    tokens: int
    target: tuple[int, int] | None


def formatted(role: str, text: str, count: Callable[[str], int]) -> Turn:
    head, inner = f"{OPEN}{escape_role(role)}\n", escape(text)
    body = f"{head}{inner}{CLOSE}\n"
    return Turn(role, body, count(body), (len(head), len(head) + len(inner)) if role == TARGET else None)


@dataclass
class Windows:
    """The windows of one conversation; turns come one by one."""

    budget: int
    history: int
    system: Turn | None = None
    kept: deque[Turn] = field(default_factory=deque)  # turns that may be repeated
    repeated: list[Turn] = field(default_factory=list)
    new: list[Turn] = field(default_factory=list)
    prefix: int = 0  # tokens of all turns so far
    begin: int = 0  # the prefix sum where the new turns begin
    head: int = 0  # tokens of the system turn and the repeated turns
    number: int = 0

    def add(self, turn: Turn) -> Iterator[tuple]:
        if self.new and self.head + self.prefix - self.begin + turn.tokens > self.budget:
            yield self.row()
            self.start(turn.tokens)
        self.new.append(turn)
        self.prefix += turn.tokens
        if self.number == 0 and self.system is None and len(self.new) == 1 and turn.role == SYSTEM:
            self.system = turn  # it is new here and repeated in later windows
        else:
            self.kept.append(turn)
            while len(self.kept) > 1 and sum(t.tokens for t in self.kept) > self.history:
                self.kept.popleft()

    def start(self, tokens: int) -> None:
        """Begin the next window: system turn, and as much history as its limits and the first new turn allow."""
        self.number += 1
        room = self.budget - tokens - (self.system.tokens if self.system else 0)
        past: list[Turn] = []
        for t in reversed(self.kept):
            room -= t.tokens
            if room < 0 or sum(p.tokens for p in past) + t.tokens > self.history:
                break
            past.append(t)
        self.repeated = ([self.system] if self.system else []) + past[::-1]
        self.new, self.begin, self.head = [], self.prefix, sum(t.tokens for t in self.repeated)

    def row(self) -> tuple:
        at, spans = sum(len(t.body) for t in self.repeated), []
        for t in self.new:
            if t.target:
                spans.append({"start": at + t.target[0], "end": at + t.target[1]})
            at += len(t.body)
        text = "".join(t.body for t in [*self.repeated, *self.new])
        return self.number, text, spans, len(self.repeated), self.head + self.prefix - self.begin


def windows(conversations: DataFrame, counter: Callable[[], Callable[[str], int]], budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation: text, loss spans in it (code points), number of repeated turns, tokens.

    ``counter`` makes a task's token counter.  Windows of a conversation come together and in order.
    """

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, conv, state = counter(), None, None
        schema = pa.schema([("conv_id", pa.int64()), ("window_no", pa.int64()), ("text", pa.string()),
                            ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_repeated", pa.int32()), ("n_tokens", pa.int64())])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        out: list[tuple] = []
        for batch in it:
            for own, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or own != conv:
                    if state is not None:
                        out.append((conv, *state.row()))
                    conv, state = own, Windows(budget, history)
                out += [(conv, *row) for row in state.add(formatted(role or "", text or "", count))]
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if state is not None:
            out.append((conv, *state.row()))
        if out:
            yield batch_of(out)

    rows = columns_of(conversations, conv_id="long", turn="long", role="string", text="string")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(cut, WINDOWS)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns in a window."""
    return [(unescape_role(role), unescape(body)) for role, body in TURN.findall(text)]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(formatted_windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say: turns without the repeated ones, text under the loss mask."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, state = [], None
        for batch in it:
            for conv, text, loss, n_repeated in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "loss", "n_repeated"))):
                if state is None or conv != state[0]:
                    if state is not None:
                        rows.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in read_turns(text)[n_repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
                state[6] += 1
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        if state is not None:
            rows.append(state)
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        plain = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in row] for row in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*plain), kinds)], [c.split()[0] for c in DIGEST.split(", ")])

    return formatted_windows.mapInArrow(read, DIGEST)
