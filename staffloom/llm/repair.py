"""Cheapest repair of damaged conversations, by a Viterbi search that emits edits as soon as its survivors agree.

A conversation's role initials must read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.  Rows are kept (0),
get another role (1, user or assistant) or are deleted (2); an empty user or assistant turn may be inserted anywhere (5).  Blank
and repeated rows must go; a truncated row that stays costs 5 more.  Of the cheapest edits the one whose string of initials
(D, I, K, R) is least in ASCII counts.

* States are what has been read: nothing (E), the system turn (S), a user turn (U), an assistant turn (A).  Each state has one
  survivor, the cheapest way to it; ways of one price are told by their strings.  (A way's price follows from its
  string, so one of two equally cheap ways is never a prefix of the other, and the lesser stays the lesser whatever
  follows: survivors can be chosen as rows come.)
* Backpointers are a tree whose nodes count their references, from children and survivors.  When the survivors share an
  ancestor, the edits up to it are final: they leave, with their rows, and memory holds the unresolved rest.  A survivor that
  costs more than replacing it by another state's can ever save is dropped, else the empty way would stay to the end.
* Ties compare the whole unresolved strings back to the common ancestor.

Repeats are found by Spark before (a window over a text's digest), rows are dealt by conversation, sorted, and streamed:
a task holds one conversation's unresolved rows, not the conversation.  (Where only the end decides the first edit, as in a
conversation of nothing but user turns, all of it is unresolved.)

Defined results: a null role or text is one space; null turns come first, rows that tie are ordered by role and text, repeated rows
stay (and count as duplicates); rows without conv_id are one conversation.  A conversation of which no row is left has one output
row without an edit.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffloom.llm.common import columns_of

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: What a state takes next, by initial; a user or assistant turn may also be inserted or made by a new role.
NEXT = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
MADE = {"E": ("U", "user"), "S": ("U", "user"), "U": ("A", "assistant"), "A": ("U", "user")}
#: A survivor of the first state that costs so much more than one of the second can win nothing any more.
BEHIND = {("E", "A"): 2, ("S", "A"): 0, ("U", "A"): 5, ("E", "U"): 7, ("S", "U"): 5, ("A", "U"): 5}
ROWS = ["conv_id", "turn", "role", "text", "fault", "dropped"]
EDITS = "conv_id long, edit string, turn long, role string, text string, fault string, illegal boolean, cost int"


class Node:
    """An edit on the way of some survivors; ``refs`` counts children and survivors, ``depth`` the edits before it."""

    __slots__ = ("parent", "edit", "role", "cost", "depth", "refs")

    def __init__(self, parent: Node | None, edit: str, role: str | None, cost: int):
        self.parent, self.edit, self.role, self.cost, self.refs = parent, edit, role, cost, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def release(node: Node | None) -> None:
    """One reference less; nodes without any go, with what they alone held."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node.parent, node = None, node.parent


def less(a: Node, x: str, b: Node, y: str) -> bool:
    """Whether the string of ``a`` and ``x`` is less than that of ``b`` and ``y``, from their common ancestor on."""
    left, right = [x], [y]
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class Survivors:
    """The search over one conversation; rows come one by one, final edits leave."""

    def __init__(self):
        root = Node(None, "", None, 0)
        root.refs = 1
        self.best: dict[str, tuple[int, Node]] = {"E": (0, root)}  # price and node by state
        self.root, self.root_state = root, "E"
        self.rows: deque = deque()  # rows whose edit is not final
        self.since = 0

    def _take(self, moves: list[tuple[int, Node, str, str, str | None, int]]) -> None:
        """The best move into each state: (price, node it comes from, edit, state, role it makes, price of the edit)."""
        won: dict[str, tuple] = {}
        for move in moves:
            held = won.get(move[3])
            if held is None or move[0] < held[0] or move[0] == held[0] and less(move[1], move[2], held[1], held[2]):
                won[move[3]] = move
        old = [node for _, node in self.best.values()]
        self.best = {}
        for price, node, edit, state, role, cost in won.values():
            child = Node(node, edit, role, cost) if edit else node
            child.refs += 1
            self.best[state] = (price, child)
        for node in old:
            release(node)

    def insert(self) -> None:
        """Turns inserted before the next row: one after another until no state gains."""
        for _ in range(2):
            moves = [(price, node, "", state, None, 0) for state, (price, node) in self.best.items()]
            moves += [(price + INSERT_COST, node, INSERT, MADE[s][0], MADE[s][1], INSERT_COST) for s, (price, node) in self.best.items()]
            self._take(moves)

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        self.rows.append((turn, role, text, fault))
        self.insert()
        moves = []
        late = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, (price, node) in self.best.items():
            moves.append((price + DELETE_COST, node, DELETE, state, None, DELETE_COST))
            if fault in (BLANK, DUPLICATE):
                continue
            kept = NEXT[state].get(role[:1])
            if kept:
                moves.append((price + late, node, KEEP, kept, None, late))
            moves.append((price + REROLE_COST + late, node, REROLE, *MADE[state], REROLE_COST + late))
        self._take(moves)
        for (state, other), most in BEHIND.items():
            if state in self.best and other in self.best and self.best[state][0] > self.best[other][0] + most:
                release(self.best.pop(state)[1])
        self.since += 1

    def final(self) -> Iterator[tuple]:
        """Edits that all survivors share, with their rows.  Looks only when enough rows came since to pay for it."""
        node = next(iter(self.best.values()))[1]
        if self.since < 8 or self.since < (node.depth - self.root.depth) // 2:
            return
        self.since = 0
        yield from self._emit(node)

    def end(self) -> Iterator[tuple]:
        """The edits that are left, by the best way to a complete conversation."""
        self.insert()
        done = [(self.best[s][0], self.best[s][1], s) for s in ("E", "A") if s in self.best]
        won = done[0]
        for other in done[1:]:
            if other[0] < won[0] or other[0] == won[0] and less(other[1], "", won[1], ""):
                won = other
        yield from self._emit(won[1], whole=True)

    def _emit(self, node: Node, whole: bool = False) -> Iterator[tuple]:
        way = []
        while node is not self.root:
            way.append(node)
            node = node.parent
        for node in reversed(way):
            if not whole and self.root.refs > 1:  # a fork, or a survivor: not final
                return
            self.root, node.parent = node, None
            if node.edit == INSERT:
                yield INSERT, None, node.role, "", None, node.cost
                continue
            turn, role, text, fault = self.rows.popleft()
            yield node.edit, turn, node.role if node.edit == REROLE else role, text, fault, node.cost


def fault_of(text: Column, repeated: Column) -> Column:
    last = F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, BLANK).when(repeated, DUPLICATE).when(~last.isin(*ENDS), TRUNCATED)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after a damage that their ids fix: ``conv_id, turn, role, text, dropped``; dropped rows stay, without words.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its full stops and marks, 3 repeats it,
    4 makes it the user's.
    """
    rows = columns_of(conversations, conv_id="long", turn="long", role="string", text="string")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("time")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), times).drop("time")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (``conv_id, turn, role, text`` and, if there, ``dropped``) with each one's first fault, nulls as one space."""
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c)
    plain = rows.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), said("role"), said("text"), dropped.alias("dropped"))
    what = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    keyed = plain.withColumn("what", what)
    seen = F.row_number().over(Window.partitionBy("conv_id", "what", "dropped").orderBy("turn"))
    told = keyed.withColumn("repeated", seen > 1)
    return told.select("conv_id", "turn", "role", "text", fault_of(F.col("text"), F.col("repeated")).alias("fault"), "dropped", "repeated")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each edit of each conversation, in order: ``edit`` (K, R, D, I), role and text after it, its price, and the
    input row's turn and fault and whether it makes an illegal pair of roles with the input row before it.

    ``rows`` has ``conv_id, turn, role, text`` and may have ``dropped`` (rows that only say that the conversation exists).
    Edits of a conversation come together; a conversation without rows has one output row without an edit.
    """

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, state, before, any_row = None, None, None, False
        pairs: deque = deque()  # for input rows whose edit is not final: whether they make an illegal pair

        def tell(edits: Iterator[tuple]) -> None:
            for edit, turn, role, text, fault, cost in edits:
                illegal = pairs.popleft() if edit != INSERT else None
                out.append((conv, edit, turn, role, text, fault, illegal, cost))

        def close() -> None:
            tell(state.end())
            if not any_row:
                out.append((conv, None, None, None, None, None, None, 0))

        for batch in it:
            for own, turn, role, text, fault, dropped in zip(*(column.to_pylist() for column in batch.columns)):
                if state is None or own != conv:
                    if state is not None:
                        close()
                    conv, state, before, any_row = own, Survivors(), None, False
                if not dropped:
                    pairs.append(before is not None and (before + role[:1]) not in ("su", "ua", "au"))
                    before, any_row = role[:1], True
                    state.add(turn, role, text, fault)
                    tell(state.final())
                if len(out) >= 10_000:
                    yield batch_of(out, EDITS)
                    out.clear()
        if state is not None:
            close()
        if out:
            yield batch_of(out, EDITS)

    ready = with_faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "repeated")
    return ready.select(*ROWS).mapInArrow(search, EDITS)


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def batch_of(rows: list, schema: str) -> pa.RecordBatch:
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(col, KINDS[kind]) for col, (_, kind) in zip(zip(*rows), named)], [name for name, _ in named])


SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_turns long"
)


def summary(edits: DataFrame) -> DataFrame:
    """What the edits of each conversation say, read in the order in which ``repair`` gives them."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, now = [], None, None

        def close() -> tuple:
            low, high, distinct, counts, audit, digest, n, cost = now
            gaps = high - low + 1 - distinct if distinct else 0
            return conv, gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], counts["illegal"], cost, "".join(audit), digest.hexdigest(), n

        for batch in it:
            for own, edit, turn, role, text, fault, illegal, cost in zip(*(column.to_pylist() for column in batch.columns)):
                if now is None or own != conv:
                    if now is not None:
                        out.append(close())
                    conv, now = own, [None, None, 0, {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, "illegal": 0}, [], hashlib.sha256(), 0, 0]
                if edit is None:
                    continue
                if turn is not None:
                    now[0] = turn if now[0] is None else now[0]
                    now[2] += turn != now[1]
                    now[1] = turn
                if fault:
                    now[3][fault] += 1
                now[3]["illegal"] += bool(illegal)
                now[4].append(edit)
                if len(now[4]) > 4096:
                    now[4] = ["".join(now[4])]
                now[7] += cost
                if edit != DELETE:
                    now[5].update((f"\n{role}:{text}" if now[6] else f"{role}:{text}").encode())
                    now[6] += 1
            if len(out) >= 10_000:
                yield batch_of(out, SUMMARY)
                out.clear()
        if now is not None:
            out.append(close())
        if out:
            yield batch_of(out, SUMMARY)

    return edits.mapInArrow(read, SUMMARY)
