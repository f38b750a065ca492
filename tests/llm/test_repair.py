"""Conversation repair against all edit sequences, against a plain table of prices, and against SQL."""

import hashlib
import itertools
import random
import re

import pytest

from staffloom.llm import repair

CONV = "conv_id long, turn long, role string, text string, fault string, edit string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def judged(rows):
    """Faults and counts of one conversation: rows of (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, out = set(), []
    for turn, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def all_repairs(rows, most_inserts):
    """Best (price, audit) over every sequence of edits, by trying all of them."""
    best = None

    def go(i, initials, price, audit, inserts):
        nonlocal best
        if best and price > best[0]:
            return
        if i == len(rows) and GOOD.match(initials):
            best = min(best or (price, audit), (price, audit))
        if inserts:
            for made in "ua":
                go(i, initials + made, price + 5, audit + "I", inserts - 1)
        if i < len(rows):
            _, role, _, fault = rows[i]
            go(i + 1, initials, price + 2, audit + "D", inserts)
            if fault in ("blank", "duplicate"):
                return
            late = 5 if fault else 0
            go(i + 1, initials + role[:1] if role else initials + "?", price + late, audit + "K", inserts)
            for made in "ua":
                go(i + 1, initials + made, price + 1 + late, audit + "R", inserts)

    go(0, "", 0, "", most_inserts)
    return best


def table_repair(rows):
    """The same by a table over rows and states, with whole strings."""
    after = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
    best = {"E": (0, "")}

    def insert(best):
        best = dict(best)
        for _ in range(3):
            for state, (price, audit) in list(best.items()):
                for made in "ua":
                    if made in after[state]:
                        to = after[state][made]
                        best[to] = min(best.get(to, (price + 5, audit + "I")), (price + 5, audit + "I"))
        return best

    for _, role, _, fault in rows:
        new = {}
        for state, (price, audit) in insert(best).items():
            ways = [(price + 2, audit + "D", state)]
            if fault not in ("blank", "duplicate"):
                late = 5 if fault else 0
                if role[:1] in after[state]:
                    ways.append((price + late, audit + "K", after[state][role[:1]]))
                ways += [(price + 1 + late, audit + "R", after[state][m]) for m in "ua" if m in after[state]]
            for p, a, s in ways:
                new[s] = min(new.get(s, (p, a)), (p, a))
        best = new
    return min(v for s, v in insert(best).items() if s in "EA")


def replay(rows, audit):
    """The repaired turns that an audit string means."""
    state, rest, said = "", list(rows), []
    for edit in audit:
        need = "user" if state in ("", "s", "a") else "assistant"
        row = rest.pop(0) if edit != "I" else None
        if edit == "D":
            continue
        role = row[1] if edit == "K" else need
        state = role[0]
        said.append(f"{role}:{row[2] if row else ''}")
    assert not rest
    return said


def searched(rows):
    """Edits of the operator's search, as they leave, and how many rows it held at most."""
    search, out, held = repair.Survivors(), [], 0
    for row in rows:
        search.add(*row)
        out += search.final()
        held = max(held, len(search.rows))
    out += search.end()
    return out, held


def random_rows(r, n):
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", ""], ["Good.", "so", "Yes!", "", " \n", "Why? ", "é."]
    return judged([(k, r.choice(roles), r.choice(texts) + ("" if r.random() < 0.5 else f" {k}.")) for k in range(n)])


def test_search_against_all_edits():
    r = random.Random(3)
    for n in [0, 1, 2, 3, 3, 4, 4, 4, 4] * 25:
        rows = random_rows(r, n)
        edits, _ = searched(rows)
        assert (sum(e[5] for e in edits), "".join(e[0] for e in edits)) == all_repairs(rows, 3) == table_repair(rows), rows


def test_search_against_the_table():
    r = random.Random(4)
    for n in [5, 9, 20, 33, 150] * 40:
        rows = random_rows(r, n)
        edits, _ = searched(rows)
        assert (sum(e[5] for e in edits), "".join(e[0] for e in edits)) == table_repair(rows)
        assert [f"{e[2]}:{e[3]}" for e in edits if e[0] != "D"] == replay(rows, table_repair(rows)[1])


@pytest.mark.parametrize("roles", [["user", "assistant"], ["user", "assistant", "user", "assistant", "user"], ["user", "user", "assistant", "user", "assistant", "assistant"]])
def test_memory_does_not_follow_the_length(roles):
    rows = [(k, roles[k % len(roles)], f"turn {k}.", None) for k in range(20_000)]
    edits, held = searched(rows)
    assert held < 64 and len([e for e in edits if e[0] != "I"]) == 20_000


@pytest.mark.parametrize("n", [500, 501])
def test_unresolved_ties_are_held_whole(n):
    # only the end says whether the first of these rows goes: nothing is final before
    rows = [(k, "user", f"turn {k}.", None) for k in range(n)]
    edits, held = searched(rows)
    assert held == n and "".join(e[0] for e in edits) == table_repair(rows)[1] == ("D" if n % 2 else "") + "KR" * (n // 2)
    edits, _ = searched([(k, "user", "", "blank") for k in range(n)])
    assert "".join(e[0] for e in edits) == "D" * n


def expected(conversations):
    out = []
    for conv, rows in conversations.items():
        rows = judged(rows)
        turns = [t for t, *_ in rows if t is not None]
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        price, audit = table_repair(rows)
        said = replay(rows, audit)
        count = lambda what: sum(r[3] == what for r in rows)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, price, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), len(said)))
    return sorted(out, key=repr)


def test_repair_over_tables(spark):
    r = random.Random(5)
    conversations = {}
    for conv in [None, *range(40)]:
        turns = sorted(r.sample(range(60), r.randint(1, 25)))
        rows = [(t, r.choice(["system", "user", "assistant", None, "tool"]), r.choice(["Good.", None, "", "so", f"Yes {t}!"])) for t in turns]
        conversations[conv] = rows + rows[:2] + [(None, "user", "early."), (turns[0], "user", "tie.")]
    conversations[50] = [(k, "user" if k % 2 else "assistant", "w " * 200_000 + ".") for k in range(3)]
    rows = [(c, t, ro, x, "clash", "clash") for c, own in conversations.items() for t, ro, x in own]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    edits = repair.repair(df)
    assert sorted(map(tuple, repair.summary(edits).collect()), key=repr) == expected(conversations)
    assert edits.where("conv_id = 50").count() >= 3


def test_damage(spark):
    import zlib

    rows = [(c, t, role, text) for c in [None, *range(60)] for t, (role, text) in enumerate([("system", "Be. Nice!"), ("user", "Hi?"), ("assistant", None), (None, "Well. ")])]
    rows += [(7, None, "user", "No turn.")]
    df = spark.createDataFrame([(*r, "f", "e") for r in rows], CONV)
    say = lambda v: " " if v is None else str(v)
    conversations = {}
    for c, t, role, text in rows:
        own = conversations.setdefault(c, [])
        kind = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [] if kind == 0 else [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = repair.summary(repair.repair(repair.damaged(df))).collect()
    assert sorted(map(tuple, got), key=repr) == expected(conversations)


def test_conversations_without_rows(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([(1, 0, "", "", True), (2, 0, "user", "Hi.", False), (2, 1, "", "", True)], "conv_id long, turn long, role string, text string, dropped boolean")
    got = sorted(map(tuple, repair.summary(repair.repair(df)).collect()))
    assert got[0] == (1, 0, 0, 0, 0, 0, 0, "", nothing, 0)
    assert got[1][:8] == (2, 0, 0, 0, 0, 0, 2, "D")
    assert repair.summary(repair.repair(df.limit(0))).collect() == []


def test_repair_equals_its_sql(spark, folder):
    from staffloom.llm.queries import ORACLES, QUERIES
    from tests.oracle import bag, connect

    got = QUERIES["op12_conversation_repair"](spark, folder)
    want = connect(folder).sql(ORACLES["op12_conversation_repair"])
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(want.columns, want.fetchall())
