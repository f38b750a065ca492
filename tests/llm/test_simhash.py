"""SimHash groups against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from staffloom.llm import simhash
from tests.llm.test_llm import SCHEMA, edited, keyed_texts, prose


def plain_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Least node reachable from each: nodes are any values that sort, ``linked`` says for two."""
    least = {n: n for n in nodes}
    moved = True
    pairs = [(a, b) for a, b in itertools.combinations(nodes, 2) if linked(a, b)]
    while moved:
        moved = False
        for a, b in pairs:
            low = min(least[a], least[b])
            moved |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def expected(rows):
    """``rows`` of (doc_id or None, text) -> sorted result rows."""
    key = lambda i: -(1 << 63) if i is None else i
    prints = {}
    for i, text in rows:
        prints.setdefault(key(i), set()).add(plain_print(text))
    least = groups(sorted(prints), lambda a, b: any((p ^ q).bit_count() <= 4 for p in prints[a] for q in prints[b]))
    show = lambda i: None if i == key(None) else i
    return sorted(((i, f"{plain_print(t):016x}", show(least[key(i)])) for i, t in rows), key=repr)


def result(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_triples_are_in_every_four_positions():
    assert len(simhash.triples()) == 20
    for four in itertools.combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash.triples())


def test_fingerprint_in_stretches(monkeypatch):
    texts = [prose(2000, 3), "One two  THREE\x0bfour", "one", "É é A\x1cb", "", None, " \t"]
    want = [plain_print(t) for t in texts]
    assert [simhash.fingerprint(t.encode() if t is not None else None) for t in texts] == want
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert [simhash.fingerprint(t.encode() if t is not None else None) for t in texts] == want
    assert want[-3:] == [0, 0, 0]


def test_simhash_over_texts(spark):
    rows = [(i, t, "en", None, None, "s", "g", "i", "m") for i, t in keyed_texts()]
    rows += [(100 + k, edited(prose(900, 9), 300 + k), "en", None, None, None, None, None, None) for k in range(12)]
    rows += [rows[3], rows[5], (3, prose(900, 9), None, None, None, None, None, None, None), (4, None, None, None, None, None, None, None, None)]
    rows += [(200, "long " * 300_000, "en", None, None, None, None, None, None)]
    got = result(simhash.linked_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == expected([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("longest", [simhash.LIST, 5])
def test_links_of_given_fingerprints(spark, longest):
    r = random.Random(longest)
    centres = [r.getrandbits(64) for _ in range(6)]
    prints = {c for c in centres}
    for c in centres:
        while len(prints) < 300 and r.random() < 0.98:
            bits = r.sample(range(64), r.randint(1, 6))
            prints.add(c ^ sum(1 << b for b in bits))
    prints |= {centres[0] ^ (1 << k) for k in range(64)}  # a group of near copies that shares lists
    prints = sorted(prints)
    entries = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, print long")
    from staffloom.llm.common import components

    edges = simhash.links(entries, longest=longest)
    assert edges.count() < 20 * len(prints) * (1 if longest > 5 else 40)
    got = {r[0]: r[1] for r in components(entries.select("id"), edges).collect()}
    assert got == groups(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)


def test_forest():
    a, b = simhash.forest(np.array([5, 1, 7, 9]), np.array([1, 3, 9, 7]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 1), (5, 1), (9, 7)]


def test_simhash_of_an_empty_table(spark):
    assert result(simhash.linked_groups(spark.createDataFrame([], SCHEMA))) == []
