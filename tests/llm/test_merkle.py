"""Merkle manifest against plain Python and against SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from staffloom.llm import merkle
from tests.llm.test_llm import SCHEMA


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = n_chars + more if n_chars is not None else None
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(nodes, place):
    """Top of a tree, and for one node the pairs of (left siblings, right siblings) on the way."""
    way = []
    while len(nodes) > 1:
        run = place // 2 * 2
        way.append((nodes[run:place], nodes[place + 1 : run + 2]))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        place //= 2
    return nodes[0], way


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [sorted((r[0] is not None, r[0] or 0, leaf(r), r) for r in groups[g]) for g in order]
    subroots = [climbed([x[2] for x in t], 0)[0] for t in trees]
    out = []
    for k, tree in enumerate(trees):
        for place, (_, _, own, row) in enumerate(tree):
            _, low = climbed([x[2] for x in tree], place)
            root, high = climbed(subroots, k)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            fold = leaf(row, 1) if tampered else own
            for left, right in low + high:
                fold = h(*left, fold, *right)
            proof = h(*("".join(left + right) for left, right in low + high))
            out.append((row[0], own, subroots[k], root, proof, fold, fold == root))
    return sorted(out, key=repr)


def result(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(docs, tampered)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "siblings", "folded"]
    rows = []
    for r in out.collect():
        proof = h(r["siblings"].hex())
        rows.append((r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), proof, r["folded"].hex(), r["folded"] == r["root"]))
    return sorted(rows, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], "s", "g", "i", "m") for r in rows], SCHEMA).repartition(3)


ROWS = [(i, f"text {i} é", "en", f"s{i % 3}", i) for i in range(70)]
ROWS += [(i, "x" * i, "de", None, None) for i in range(100, 117)] + [(200, None, None, None, None), (None, "", None, "", 3), (None, "", None, "", 3)]
ROWS += [(300, "one", "fr", "s", 1), (301, "long " * 100_000, "éa", "s", 500_000), ROWS[5], ROWS[5], (5, "other text", "en", "s", 2)]


def test_manifest(spark):
    assert result(table(spark, ROWS)) == expected(ROWS)


@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_one_group(spark, n):
    assert result(table(spark, ROWS[:n])) == expected(ROWS[:n])


def test_many_rounds_hot_nodes_and_shuffled_climb(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", 2)
    monkeypatch.setattr(merkle, "BLOCK", 2)
    monkeypatch.setattr(merkle, "HELD", 4)
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 3)
    rows = [(i, "t", "en" if i % 3 else f"l{i % 30}", "s", i) for i in range(300)]
    assert result(table(spark, rows)) == expected(rows)


def test_tampering_is_seen(spark):
    got = result(table(spark, ROWS))
    assert {r[0] for r in got if not r[6]} == {r[0] for r in ROWS if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}


def test_manifest_of_an_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_manifest_equals_its_sql(spark):
    from staffloom.llm.queries import ORACLES, QUERIES
    from tests.oracle import bag, connect

    folder = "/root/testdata/sf0.001"
    got = QUERIES["op11_merkle_manifest"](spark, folder)
    want = connect(folder).sql(ORACLES["op11_merkle_manifest"])
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(want.columns, want.fetchall())
