"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staffloom.llm import chat, decontamination, jaccard_join, licenses, line_dedup, packing, quality, secret_scan, substring_dedup, toxicity
from staffloom.llm.common import WordHashes, components, keyed
from staffloom.llm.queries import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, gone string, id string, mark string"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(VOCAB) for _ in range(min(12, n - k))) for k in range(0, n, 12))


def edited(text, step):
    return " ".join(w if i % step else "changed" for i, w in enumerate(text.split(" ")))


TEXTS = [
    None, "", " \n\t ", "one", prose(200, 1), prose(200, 1), prose(200, 2), edited(prose(200, 1), 60), prose(6000, 3), "same same " * 40,
    prose(60, 4) + "\n" + prose(30, 5), prose(30, 5) + "\n" + prose(60, 6), prose(100, 7).replace("a", "A"), "é" * 50 + "\n" + "é" * 49 + "x",
    prose(150, 8) + ' token = "a9f8b7c6d5e4f3a2b1c0" end',
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, None, "s", "g", "i", "m") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[10], (None, TEXTS[6], None, "a/test/x.py", 3, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed_texts():
    """Different documents in order, the null id first."""
    return [(None, TEXTS[6]), *enumerate(TEXTS)]


def test_words_and_hashes():
    text = "a\x0bb \x1cc d\t\n é".encode()
    h, a, b = WordHashes()(text)
    assert [text[i:j] for i, j in zip(a, b)] == text.split() == [b"a", b"b", b"\x1cc\xc2\xa0d", b"\xc3\xa9"]
    long = ("x" * 700_000 + " y" * 300_000).encode()
    assert len(WordHashes()(long)[0]) == 300_001 and len(set(WordHashes()(long)[0].tolist())) == 2


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 55), (7, 7)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 62)], "id long")
    got = {r[0]: r[1] for r in components(nodes, edges).collect()}
    assert got == {i: 1 if i <= 40 else 50 if i in (50, 55, 60) else i for i in range(1, 62)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.choice("abcd"))
            b.pop(r.randint(0, len(b) - 1))
        b, e = "".join(b), r.randint(0, 4)
        assert line_dedup.within(a, b, e) == (distance(a, b) <= e)


def test_a_line_has_few_keys(spark):
    """A long line of 2 edits has 8 keys and sometimes those of the classes below (24 before)."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(24 + i))) for i in range(60)], "doc_id long, text string")
    lines = line_dedup.first_lines(keyed(docs), line_dedup.WIDE).collect()
    sizes = [len(x["index"]) + len(x["probe"]) for x in lines]
    assert len(sizes) == 60 and max(sizes) <= 16 and sum(sizes) / 60 <= 11


@pytest.mark.parametrize(
    "limits, size, alphabet, space",
    [
        (line_dedup.Limits(1, ((20, 1), (40, 2)), ()), (18, 70), "abcé", ""),
        (line_dedup.Limits(1, (), ((8, 1), (24, 2))), (6, 40), ["a", "bb", "", "ddd"], " "),
        (line_dedup.Limits(1, ((10, 3), (30, 5)), ()), (8, 50), "ab", ""),
        (line_dedup.Limits(1, ((1, 1), (4, 2)), ()), (1, 12), "ab", ""),
    ],
)
def test_near_lines_share_a_key(limits, size, alphabet, space):
    r, keys, near = random.Random(2), line_dedup.LineKeys(limits), 0
    for _ in range(1500):
        a = [r.choice(alphabet) for _ in range(r.randint(*size))]
        b = list(a)
        for _ in range(r.randint(0, 3)):
            b.insert(r.randint(0, len(b)), r.choice(alphabet)) if r.random() < 0.5 else b.pop(r.randrange(len(b))) if b else None
        x, y = space.join(a), space.join(b)
        if line_dedup.near(x, y, limits):
            n, index, probe = keys([t.encode() for t in ("other", x, y)])
            (_, ix, iy), (_, px, py) = (tuple(set(v) for v in k.to_pylist()) for k in (index, probe))
            assert n.tolist() == [5, len(x), len(y)] and ix & (iy | py) | iy & px, (x, y)
            near += 1
    assert near > 200


def test_near_copies_of_one_line_do_not_all_meet(spark):
    """Of a key that many near copies share, each late line is held against one other first; the rest only where that fails."""
    rng = random.Random(5)
    base = [f"word{i}x" for i in range(30)]
    lines = [" ".join([*base[:20], *(rng.choice([w, f"{w}{rng.randrange(40)}"]) if i > 27 else w for i, w in enumerate(base[20:], 20))]) for _ in range(400)]
    lines = list(dict.fromkeys(lines))
    bits = np.array([np.frombuffer(line_dedup.sketch(t), "<i8") for t in lines])
    cols = {"key": [7] * len(lines), "id": range(len(lines)), "mark": [0] * len(lines), "line_no": [0] * len(lines), "indexed": [True] * len(lines)}
    cols |= {f"b{k}": bits[:, k] for k in range(bits.shape[1])} | {"bw": [line_dedup.word_sketch(t.split(" ")) for t in lines]}
    cols |= {"n": map(len, lines), "nw": [30] * len(lines), "open": [True] * len(lines)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(list(v), pa.int32() if k in ("mark", "line_no", "n", "nw") else None) for k, v in cols.items()})
    pairs = lambda nearest: [r for b in line_dedup.list_pairs(iter([batch]), line_dedup.WIDE, nearest) for r in b.to_pylist()]
    every = {(r["early"]["id"], r["late"]["id"]) for r in pairs(False)}
    near = {(i, j) for j in range(len(lines)) for i in range(j) if line_dedup.near(lines[i], lines[j], line_dedup.WIDE)}
    assert near <= every and len(near) > 10 * len(lines)
    one = [(r["early"]["id"], r["late"]["id"]) for r in pairs(True)]
    assert set(one) <= every and len(one) == len(lines) - 1
    got = line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), line_dedup.WIDE)
    assert {r.doc_id for r in got.collect() if r.n_removed} == {j for _, j in near}


def test_line_dedup(spark, empty):
    r, base = random.Random(3), [prose(10, 100 + k) for k in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 5)):
            line = list(r.choice(base))
            for _ in range(r.choice((0, 0, 1, 2, 3, 5))):
                line[r.randint(0, len(line) - 1)] = r.choice("xyzé")
            lines.append("".join(line)[r.choice((0, 0, 1)) :])
        rows.append((i, "\n".join([*lines, "short"])))
    rows += [(60, None), (61, ""), rows[5], (None, rows[7][1])]
    got = line_dedup.dedup(spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, gone string").repartition(4))
    assert got.columns == ["doc_id", "text", "gone", "n_lines", "n_removed"]
    seen, want = [], {}
    for doc_id, text in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            known = [s for s in seen if abs(len(s) - len(line)) < 3 and distance(s, line) < 3] if len(line) >= 40 else []
            if len(line) >= 40:
                seen.append(line)
            if not known:
                kept.append(line)
        want[doc_id] = None if text is None else "\n".join(kept)
    assert collections.Counter((x.doc_id, x.text) for x in got.collect()) == collections.Counter((d, want[d]) for d, _ in rows)
    assert line_dedup.dedup(empty).count() == 0


def test_short_lines_and_edited_words(spark):
    words = [" ".join(VOCAB[k * 40 + i] for i in range(n)) for k, n in enumerate((8, 12, 24, 30))]
    swap = lambda line, *at: " ".join("replacement" if i in at else w for i, w in enumerate(line.split(" ")))
    lines = ["All rights reserved.", "}", "", *words, "next", "All rights reserved.", "}", "", "All rights reserved!", "]"]
    lines += [swap(words[0], 3), swap(words[1], 0), swap(words[2], 2, 20), swap(words[3], 29), "more " + words[1]]
    lines += [swap(words[0], 1, 5), swap(words[3], 1, 9, 20)]
    got = line_dedup.dedup(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), line_dedup.WIDE).first()
    assert got.text.split("\n") == [*lines[:8], "", "]", swap(words[0], 1, 5), swap(words[3], 1, 9, 20)] and got.n_removed == 8


def test_substring_dedup(docs, empty):
    seen, want = set(), {}
    for doc_id, text in keyed_texts():
        words = (text or "").encode().split()
        out = [False] * len(words)
        for k in range(len(words) - 19):
            key = tuple(words[k : k + 20])
            if key in seen:
                out[k : k + 20] = [True] * 20
            seen.add(key)
        want[doc_id] = (len(words), sum(out), b" ".join(w for w, x in zip(words, out) if not x).decode())
    got = substring_dedup.dedup(docs).collect()
    assert len(got) == len(TEXTS) + 3 and all(tuple(r[1:]) == want[r.doc_id] for r in got)
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_of_hot_minimisers(docs, monkeypatch):
    whole = sorted(map(str, substring_dedup.dedup(docs).collect()))
    monkeypatch.setattr(substring_dedup, "HOT", 1)
    assert sorted(map(str, substring_dedup.dedup(docs).collect())) == whole


def sets_of(rows):
    out = collections.defaultdict(list)
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out[doc_id].append(frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset())
    return out


def test_jaccard_join(spark, empty):
    rows = list(keyed_texts())
    for k in range(40):
        rows.append((100 + k, edited(prose(150 + k, 50 + k % 4), 25 + 9 * (k % 7))))
    rows += [rows[5], (101, prose(90, 51)), (200, prose(90, 51))]
    got = jaccard_join.linked_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sets, up = sets_of(rows), {}
    order = lambda x: (x is not None, x or 0)

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    ids = sorted(sets, key=order)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((top(a), top(b)), key=order)
                up[q] = p
    assert len(got) == len(rows)
    assert all(r.component_id == top(r.doc_id) and r.n_shingles in map(len, sets[r.doc_id]) for r in got)
    assert jaccard_join.linked_groups(empty).count() == 0


def test_order_of_shingles_counts_all_documents(spark):
    texts = [" ".join(["every text has these words", *([f"some of them {k % 7}"] if k % 3 else []), prose(30, k)]) for k in range(240)]
    n = np.zeros(jaccard_join.CELLS, np.int64)
    for t in texts:
        np.add.at(n, jaccard_join.cells(jaccard_join.shingles(t.encode(), WordHashes(lower=True))), 1)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    assert n.max() >= 240 and (jaccard_join.frequency_levels(frame, jaccard_join.SHINGLE) == (8 * np.log2(np.maximum(n, 1))).astype(np.uint8)).all()


def test_sets_meet_their_nearest_before_all_others():
    """Sets of a list that are far from its leader but near each other: two pairs a set at most, one with a near set."""
    r = np.random.default_rng(3)
    families = [np.unique(r.integers(0, 1 << 63, 100).astype(np.uint64)) for _ in range(5)]
    sets = sorted((np.unique(np.append(f, r.integers(0, 1 << 63, 2).astype(np.uint64))) for f in families for _ in range(60)), key=len)
    kind = [int(np.argmax([len(np.intersect1d(s, f)) for f in families])) for s in sets]
    folds = np.array([jaccard_join.folded(jaccard_join.bit_map(s)) for s in sets])
    cols = {"token": [1] * 300, "n": [len(s) for s in sets], "id": range(300), "f1": range(300)} | {f"fold{k}": folds[:, k] for k in range(jaccard_join.FOLDS)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(list(v), pa.int64()) for k, v in cols.items()})
    pairs = [(p["a"], p["b"]) for b in jaccard_join.leader_pairs(iter([batch]), 85) for p in b.to_pylist()]
    assert len(pairs) <= 600
    first = {kind.index(k) for k in set(kind)}
    assert {b for a, b in pairs if kind[a] == kind[b]} >= set(range(300)) - first


def test_maps_never_put_aside_a_link():
    r = np.random.default_rng(9)
    for n in (1, 5, 60, 700):
        for _ in range(60):
            own = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            other = np.unique(np.concatenate([own[r.random(len(own)) < 0.93], r.integers(0, 1 << 63, r.integers(0, 1 + n // 12)).astype(np.uint64)]))
            a, b = (jaccard_join.folded(jaccard_join.bit_map(s)) for s in (own, other))
            differ, shared = int(np.bitwise_count((a ^ b).view(np.uint64)).sum()), len(np.intersect1d(own, other))
            assert differ <= len(own) + len(other) - 2 * shared
            if 100 * shared >= 85 * (len(own) + len(other) - shared):
                assert jaccard_join.may_link(np.array([len(own) + len(other)]), np.array([differ]))[0]


def test_near_copies_of_the_pipeline(spark):
    import corpus_pipeline

    text = " ".join(prose(290, 40).split())
    words = text.split(" ")
    copy = " ".join("changed" if i in (40, 100, 160, 210, 250, 280) else w for i, w in enumerate(words))
    frame = spark.createDataFrame([(1, text), (2, copy), (3, prose(300, 41))], "doc_id long, text string")
    five = [{tuple(t.split(" ")[k : k + 5]) for k in range(286)} for t in (text, copy)]
    assert 80 * len(five[0] | five[1]) <= 100 * len(five[0] & five[1]) < 85 * len(five[0] | five[1])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()) == [1, 3]
    assert {r.doc_id: r.component_id for r in jaccard_join.linked_groups(frame, 5, 82).collect()} == {1: 1, 2: 2, 3: 3}


def test_keep_one(docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 1, 2, 3, 4, 8} <= set(ids) and 5 not in ids and None in ids and 6 not in ids


def test_stages_judge_rows_by_their_own_text(spark):
    import corpus_pipeline

    a, b, item = prose(90, 60), prose(90, 61), prose(40, 920)
    rows = [(None, a), (None, b), (None, prose(90, 62)), (1, a), (2, b), (3, prose(90, 63)), (3, prose(90, 64)), (3, prose(90, 64)), (None, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, frame, "").collect()
    assert collections.Counter(map(tuple, kept)) == collections.Counter([*rows[:3], *rows[5:7], *rows[8:]])
    held = frame.union(spark.createDataFrame([(None, b + " " + item), (3, item)], frame.schema))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontamination.keep_clean(held, items, by_text=True).collect()
    assert collections.Counter(map(tuple, clean)) == collections.Counter(rows)


def test_toxicity(spark, empty):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        words, bad = [r.choice(VOCAB) for _ in range(r.randint(10, 60))], i % 4 == 0
        if bad:
            for w in ("vile", "scum", "vile"):
                words[r.randint(0, len(words) - 1)] = w
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame([*rows, (None, None), (9999, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (77777, 1)], "doc_id long, toxic int")
    scored = toxicity.score(frame, toxicity.fit(frame, marks)).collect()
    held = [x for x in scored if x.doc_id is not None and x.doc_id < 1500 and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert np.mean([(x.score >= 0.5) == (x.doc_id % 4 == 0) for x in held]) > 0.95 and all(0 <= x.score <= 1 for x in scored)
    assert toxicity.keep_ordinary(empty, marks).columns == empty.columns and toxicity.keep_ordinary(empty, marks).count() == 0
    one_kind = toxicity.score(frame, toxicity.fit(frame, marks.where("toxic = 0"))).collect()
    assert max(x.score for x in one_kind) < 0.5


def test_toxicity_counts_the_rows_of_the_curve(spark):
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    ids = [i for i in range(400) if part(i)]
    rows = [(i, prose(20, i) + (" zork blat zork blat" if part(i) == 1 else " grim nasty grim nasty") * (i % 2)) for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    known = model.features(toxicity.Reader()([b"zork blat zork blat", b"grim nasty grim nasty"]))[:, 0]
    assert model.curve[1] > -1e-6 or model.curve[3] > 0
    assert known[0] > 1 and known[1] > 1


def plain_kneser_ney(words, other):
    """Log-likelihood of words as (class of ``words``) by its definition; ``other`` is the other class's words."""
    order, shared = toxicity.ORDER, toxicity.SHARED

    def grams(word):
        text = bytes(order - 1)[:-1] + b"\x01" + word + b" "
        return [text[i - order + 1 : i + 1] for i in range(order - 1, len(text))]

    def levels(own):
        out = {order: collections.Counter(g for w in own for g in grams(w))}
        for n in range(order - 1, 0, -1):
            out[n] = collections.Counter()
            for g, k in out[n + 1].items():
                out[n][g[1:]] += k if g[1] <= 1 else 1
        return out

    mine, theirs = levels(words), levels(other)
    for n in range(1, shared + 1):
        mine[n] = mine[n] + theirs[n]
    base = np.ones(256)
    for g, k in mine[1].items():
        base[g[0]] += k
    base /= base.sum()

    def p(g):
        if not g:
            raise ValueError
        low = p(g[1:]) if len(g) > 1 else base[g[-1]]
        level = mine[len(g)]
        once, twice = (sum(v == k for v in level.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = [k for h, k in level.items() if h[:-1] == g[:-1]]
        return (max(level[g] - d, 0) + d * len(same) * low) / sum(same) if same else low

    return lambda word: sum(np.log(p(g)) for g in grams(word))


def test_ratios_are_those_of_plain_kneser_ney(spark):
    r = random.Random(8)
    spell = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 9)))
    texts = [(i, " ".join(spell() for _ in range(r.randint(1, 8))), i % 3 == 0) for i in range(60)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic boolean").repartition(3)
    model = toxicity.model_of(toxicity.count(rows))
    of = lambda toxic: [w.encode() for _, t, x in texts if x == toxic for w in t.split()]
    bad, fine = plain_kneser_ney(of(True), of(False)), plain_kneser_ney(of(False), of(True))
    words = sorted({*of(True)[:15], *of(False)[:15], b"zzz", "abcé".encode() * 5, b"a", b"q"})
    assert np.allclose(model.word_ratios(words), [bad(w) - fine(w) for w in words], atol=1e-4)


def test_toxicity_of_odd_rows(spark):
    long = "vile " + prose(150_000, 4)
    rows = [(1, "vile scum vile", "x"), (1, "vile scum vile", "x"), (2, long, "y"), (3, None, None), (4, " ", "z")]
    docs = spark.createDataFrame([*rows, *((100 + i, prose(10 + i % 7, i) + (" vile scum" if i % 2 else " kind note"), "w") for i in range(200))], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(200)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "score"] and dict(out.dtypes)["score"] == "double"
    got = {i: [x.score for x in out.where(F.col("doc_id") == i).collect()] for i in (1, 2, 3, 4)}
    assert len(got[1]) == 2 and got[1][0] == got[1][1] > 0.5 and got[3] == got[4] and all(0 <= v <= 1 for c in got.values() for v in c)


def test_quality_counts_and_chain(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        text = (TEXTS[6] if r.doc_id is None else TEXTS[r.doc_id]) or ""
        words = text.encode().split()
        runs = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        again = {k + j for k in range(len(words) - 7) if runs[tuple(words[k : k + 8])] > 1 for j in range(8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), len(again))
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words)) and r.kept == (not r.base_failed)
    assert quality.judge(empty, quality.fit(empty, labels)).count() == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    chain = quality.Chain(r.normal(size=quality.FIGURES), r.normal(size=(2, 2)), 0.5)
    for n in (1, 2, 6):
        x = r.normal(size=(n, quality.FIGURES))
        worth = lambda s: sum(x[t] @ chain.weights * s[t] for t in range(n)) + sum(chain.moves[s[t - 1], s[t]] for t in range(1, n))
        paths = [[p >> t & 1 for t in range(n)] for p in range(1 << n)]
        assert chain.decode(x).tolist() == max(paths, key=worth)


def test_decontamination(spark, empty):
    item, other = prose(40, 900).replace("\n", " "), prose(40, 901)
    words = item.split()
    changed = " ".join("zzz" if i % 9 == 4 else w for i, w in enumerate(words))
    rows = [(1, prose(80, 1) + " " + item), (2, changed + " " + prose(50, 2)), (3, prose(300, 3)), (4, None), (5, ""), (1, prose(5, 3)), (None, item.upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, other), (9, None), (10, "a b"), (7, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(frame, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)} and got[1, 7].score == 1 and 0.5 < got[2, 7].score < 1
    assert (got[1, 7].first_word, got[1, 7].end_word) == (80, 120)
    assert sorted(r.doc_id for r in decontamination.keep_clean(frame, items).collect()) == [3, 4, 5]
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.contaminated(frame, items.limit(0)).count() == 0


def test_decontamination_by_shuffle(spark, monkeypatch):
    frame = spark.createDataFrame([(i, prose(60, i) + " " + (prose(30, 900) if i % 2 else "")) for i in range(6)], "doc_id long, text string")
    items = spark.createDataFrame([(1, prose(30, 900))], "item_id long, text string")
    sent = sorted(map(str, decontamination.contaminated(frame, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_GRAMS", 0)
    assert sorted(map(str, decontamination.contaminated(frame, items).collect())) == sent and len(sent) == 3


def test_an_exact_copy_hides_no_edited_copy(spark):
    item = prose(60, 910)
    words = item.split()
    copy = " ".join("zzz" if i % 6 == 3 else w for i, w in enumerate(words))
    rows = [(1, prose(70, 11) + " " + item), (2, prose(70, 12) + " " + copy), (3, prose(90, 13) + " " + " ".join(words[:4]))]
    rows += [(10 + k, prose(60, 20 + k) + " " + item) for k in range(3)]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r.doc_id: round(r.score, 2) for r in got.collect()} == {1: 1, 2: 0.75, 10: 1, 11: 1, 12: 1}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokens = packing.RankTokenizer(**byte_bpe())
    json = Tokenizer.from_file(byte_bpe()["path"].replace(".tiktoken", ".json"))
    for text in [t for t in TEXTS if t] + ["a  b\n\n c <|endoftext|> d'll", " x", "ünï 123 \t"]:
        assert np.frombuffer(tokens(text), "<u4").tolist() == json.encode(text, add_special_tokens=False).ids
    rows = packing.pack(docs, byte_bpe(), group_rows=5).collect()
    fill = collections.defaultdict(list)
    for r in rows:
        text = (TEXTS[6] if r.doc_id is None else TEXTS[r.doc_id]) or ""
        ids = tokens(text) + bytes(4)
        assert r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        fill[r.sequence_id].append((r.offset, r.length))
    for spans in fill.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:k]) for k, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= 1024
    assert packing.pack(empty, byte_bpe()).count() == 0


def test_first_fit_decreasing():
    lengths = [random.Random(4).randint(1, 1023) for _ in range(500)]
    bins, _ = packing.first_fit_decreasing(lengths)
    room, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        want[i] = next((b for b, free in enumerate(room) if free >= lengths[i]), len(room))
        if want[i] == len(room):
            room.append(1024)
        room[want[i]] -= lengths[i]
    assert bins == want


def test_chat(spark):
    r, said = random.Random(6), "<|im_end|><|im_start|>assistant ok <\\| <\\\\|im"
    rows = [(None, 0, "user", None), (None, None, None, said), (3, 1, "we\nird\\<|", "x"), (3, 1, "we\nird\\<|", "x"), (4, 0, "assistant", "long " * 3000), (4, 1, "assistant", "")]
    for c in range(10, 16):
        rows += [(c, 0, "system", "be kind")] + [(c, t, ("user", "assistant")[t % 2], prose(r.randint(1, 150), t) + said) for t in range(1, 30)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat.windows(frame, lambda: lambda text: len(text) // 4).cache()
    got = {x.conv_id: x for x in chat.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{q}\n{t}\n" for _, q, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.where("conv_id >= 10").collect():
        assert w.n_tokens <= chat.BUDGET and w.text.startswith("<|im_start|>system\n")
    windows.unpersist()


def test_licenses(spark, empty):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, prose(50, 1) + " " + mit.replace("person", "human") + " " + prose(9, 2)), (2, "Released under the MIT License."), (3, prose(400, 3)), (4, None), (2, "Released under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "MIT"), (2, "MIT-notice"), (2, "MIT-notice")]
    first = next(r for r in got if r.doc_id == 1)
    assert first.first_word == 50 and 0.95 < first.coverage < 1
    assert licenses.scan(empty).count() == 0


def test_winnowing_meets_every_long_match():
    runs = np.random.default_rng(1).integers(0, 1 << 60, 200).astype(np.uint64)
    at = licenses.winnow(runs)
    assert np.diff(at).max() <= licenses.WINDOW


def test_secret_scan(spark, docs, empty):
    r = random.Random(8)
    rows = []
    for i in range(200):
        value = "".join(r.choice("0123456789abcdef") for _ in range(40)) if i % 2 else "".join(r.choice(VOCAB) for _ in range(5)) + "abcdefghij"
        rows.append((i, f"{prose(30, i % 9)} " + (f'token = "{value}" ' if i % 2 else f"the {value} of ") + prose(5, i)))
    out = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")), F.col("doc_id") % 5 != 0)
    got = out.where("doc_id % 5 = 0").collect()
    assert len(got) >= 40 and all(x.is_secret == bool(x.doc_id % 2) for x in got)
    assert secret_scan.scan(docs, F.lit(True)).where("doc_id = 14").count() == 1
    assert secret_scan.scan(empty, F.lit(True)).count() == 0


def test_pipeline(spark, folder):
    import corpus_pipeline

    documents = spark.read.parquet(f"{folder}/documents.parquet")
    docs = documents.limit(0).union(documents.where("doc_id < 120"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == documents.columns, name
