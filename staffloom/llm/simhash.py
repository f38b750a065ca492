"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of its runs of
``SHINGLE`` words (A-Z lowered, joined by one space, repeats included).  Two fingerprints link when at most ``MOST_BITS``
bits differ.  Each differing bit spoils one of the 8 bytes at most, so linked fingerprints share at least
8 - ``MOST_BITS`` bytes at their own positions: the guaranteed minimum of matches.

* Index: a posting says that a fingerprint has a byte at a position.  The list of one posting holds a 256th of all
  fingerprints, so lists are kept already met with each other: by ``KEY_POSITIONS`` = three positions, for the 20 triples
  of positions of which every set of four positions holds one (Turan's system; 8 positions in three groups).  Any pair
  that reaches the minimum so meets in a list, and lists hold a fingerprint in 2^24.
* Count filtering: in a list, the shared positional bytes of each pair are tallied; only pairs that reach the minimum are
  verified by their differing bits.
* Lists longer than ``LIST`` are dealt over pairs of parts, so that each task holds two parts at a time.  A part of
  a list puts out a spanning forest of its links (at most one link a fingerprint), never all pairs, so a group of
  thousands of near copies costs comparisons but no rows.

Equal fingerprints are one entry before all of this, whatever their number.

Defined results: fewer words than a shingle are one shingle; a null or empty text, or one of white space, has fingerprint
zero and is linked like any other.  Rows that repeat a doc_id are one node with all their links, each with its own
fingerprint; a null doc_id is a node of its own, smaller than all, and a component with it is null.  An empty table gives
no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import NO_ID, columns_of, components, doc_id_of, raw, sliced, stored

SHINGLE, SEED, MOST_BITS = 4, 42, 4
POSITIONS, KEY_POSITIONS = 8, 3
#: Fingerprints of a list (or of two parts of it) that a task compares at a time, at most twice this.
LIST = 4096
#: Shingles that are counted at a time.
STRETCH = 1 << 16


def triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions such that every four positions hold one: within a group, or two of a group and one of the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for a in range(POSITIONS):
        for b in range(a + 1, POSITIONS):
            for c in range(b + 1, POSITIONS):
                g = sorted((group[a], group[b], group[c]))
                if g[0] == g[2] or g in ([0, 0, 1], [1, 1, 2], [0, 2, 2]):
                    out.append((a, b, c))
    return out


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    run = min(shingle, len(words))
    starts, ends = starts[: len(words) - run + 1].tolist(), ends[run - 1 :].tolist()
    ones, one = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), STRETCH):
        h = np.array([one(joined[i:j], SEED) for i, j in zip(starts[k : k + STRETCH], ends[k : k + STRETCH])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``id, print`` (the fingerprint as a signed long) of every row; a null doc_id is ``NO_ID``."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            own = np.array([fingerprint(t, shingle) for t in raw(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(own)], ["id", "print"])

    rows = columns_of(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    return rows.mapInArrow(read, "id long, print long")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("print", 8 * position).bitwiseAND(0xFF)


def _postings(entries: DataFrame) -> DataFrame:
    """``key`` (which triple of positions, and the bytes there), ``print, id`` for every triple."""
    keys = []
    for n, (a, b, c) in enumerate(triples()):
        held = F.shiftleft(_byte(a), 16).bitwiseOR(F.shiftleft(_byte(b), 8)).bitwiseOR(_byte(c))
        keys.append(held.bitwiseOR(F.lit(n << 24)))
    return entries.select(F.explode(F.array(*keys)).alias("key"), "print", "id")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group of points that the pairs ``a, b`` link: every point but the group's least, and the least."""
    points, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(points))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(points))
    return points[rest], points[label[rest]]


def near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Count filter, then the bits: whether fingerprints share enough positional bytes and differ in few bits."""
    differ = x ^ y
    shared = (differ.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(1, dtype=np.uint8)
    out = shared >= POSITIONS - most
    out[out] = np.bitwise_count(differ[out]) <= most
    return out


def _links_of_run(own: np.ndarray, part: np.ndarray, two: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions of one list: all pairs, or (``two``) those of its first with its second part."""
    left, right = [], []
    inner = np.arange(len(own))
    firsts = inner[part == 0] if two else inner
    for i in firsts:
        other = inner[part == 1] if two else inner[i + 1 :]
        if len(other):
            hit = other[near(np.full(len(other), own[i]), own[other], most)]
            left.append(np.full(len(hit), i))
            right.append(hit)
        if len(left) >= 512:  # pairs on hand stay few: only their forest is kept
            left, right = ([z] for z in forest(np.concatenate(left), np.concatenate(right)))
    if not left:
        return inner[:0], inner[:0]
    return np.concatenate(left), np.concatenate(right)


def _list_links(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``a, b``: a spanning forest of the links of every list; rows come sorted by list."""
    held: list[list[np.ndarray]] = []

    def links(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, first, second, part, own, ids = cols
        new = (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        edge = np.flatnonzero(np.concatenate([[True], new, [True]]))
        size = np.diff(edge)
        found_a, found_b = [], []
        short = np.repeat(size <= 64, size)  # many short lists at once: rows that lie d apart, for every d
        number = np.repeat(np.arange(len(size)), size)
        for d in range(1, int(min(64, size.max()))):
            i = np.flatnonzero((number[d:] == number[:-d]) & short[d:])
            i = i[near(own[i], own[i + d], most)] if len(i) else i
            found_a.append(i)
            found_b.append(i + d)
        for k in np.flatnonzero(size > 64):
            at = slice(edge[k], edge[k + 1])
            a, b = _links_of_run(own[at], part[at], bool(first[edge[k]] != second[edge[k]]), most)
            found_a.append(a + edge[k])
            found_b.append(b + edge[k])
        if found_a and sum(map(len, found_a)):
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))  # lists never touch, so this is a forest of each
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    for batch in it:
        cols = [batch[c].to_numpy(zero_copy_only=False) for c in ("key", "first", "second", "part", "print", "id")]
        cols[4] = cols[4].view(np.uint64)
        if not len(cols[0]):
            continue
        same = held and all(held[-1][k][-1] == cols[k][-1] for k in range(3))
        if same:  # the whole batch belongs to the list at hand
            held.append(cols)
            continue
        cols = [np.concatenate([h[k] for h in held] + [c]) for k, c in enumerate(cols)] if held else cols
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield from links([c[:cut] for c in cols])
        held = [[c[cut:] for c in cols]]
    if held:
        yield from links([np.concatenate([h[k] for h in held]) for k in range(6)])


def links(entries: DataFrame, most: int = MOST_BITS, longest: int = LIST) -> DataFrame:
    """``a, b``: ids of entries (``id, print``, prints distinct) that link, as spanning forests of the lists."""
    postings = _postings(entries)
    long_lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    long_lists = stored(long_lists.withColumn("parts", F.expr(f"cast((n + {longest - 1}) div {longest} AS int)")), "simhash-lists")
    met = postings.join(long_lists, "key").withColumn("own", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    # a long list's part meets every part: (own, other) ordered, so that each pair of parts is one group
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = met.select("key", "print", "id", "own", other).select(
        "key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
        (F.col("own") > F.col("other")).cast("int").alias("part"), "print", "id",
    )
    lists = dealt.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "part", "print")
    return lists.mapInArrow(lambda it: _list_links(it, most), "a long, b long")


def linked_groups(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: 16 hex digits, and the smallest id reachable by links."""
    rows = stored(fingerprints(docs, shingle), "simhash-prints")
    entries = stored(rows.groupBy("print").agg(F.min("id").alias("id")), "simhash-entries")
    found = links(entries, most).distinct()
    same = rows.join(entries.withColumnRenamed("id", "rep"), "print").select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    repeated = rows.groupBy("id").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p <> q").select(F.col("id").alias("a"))
    bridges = same.join(repeated, "a", "left_semi").distinct()  # one id, several fingerprints
    groups = stored(components(entries.select("id").distinct(), found.union(bridges)), "simhash-groups")
    member = entries.join(groups, "id").select("print", "component")
    own = rows.join(member, "print")
    whole = repeated.join(own.withColumnRenamed("id", "a"), "a").groupBy("a").agg(F.min("component").alias("least"))
    out = own.join(whole, own["id"] == whole["a"], "left").select("id", "print", F.coalesce("least", "component").alias("component"))
    text = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return out.select(doc_id_of("id"), text, F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))
