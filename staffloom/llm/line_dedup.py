"""Line dedup by a segment-partition edit join.

Lines go when an earlier line (smaller doc_id, or the same document and an earlier line) is equal or near.  :class:`Limits`
says from which length equal lines go, and how many edits of characters, or of words, are near; the edits grow by steps with
the length of the shorter line.  ``WIDE`` is what the query and the pipeline use: equal lines of any length (but blank ones), 1
character from 20 characters, 2 from 40, 1 word from 8 words, 2 from 24.  ``NARROW`` has lines of 40 characters and 2 edits only.

Equal lines are reduced to their first by hash first.  Lines are cut by classes of lengths.  A class of e edits whose least length is m has
e + 1 parts of about m / (e + 1) characters, the first ones counted from the line's beginning, the others from its end.  Of a line that is within e
edits of another, some part i is unchanged with i edits before it and at most e - i after it: it stands in the other line at most min(i, e - i)
places from its own.  So a line has a key for each part (its index) and for each such shift (its probes); with up to 2 edits shifts to the
right are enough, as the middle part of one of the two lines is shifted so.  A line that is up to e longer than some of the class below
also has that class's keys.  This is done for characters and for words: 4 keys for 2 edits, 2 for one, and a quarter more for neighbouring classes.
Candidates are verified by a bit-parallel edit distance in a band of 2 * e + 1 diagonals.

Index and probes meet on 64-bit keys that carry places only; texts are fetched for lines that share a key alone.  Of
those a sketch is made, the parity of their pairs of characters by hash: an edit changes at most four pairs, so lines
whose sketches differ in more than 4 places an edit are never paired.  A second sketch has the parity of the words, of which an
edited word changes at most two.  Many lines that share a long segment but
differ elsewhere thus give no pairs, and no near pair is lost.  A line needs one near earlier line to go, so it is verified
against the nearest by sketch first, and against all others only if that fails.

Judged on the input.  Defined results: lines shorter than the limits, and blank lines, always stay; null or empty texts stay as they are; rows that repeat
a doc_id with one text count as one document and are cut alike, with different texts they are ordered by a
checksum; a null doc_id comes first.  :func:`dedup` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import NO_ID, WORD, keyed, mix, raw, sliced, small, stored

Steps = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Limits:
    """``shortest``: characters from which equal lines go; ``chars`` and ``words``: (least length, edits) in rising order."""

    shortest: int
    chars: Steps
    words: Steps


#: Lengths of a class of lines that are cut alike, for each edit.
WIDTH = 4
#: Bytes of lines whose keys are made at once.
CHUNK = 1 << 18
NARROW = Limits(40, ((40, 2),), ())
WIDE = Limits(1, ((20, 1), (40, 2)), ((8, 1), (24, 2)))
AT = ["id", "mark", "line_no"]


def allowed(n: int, steps: Steps) -> int:
    """Edits between two lines of which the shorter has length ``n``."""
    return max((edits for least, edits in steps if n >= least), default=0)


def steps_of(m: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """For lines of length ``m``: edits, and the least length of their class (0 and 0 where there are no edits)."""
    at = np.searchsorted([least for least, _ in steps], m, "right")
    least, edits = (np.array([0, *column]) for column in (zip(*steps) if steps else ((), ())))
    width = np.maximum(WIDTH * edits, 1)[at]
    return edits[at], np.where(at > 0, least[at] + (m - least[at]) // width * width, 0)


def parts(n: np.ndarray, steps: Steps) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Parts of lines of length ``n`` that are keys: numbers of the lines, a mark of (class, which), start, size, and whether it is a part's own place."""
    was = None
    for shorter in range(max((e for _, e in steps), default=-1) + 1):
        edits, low = steps_of(n - shorter, steps)
        of = np.flatnonzero((edits > 0) & (edits >= shorter) & (True if was is None else low != was))
        was = low
        for e in np.unique(edits[of]):
            own = of[edits[of] == e]
            size = np.maximum(low[own] - (e == 2), 0) // (e + 1)
            for i in range(e + 1):
                reach = min(i, e - i)
                for shift in range(0 if e <= 2 else -reach, reach + 1):
                    start = (i * size if i <= e - i else n[own] - (e + 1 - i) * size) + shift
                    fits = (start >= 0) & (start + size <= n[own])
                    yield own[fits], (low[own] * 64 + i)[fits], start[fits], size[fits], shift == 0


BASE = 0x9E3779B97F4A7C15
FIRST_LINE = "id long, mark int, line_no int, h long, c long, n int, index array<long>, probe array<long>"


class LineKeys:
    """Keys of many lines at once, out of one running sum of their characters' values times the powers of ``BASE``."""

    def __init__(self, limits: Limits):
        self.limits, self.powers, self.inverse = limits, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __call__(self, lines: list[bytes]) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
        """Characters of each line, its index keys and its probe keys."""
        text = b"\n".join(lines).decode("utf-8", "surrogateescape")
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) >= len(self.powers):
            size = max(len(codes) + 1, CHUNK + 1)
            self.powers, self.inverse = (np.full(size, base, np.uint64) for base in (BASE, pow(BASE, -1, 1 << 64)))
            for powers in (self.powers, self.inverse):
                powers[0] = 1
                np.multiply.accumulate(powers, out=powers)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * self.powers[: len(codes)], out=total[1:])
        ends = np.append(np.flatnonzero(codes == 10), len(codes))
        begins = np.append(0, ends[:-1] + 1)
        gaps = np.flatnonzero(codes == 32)
        first, stop = np.searchsorted(gaps, begins), np.searchsorted(gaps, ends)
        gaps = np.append(gaps, 0)
        found: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}

        def add(own: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int, indexed: bool) -> None:
            h = (total[end] - total[start]) * self.inverse[start]
            found[indexed].append((own, mix(h ^ mix(mark.astype(np.uint64) << np.uint64(1) | np.uint64(salt))).view(np.int64)))

        for own, mark, start, size, indexed in parts(ends - begins, self.limits.chars):
            add(own, mark, begins[own] + start, begins[own] + start + size, 0, indexed)
        words = stop - first + 1
        for own, mark, start, size, indexed in parts(words, self.limits.words):
            a = np.where(start > 0, gaps[np.maximum(first[own] + start - 1, 0)] + 1, begins[own])
            b = np.where(start + size < words[own], gaps[np.minimum(first[own] + start + size - 1, len(gaps) - 1)], ends[own])
            add(own, mark, a, np.maximum(a, b), 1, indexed)
        return ends - begins, self.lists(found[True], len(lines)), self.lists(found[False], len(lines))

    @staticmethod
    def lists(keys: list[tuple[np.ndarray, np.ndarray]], size: int) -> pa.ListArray:
        """The keys as one list a line."""
        of = np.concatenate([np.zeros(0, np.int64), *(k[0] for k in keys)])
        held = np.concatenate([np.zeros(0, np.int64), *(k[1] for k in keys)])[np.argsort(of, kind="stable")]
        offsets = np.append(0, np.cumsum(np.bincount(of, minlength=size)))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(held))


def cut_lines(batch: pa.RecordBatch, limits: Limits) -> Iterator[tuple[list, list, list, list[bytes]]]:
    """``id, mark, line_no, line`` of the lines that are not blank and may be long enough, ``CHUNK`` bytes or one line at a time."""
    cols: tuple[list, list, list, list[bytes]] = ([], [], [], [])
    held = 0
    for id_, mark, text in zip(batch["id"].to_pylist(), batch["mark"].to_pylist(), raw(batch["text"])):
        for no, line in enumerate(text.split(b"\n")):
            if len(line) < limits.shortest or not line or line.isspace():
                continue
            if held and held + len(line) >= CHUNK:
                yield cols
                cols, held = ([], [], [], []), 0
            held += len(line) + 1
            for col, value in zip(cols, (id_, mark, no, line)):
                col.append(value)
    if held:
        yield cols


def key_lines(it: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Place, hashes, length, ``index`` and ``probe`` keys of the lines that are long enough and not blank."""
    keys = LineKeys(limits)
    for batch in sliced(it):
        for id_, mark, no, lines in cut_lines(batch, limits):
            n, index, probe = keys(lines)
            h = np.array([xxhash.xxh64_intdigest(line) for line in lines], np.uint64).view(np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array(id_, pa.int64()), pa.array(mark, pa.int32()), pa.array(no, pa.int32()), pa.array(h),
                 pa.array(map(zlib.crc32, lines), pa.int64()), pa.array(n, pa.int32()), index, probe],
                [*AT, "h", "c", "n", "index", "probe"],
            )
            yield out.filter(pa.array(n >= limits.shortest))


def lines_of(rows: DataFrame, limits: Limits) -> DataFrame:
    """``id, mark, line_no`` of the lines that are long enough and not blank."""
    lines = rows.select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where((F.length("line") >= limits.shortest) & F.col("line").rlike(WORD)).select(*AT)


def first_lines(rows: DataFrame, limits: Limits) -> DataFrame:
    """First place of every different line, with its ``index`` and ``probe`` keys."""
    found = rows.select("id", "mark", "text").mapInArrow(partial(key_lines, limits=limits), FIRST_LINE)
    least = F.min(F.struct(*AT)).alias("at")
    firsts = found.groupBy("h", "c", "n").agg(least, F.first("index").alias("index"), F.first("probe").alias("probe"))
    return firsts.select("at.*", "index", "probe")


ENTRY = "key long, id long, mark int, line_no int, indexed boolean"


def whole_lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by key, in tables that hold all rows of their keys."""
    rest: list[pa.RecordBatch] = []
    for batch in it:
        if not len(batch):
            continue
        last = batch["key"][-1]
        if rest and rest[0]["key"][0] == last:
            rest.append(batch)  # one key all along
            continue
        table = pa.Table.from_batches([*rest, batch])
        cut = int(np.searchsorted(table["key"].to_numpy(), last.as_py()))
        yield table.slice(0, cut)
        rest = table.slice(cut).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and line, those whose key has different lines."""
    for table in whole_lists(it):
        key = table["key"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        places = [table[c].to_numpy() for c in AT]
        several = np.any([place[edge[:-1]] != place[edge[1:] - 1] for place in places], axis=0) if len(key) else np.zeros(0, bool)
        yield from table.filter(pa.array(np.repeat(several, np.diff(edge)))).to_batches()


def entries(firsts: DataFrame) -> DataFrame:
    """Index and probe entries of all lines whose key another line has too."""
    entry = lambda name: F.transform(name, lambda k: F.struct(k.alias("key"), F.lit(name == "index").alias("indexed")))
    rows = firsts.select(*AT, F.explode(F.concat(entry("index"), entry("probe"))).alias("e"))
    rows = rows.select("e.key", *AT, "e.indexed").repartition("key").sortWithinPartitions("key", *AT)
    return rows.mapInArrow(shared, ENTRY)


SKETCH = 256


def sketch(text: str) -> bytes:
    """Parity of the text's pairs of characters, each at a place by hash."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    pairs = mix(codes[:-1] << np.uint64(32) | codes[1:]) % np.uint64(SKETCH)
    return np.packbits((np.bincount(pairs.astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def word_sketch(words: list[str]) -> int:
    """Parity of the words, each at one of 64 places by hash."""
    bits = 0
    for word in words:
        bits ^= 1 << (zlib.crc32(word.encode()) & 63)
    return bits - (bits >> 63 << 64)


def add_sketches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = batch["text"].to_pylist()
        bits = [np.frombuffer(sketch(t), "<i8").tolist() for t in texts]
        words = [t.split(" ") for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch["at"], batch["text"], pa.array(bits, pa.list_(pa.int64())), pa.array(map(word_sketch, words), pa.int64()),
             pa.array(map(len, texts), pa.int32()), pa.array(map(len, words), pa.int32())],
            ["at", "text", "bits", "wbits", "n", "nw"],
        )


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: a bit for each diagonal of the band says where the distance steps.

    Ends that agree are taken off first.  ``rows`` keeps, as in Myers' method, the vertical differences (+1, -1) of the
    band's cells; the band moves down one row with every column.
    """
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    a, b = a[lo:hi_a], b[lo:hi_b]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > edits:
        return False
    if n == 0:
        return m <= edits
    width = 2 * edits + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    # bit k at column j (from 1) is row j - edits + k; plus and minus hold the column before
    plus, minus = full & (full << edits), 0
    score = edits  # distance at the lowest cell of the band, kept while the band moves down
    for j in range(1, n + 1):
        shift = j - edits - 1
        match = places.get(b[j - 1], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        d0 = ((((match & plus) + plus) ^ plus) | match | minus) & full
        up = minus | (full & ~(d0 | plus))
        down = d0 & plus
        if not d0 >> (width - 1) & 1:
            score += 1
        moved = d0 >> 1
        plus = (down | (full & ~(moved | up))) & full
        minus = moved & up
    for k in range(n + edits - m):  # from row n + edits of the last column up to row m
        bit = width - 2 - k
        score -= (plus >> bit & 1) - (minus >> bit & 1)
    return score <= edits


def near(a: str, b: str, limits: Limits) -> bool:
    edits = allowed(min(len(a), len(b)), limits.chars)
    if edits and within(a, b, edits):
        return True
    x, y = a.split(" "), b.split(" ")
    edits = allowed(min(len(x), len(y)), limits.words)
    return edits > 0 and within(x, y, edits)


SHORT_LIST, LATE, EARLY = 16, 256, 4096
BITS = [f"b{k}" for k in range(SKETCH // 64)]
FAR = 1 << 14
PAIR = "key long, early struct<id:long,mark:int,line_no:int>, late struct<id:long,mark:int,line_no:int>, more boolean"


def list_pairs(it: Iterator[pa.RecordBatch], limits: Limits, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a key whose lengths and sketches allow a few edits: of each late line that is open, all, or the ``nearest`` one by sketch.

    Rows come sorted by key and line.  ``more`` says that the late line has other pairs under the key.
    """
    for table in whole_lists(it):
        size = len(table)
        if size < 2:
            continue
        key, indexed, is_open = (table[c].to_numpy() for c in ("key", "indexed", "open"))
        at = [table[c].to_numpy() for c in AT]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        line = np.cumsum(new | np.concatenate([[True], np.any([p[1:] != p[:-1] for p in at], axis=0)]))
        bits, words = [table[c].to_numpy().view(np.uint64) for c in BITS], table["bw"].to_numpy().view(np.uint64)
        n, nw = (table[c].to_numpy().astype(np.int32) for c in ("n", "nw"))
        most = [np.select([m >= least for least, _ in reversed(steps)], [e for _, e in reversed(steps)], -1).astype(np.int32) if steps else np.full(size, -1, np.int32)
                for m, steps in ((n, limits.chars), (nw, limits.words))]

        def differ(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """How far the sketches of early ``i`` and late ``j`` are apart; ``FAR`` where they are no pair."""
            by_chars = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int32) for b in bits)
            by_words = np.bitwise_count(words[i] ^ words[j]).astype(np.int32)
            chars, more = (np.minimum(m[i], m[j]) for m in most)
            may = ((by_chars <= 4 * chars) & (abs(n[i] - n[j]) <= chars)) | (by_words <= 2 * more - abs(nw[i] - nw[j]))
            may &= (line[i] < line[j]) & (indexed[i] | indexed[j]) & is_open[j]
            return np.where(may, np.minimum(by_chars, 4 * by_words), FAR)

        def batch(i: np.ndarray, j: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
            place = lambda k: pa.StructArray.from_arrays([pa.array(p[k]) for p in at], AT)
            return pa.RecordBatch.from_arrays([pa.array(key[j]), place(i), place(j), pa.array(more)], ["key", "early", "late", "more"])

        start = np.flatnonzero(new)
        length = np.diff(np.append(start, size))
        short = np.repeat(length <= SHORT_LIST, length)
        best, of, count = np.full(size, FAR, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for step in range(1, SHORT_LIST):  # short lists of all keys at once
            j = step + np.flatnonzero(short[step:] & (key[step:] == key[:-step]))
            if not len(j):
                break
            far = differ(j - step, j)
            j, far = j[far < FAR], far[far < FAR]
            if not nearest and len(j):
                yield batch(j - step, j, np.zeros(len(j), bool))
            count[j] += 1
            closer = far < best[j]
            best[j[closer]], of[j[closer]] = far[closer], j[closer] - step
        for first, stop in zip(start[length > SHORT_LIST], (start + length)[length > SHORT_LIST]):
            for low in range(first, stop, LATE):
                late = np.arange(low, min(low + LATE, stop))
                for begin in range(first, late[-1], EARLY):
                    early = np.arange(begin, min(begin + EARLY, late[-1]))
                    far = differ(early[:, None], late[None, :])
                    if not nearest:
                        i, j = np.nonzero(far < FAR)
                        if len(i):
                            yield batch(early[i], late[j], np.zeros(len(i), bool))
                        continue
                    count[late] += (far < FAR).sum(0)
                    least = far.argmin(0)
                    closer = far[least, np.arange(len(late))] < best[late]
                    best[late[closer]], of[late[closer]] = far[least, np.arange(len(late))][closer], early[least[closer]]
        j = np.flatnonzero(count)
        if nearest and len(j):
            yield batch(of[j], j, count[j] > 1)


def near_lines(rows: DataFrame, firsts: DataFrame, limits: Limits) -> DataFrame:
    """Places of first lines that have a near earlier line.

    Every line is first held against the nearest line of each of its keys, which settles most; only lines that are still open
    then meet all others of their keys, so a thousand near copies of one line do not all meet each other.
    """
    found = stored(entries(firsts), "line-entries")
    places = stored(found.groupBy("id", "mark").agg(F.collect_set("line_no").alias("nos")), "line-places")
    texts = rows.join(small(places), ["id", "mark"]).dropDuplicates(["id", "mark"]).select(
        "id", "mark", F.explode("nos").alias("line_no"), F.split("text", "\n", -1).alias("lines")
    ).select(F.struct(*AT).alias("at"), F.get("lines", "line_no").alias("text"))
    texts = stored(texts.mapInArrow(add_sketches, "at struct<id:long,mark:int,line_no:int>, text string, bits array<long>, wbits long, n int, nw int"), "line-texts")
    known = found.select("key", "indexed", F.struct(*AT).alias("at")).join(texts.drop("text"), "at")
    known = known.select("key", "at.*", "indexed", *(F.col("bits")[k].alias(b) for k, b in enumerate(BITS)), F.col("wbits").alias("bw"), "n", "nw")
    lists = lambda df: df.repartition("key").sortWithinPartitions("key", *AT)
    a = texts.select(F.col("at").alias("early"), F.col("text").alias("text_a"))
    b = texts.select(F.col("at").alias("late"), F.col("text").alias("text_b"))

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [near(a, b, limits) for a, b in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist())]
            yield batch.select(AT).filter(pa.array(found, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.select("early", "late").distinct().join(a, "early").join(b, "late").select("late.*", "text_a", "text_b")
        return both.mapInArrow(verify, "id long, mark int, line_no int").distinct()

    pairs = lambda df, nearest: lists(df).mapInArrow(partial(list_pairs, limits=limits, nearest=nearest), PAIR)
    closest = stored(pairs(known.withColumn("open", F.lit(True)), True), "nearest-lines")
    settled = stored(verified(closest), "settled-lines")
    left = stored(closest.where("more").select("key", "late.*").join(settled, AT, "left_anti"), "open-lines")
    others = known.join(left.select("key").distinct(), "key", "left_semi").join(left.select(*AT, F.lit(True).alias("open")).distinct(), AT, "left")
    return settled.union(verified(pairs(others.withColumn("open", F.coalesce("open", F.lit(False))), False)))


def removed_lines(docs: DataFrame, limits: Limits = NARROW) -> DataFrame:
    """``id, mark, gone``: numbers of the lines that go, by document that loses some."""
    rows = keyed(docs)
    firsts = stored(first_lines(rows, limits), "line-firsts")
    kept = firsts.select(*AT).join(stored(near_lines(rows, firsts, limits), "near-lines"), AT, "left_anti")
    return lines_of(rows, limits).select(*AT).join(kept, AT, "left_anti").groupBy("id", "mark").agg(F.collect_set("line_no").alias("gone"))


def dedup(docs: DataFrame, limits: Limits = NARROW) -> DataFrame:
    """``docs`` with ``text`` replaced by its lines that stay, and ``n_lines`` and ``n_removed`` (own columns of these names go)."""
    gone = stored(removed_lines(docs, limits), "gone-lines").select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("gone").alias("__gone"))
    text = docs["`text`"].cast("string")
    doc_id = F.coalesce(docs["`doc_id`"].cast("long"), F.lit(NO_ID))
    mark = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(0x7FFFFFFF).cast("int")
    lines, numbers = F.split(text, "\n", -1), F.col("__gone")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(numbers, i)), "\n")
    joined = docs.join(small(gone), (doc_id == F.col("__id")) & (mark == F.col("__mark")), "left")
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *(F.when(numbers.isNull(), text).otherwise(left).alias(c) if c == "text" else docs[f"`{c}`"] for c in own),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(numbers.isNull(), 0).otherwise(F.size(numbers)).cast("long").alias("n_removed"),
    )
