"""Exact n-gram Jaccard join with set-relation skipping, and the groups of documents it links.

A document's set is its distinct runs of ``shingle`` words (A-Z lowered); two documents link when their sets' Jaccard
similarity is at least ``percent`` / 100 (op9: ``SHINGLE`` and ``PERCENT``).  Equal sets are one set first.  Each set lists a prefix of its shingles in a
global order; two sets that link share a shingle of their prefixes.

* Lists of sets by shingle are sorted by set size and skipped block by block: by size, and by position, where a
  block says how many shingles its sets can still share from there on.
* Rare shingles come first in the global order, so the lists stay short.  How frequent a shingle is says the count of its
  cell over all documents, of ``CELLS`` cells by hash.  (Any order gives the same links.)
* Highly similar sets are joined first, by ``LEADING`` min-hashes, which linked sets most likely share: each set of a
  min-hash's list is compared with the list's leader and with the nearest by folded map among the sets before it, which takes two
  comparisons a set.  Sets that link are in one group, and the full join only meets pairs whose groups differ.  A thousand sets
  that link with their nearest so cost some thousand comparisons; whatever links are missed here the full join finds.

* Pairs are first held against bit maps, the parity of each set's shingles at ``BITS`` places: sets differ in at least as
  many shingles as their maps in bits, so most pairs that do not link are put aside without their sets.  The lists
  hold the maps folded to 64 * ``FOLDS`` places, so that pairs of a list that cannot link never leave its task.

What is left is verified on whole sets.  Shingles are 64-bit hashes, equal sets are told by 128 bits.

Defined results: a text of fewer words is one shingle; null or empty texts have no set and link with nothing; rows that
repeat a doc_id are one node with all their links; a null doc_id is a node of its own, smaller than all.  Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import NO_ID, WordHashes, columns_of, components, doc_id_of, grams, mix, raw, row_key, sliced, small, stored

SHINGLE, PERCENT = 4, 85
CELL_BITS = 22
CELLS, PART = 1 << CELL_BITS, 1 << 14
LEADING = 3  # min-hashes whose lists have leaders
WINDOW = 4096  # sets of a list among which the nearest is sought
BLOCK = 512
BITS = 2048
FOLDS = 3


def shingles(text: bytes | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """The set of a text, sorted."""
    words = hashes(text)[0]
    return np.unique(grams(words, min(n, len(words)))) if len(words) else words


def least_shared(a, b, percent: int = PERCENT):
    """Fewest common shingles of linked sets of ``a`` and ``b`` shingles."""
    return -(-percent * (a + b) // (100 + percent))


def probe_prefix(n, percent: int = PERCENT):
    """Prefix that must meet the prefix of any linked set."""
    return n - -(-percent * n // 100) + 1


def index_prefix(n, percent: int = PERCENT):
    """Prefix that must meet the probe prefix of any linked set that is no smaller."""
    return n - least_shared(n, n, percent) + 1


def bit_map(own: np.ndarray) -> bytes:
    """Parity of the shingles at each of ``BITS`` places."""
    return np.packbits((np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes) -> np.ndarray:
    """The same map over 64 * ``FOLDS`` places: every ``FOLDS``-th word of it, taken together."""
    words = np.frombuffer(bits, np.int64)
    return np.stack([np.bitwise_xor.reduce(words[k::FOLDS]) for k in range(FOLDS)])


def may_link(n: np.ndarray, differ: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of ``n`` shingles together, d of them in one only, may link: they share (n - d) / 2, and d is at least ``differ``."""
    return n - differ >= 2 * least_shared(n, 0, percent)


def cells(own: np.ndarray) -> np.ndarray:
    """Cell of each shingle."""
    return (own >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, shingle: int) -> np.ndarray:
    """For each cell, how many sets of all documents its shingles are in, in eighths of a power of two.

    A task counts its documents into one array of fixed size; parts of it, compressed, are added up by part.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = WordHashes(lower=True), np.zeros(CELLS, np.uint32)
        for batch in sliced(it):
            own = np.concatenate([shingles(t, hashes, shingle) for t in raw(batch["text"])] or [np.zeros(0, np.uint64)])
            np.add.at(n, cells(own), np.uint32(1))
        parts = [k for k in range(CELLS // PART) if n[k * PART : (k + 1) * PART].any()]
        held = [zlib.compress(n[k * PART : (k + 1) * PART].tobytes(), 1) for k in parts]
        yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "n": pa.array(held, pa.binary())})

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for part, n in zip(batch["part"].to_pylist(), batch["n"].to_pylist()):
                own = np.frombuffer(zlib.decompress(n), np.uint32).astype(np.int64)
                sums[part] = sums[part] + own if part in sums else own
        levels = [(8 * np.log2(np.maximum(n, 1))).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "level": pa.array(levels, pa.binary())})

    out = np.zeros(CELLS, np.uint8)
    for row in docs.select("text").mapInArrow(count, "part int, n binary").repartition("part").mapInArrow(add, "part int, level binary").collect():
        out[row.part * PART : (row.part + 1) * PART] = np.frombuffer(row.level, np.uint8)
    return out


SALTS = mix(np.arange(1, LEADING + 1, dtype=np.uint64))


def min_hashes(own: np.ndarray) -> np.ndarray:
    """A set's least shingle in each of ``LEADING`` orders, marked with the order."""
    return np.array([mix(own ^ salt).min() ^ salt for salt in SALTS], np.uint64)


def describe_sets(docs: DataFrame, levels: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """``id, f1, f2, n, bits, folds, lead, prefix``: fingerprint, size, bit map, folded map, min-hashes and probe prefix of every document's set."""
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, level = WordHashes(lower=True), held.value
        for batch in sliced(it):
            f1, f2, n, bits, folds, lead, prefix = [], [], [], [], [], [], []
            for text in raw(batch["text"]):
                own = shingles(text, hashes, shingle)
                high, low = divmod(xxhash.xxh3_128_intdigest(own.tobytes()), 1 << 64)
                f1.append(high - (1 << 63))
                f2.append(low - (1 << 63))
                n.append(len(own))
                bits.append(bit_map(own))
                folds.append(folded(bits[-1]))
                lead.append(min_hashes(own).view(np.int64) if len(own) else own.view(np.int64))
                if len(own):
                    own = own[np.argsort(level[cells(own)], kind="stable")][: probe_prefix(len(own), percent)]
                prefix.append(own.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()),
                 pa.array(folds, pa.list_(pa.int64())), pa.array(lead, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                ["id", "f1", "f2", "n", "bits", "folds", "lead", "prefix"],
            )

    return docs.mapInArrow(read, "id long, f1 long, f2 long, n long, bits binary, folds array<long>, lead array<long>, prefix array<long>")


def runs_of(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of every list (rows of one token) that has two rows or more; rows come sorted by token."""
    rest: list[list[np.ndarray]] = []

    def lists(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        token = cols[0]
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, int)
        for i in np.flatnonzero(np.diff(edge) > 1):
            yield tuple(c[edge[i] : edge[i + 1]] for c in cols[1:])

    for batch in it:
        cols = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        if not len(cols[0]):
            continue
        if rest and rest[-1][0][-1] == cols[0][-1]:
            rest.append(cols)  # still the same list
            continue
        cols = [np.concatenate([r[k] for r in rest] + [c]) for k, c in enumerate(cols)] if rest else cols
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        yield from lists([c[:cut] for c in cols])
        rest = [[c[cut:] for c in cols]]
    if rest:
        yield from lists([np.concatenate([r[k] for r in rest]) for k in range(len(names))])


PAIRS = "a long, a1 long, b long, b1 long"


def pair_batches(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for cols in found:
        held.append(cols)
        size += len(cols[0])
        if size >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held])) for k in range(4)], ["a", "a1", "b", "b1"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held])) for k in range(4)], ["a", "a1", "b", "b1"])


def leader_pairs(it: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each set of a list with the list's leader, the smallest set that its size may link with it, and with the nearest before it."""

    def found() -> Iterator[tuple[np.ndarray, ...]]:
        for n, ids, f1, *folds in runs_of(it, ["token", "n", "id", "f1", *(f"fold{k}" for k in range(FOLDS))]):
            lead = np.zeros(len(n), np.int64)
            at = 0
            while True:  # one step for each leader; sizes grow by 100 / percent from one to the next
                nxt = int(np.searchsorted(percent * n, 100 * n[at], "right"))
                lead[at:nxt] = at
                if nxt >= len(n):
                    break
                at = nxt
            folds = [f.view(np.uint64) for f in folds]
            differ = sum(np.bitwise_count(f[lead] ^ f).astype(np.int64) for f in folds)
            other = np.flatnonzero((lead != np.arange(len(n))) & may_link(n[lead] + n, differ, percent))
            if len(other):
                yield ids[lead[other]], f1[lead[other]], ids[other], f1[other]
            for low in range(0, len(n), BLOCK) if len(n) > 2 else ():
                x = np.arange(low, min(low + BLOCK, len(n)))
                y = np.arange(max(0, low + BLOCK - WINDOW), x[-1] + 1)[:, None]
                differ = sum(np.bitwise_count(f[y] ^ f[x]).astype(np.int64) for f in folds)
                differ = np.where((y < x) & may_link(n[y] + n[x], differ, percent), differ, BITS)
                near = differ.argmin(0)
                found = (differ[near, np.arange(len(x))] < BITS) & (y[near, 0] != lead[x])
                x, near = x[found], y[near[found], 0]
                if len(x):
                    yield ids[near], f1[near], ids[x], f1[x]

    yield from pair_batches(found())


def skipping_pairs(it: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a list whose sizes, positions and folded maps allow a link and whose groups differ."""

    def found() -> Iterator[tuple[np.ndarray, ...]]:
        for n, ids, f1, pos, group, *folds in runs_of(it, ["token", "n", "id", "f1", "pos", "grp", *(f"fold{k}" for k in range(FOLDS))]):
            if (group == group[0]).all():
                continue
            left = n - pos  # shingles from here on, this one included
            first = np.searchsorted(100 * n, percent * n, "left")  # the smallest set that x may link with
            indexed = np.flatnonzero(pos < index_prefix(n, percent))
            for k in range(0, len(indexed), BLOCK):  # blocks of the index list, sorted by size
                block = indexed[k : k + BLOCK]
                most, low = int(left[block].max()), int(block[0])
                # sets x that come after the block's first and reach it by size; skipped where no set of the block has enough left
                stop = int(np.searchsorted(first, block[-1], "right"))
                x = np.arange(low + 1, stop)
                x = x[np.minimum(left[x], most) >= least_shared(n[x], n[block[0]], percent)]
                for part in np.array_split(x, max(1, len(x) // BLOCK)):
                    y = block[:, None]
                    ok = (y < part) & (y >= first[part]) & (group[y] != group[part])
                    ok &= np.minimum(left[y], left[part]) >= least_shared(n[y], n[part], percent)
                    i, j = np.nonzero(ok)
                    i, j = block[i], part[j]
                    may = may_link(n[i] + n[j], sum(np.bitwise_count((f[i] ^ f[j]).view(np.uint64)).astype(np.int64) for f in folds), percent)
                    i, j = i[may], j[may]
                    if len(i):
                        yield ids[i], f1[i], ids[j], f1[j]

    yield from pair_batches(found())


def by_bit_map(it: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that may link by their whole maps."""
    for batch in it:
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(len(batch), BITS // 64) for c in ("bits_a", "bits_b"))
        n = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
        may = may_link(n, np.bitwise_count(x ^ y).sum(1).astype(np.int64), percent)
        yield batch.select(["a", "a1", "b", "b1"]).filter(pa.array(may))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose whole sets link."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("f1").alias(f"{c}1"), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    held = pairs.distinct().join(side("a"), ["a", "a1"]).join(side("b"), ["b", "b1"]).select("a", "a1", "b", "b1", "n_a", "n_b", "bits_a", "bits_b")
    pairs = stored(held.mapInArrow(partial(by_bit_map, percent=percent), PAIRS).distinct(), "set-pairs")
    needed = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "set-ids")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(lower=True)
        for batch in sliced(it):
            sets = [shingles(t, hashes, shingle) for t in raw(batch["text"])]
            f1 = [(xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - (1 << 63) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(f1, pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "f1", "items"]
            )

    def link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            near = []
            x, y = batch["items_a"], batch["items_b"]
            for i in range(len(batch)):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                near.append(len(np.intersect1d(p, q, assume_unique=True)) >= least_shared(len(p), len(q), percent))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    sets = stored(docs.join(small(needed), "id").select("id", "text").mapInArrow(read, "id long, f1 long, items array<long>").dropDuplicates(["id", "f1"]), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("f1").alias("a1"), F.col("items").alias("items_a"))
    right = sets.select(F.col("id").alias("b"), F.col("f1").alias("b1"), F.col("items").alias("items_b"))
    both = pairs.join(left, ["a", "a1"]).join(right, ["b", "b1"]).select("a", "b", "items_a", "items_b")
    return both.mapInArrow(link, "a long, b long")


def linked_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``: size of each document's set and the smallest id of its group."""
    rows = columns_of(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    sets = stored(describe_sets(rows, frequency_levels(rows, shingle), shingle, percent), "set-prefixes")
    some = sets.where("n > 0")
    first = some.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    light = some.select("id", "f1", "f2", "n", "folds", F.col("lead").alias("prefix"))
    once = lambda df, *more: df.join(first, ["f1", "f2"]).where("id = rep").dropDuplicates(["f1", "f2"]).select("id", "f1", "n", "prefix", *more)
    maps = once(some.select("id", "f1", "f2", "n", F.col("bits").alias("prefix"))).withColumnRenamed("prefix", "bits")
    lists = lambda df, *order: df.repartition("token").sortWithinPartitions("token", *order)

    folds = [F.col("folds")[k].alias(f"fold{k}") for k in range(FOLDS)]
    leading = once(light, "folds").select(F.explode("prefix").alias("token"), "n", "id", "f1", *folds)
    near = stored(verified(lists(leading, "n", "id").mapInArrow(partial(leader_pairs, percent=percent), PAIRS), rows, maps, shingle, percent), "leader-links")
    group = components(once(light).select("id").distinct(), near)

    full = once(some, "folds").join(group.select("id", F.col("component").alias("grp")).distinct(), "id")
    entries = full.select(F.posexplode("prefix").alias("pos", "token"), "n", "id", "f1", "grp", *folds)
    far = verified(lists(entries, "n", "id").mapInArrow(partial(skipping_pairs, percent=percent), PAIRS), rows, maps, shingle, percent)

    same = some.join(first, ["f1", "f2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    twice = same.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).where("b <> c")  # one id, several sets
    bridges = same.join(twice.select("a"), "a", "left_semi")
    whole = components(first.select(F.col("rep").alias("id")).distinct(), near.union(far).union(bridges))
    member = same.join(whole, same["b"] == whole["id"]).groupBy("a").agg(F.min("component").alias("component"))
    out = sets.join(member, sets["id"] == member["a"], "left")
    return out.select(doc_id_of("id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component")).select(
        "doc_id", "n_shingles", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id")
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` but for copies: of each group of texts the row of the smallest doc_id (null first) stays.

    A row is told by its doc_id and its text, so rows that share a doc_id, or have none, go only if their own text is a
    copy.  Of rows that repeat both, one stays; texts without a word are no copies and all stay.
    """
    node = row_key(docs)
    mark = F.xxhash64(F.coalesce(docs["`text`"].cast("string"), F.lit("")))
    own = F.coalesce(docs["`doc_id`"].cast("long"), F.lit(NO_ID))
    nodes = docs.select(node.alias("doc_id"), docs["`text`"].cast("string").alias("text"))
    groups = stored(linked_groups(nodes, shingle, percent).where("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("grp"), F.count(F.lit(1)).alias("rows")), "copy-groups")
    several = groups.groupBy("grp").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).where("one <> other").select("grp")
    member = groups.join(several, "grp").join(docs.select(node.alias("doc_id"), own.alias("own"), mark.alias("mark")).distinct(), "doc_id")
    member = stored(member.select("grp", F.struct("own", "mark", "doc_id").alias("at")), "copy-members")
    first = member.groupBy("grp").agg(F.min("at").alias("first"))
    copies = stored(member.join(first, "grp").where("at <> first").select(F.col("at.doc_id").alias("__copy")).distinct(), "copies")
    left = docs.join(small(copies), node == F.col("__copy"), "left_anti")
    repeated = stored(groups.where("rows > 1").select(F.col("doc_id").alias("__repeated")), "repeated-rows")
    if repeated.isEmpty():
        return left
    once = left.join(small(repeated), node == F.col("__repeated"), "left_anti")
    again = left.join(small(repeated), node == F.col("__repeated")).dropDuplicates(["__repeated"])
    return once.union(again.select(*(docs[f"`{c}`"] for c in docs.columns)))
