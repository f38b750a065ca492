"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words.  Its minimiser is the smallest hash among its runs of ``seed`` words;
consecutive windows that share a minimiser are one super-k-mer and travel as one packed string to the bucket of
that minimiser, where the rows are sorted by (doc_id, start) and windows are told apart by their words: a window
met before in its bucket starts earlier elsewhere.

* Only minimisers that occur twice can hold a repeated window.  They are counted by Spark, then marked in a bit
  map of fixed size; a wrong mark costs traffic, never a result.
* Equal packed strings are reduced to their first occurrence before anything is sorted (with partial aggregates),
  so a passage copied a million times is one row in its bucket; the other copies are repeats as a whole.
* A minimiser with more than ``HOT`` occurrences sends its windows singly, each to the bucket of its own words, so no
  bucket's memory grows with the corpus.

Words are judged on the input: a word goes when some window over it also starts earlier.  Defined results: null or
empty texts have no words and stay empty; texts shorter than a window keep all; rows that repeat a doc_id with one
text count as one document and each keep what it keeps, with different texts they are ordered by a checksum of the
text; a null doc_id sorts first.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import WordHashes, doc_id_of, grams, keyed, raw, sliced, small, stored

WIDTH, SEED = 20, 6
MAP_BITS = 27
HOT = 20_000
LONGEST = 48  # windows in one packed string; a longer run is cut, its bucket stays the same


def runs(hashes: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of every super-k-mer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = grams(hashes, seed)
    span, step = width - seed + 1, 1
    while 2 * step <= span:  # minima over doubling spans, then over the rest
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[span - step : span - step + n])
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(new, n))
    parts = -(-size // LONGEST)
    first = np.repeat(new, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return least[first].astype(np.int64), first, np.diff(np.append(first, n))


def minimisers(words: np.ndarray) -> np.ndarray:
    """Minimiser of every super-k-mer; twice where it stands twice in the text, as one run may repeat itself."""
    mini = runs(words, WIDTH, SEED)[0]
    if not len(mini):
        return mini
    seeds = np.sort(grams(words, SEED).astype(np.int64))
    twice = seeds[1:][seeds[1:] == seeds[:-1]]
    return np.concatenate([mini, mini[np.isin(mini, twice)]]) if len(twice) else mini


def count_minimisers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in sliced(it, 4000):
        found = [minimisers(hashes(t)[0]) for t in raw(batch["text"])]
        mini, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_pydict({"mini": mini, "n": n.astype(np.int64)})


def slot(mini: np.ndarray) -> np.ndarray:
    return (mini & ((1 << MAP_BITS) - 1)).astype(np.int64)


def marked(counts: DataFrame) -> np.ndarray:
    """Two bit maps of fixed size, of places with repeated and with hot minimisers."""
    place = F.col("mini").bitwiseAND((1 << MAP_BITS) - 1)
    bit = F.expr("shiftleft(1, cast(place & 31 as int))")
    words = (
        counts.select(place.alias("place"), (F.col("n") > HOT).alias("hot")).withColumn("word", F.shiftright("place", 5).cast("int"))
        .groupBy("word").agg(F.bit_or(bit).alias("seen"), F.bit_or(F.when(F.col("hot"), bit).otherwise(0)).alias("hot"))
        .toArrow()
    )
    maps = np.zeros((2, 1 << (MAP_BITS - 5)), np.uint32)
    at = words["word"].to_numpy()
    maps[0, at], maps[1, at] = (words[c].to_numpy().view(np.uint32) for c in ("seen", "hot"))
    return maps


def super_kmers(rows: DataFrame) -> DataFrame:
    """``bucket, packed, id, mark, start, n`` of every super-k-mer whose minimiser may occur twice."""
    counts = (
        rows.select("text").mapInArrow(count_minimisers, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n")).where("n > 1")
    )
    maps = rows.sparkSession.sparkContext.broadcast(marked(counts))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        seen, hot = maps.value
        held = lambda bits, at: (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1
        for batch in sliced(it):
            out: list[list] = [[], [], [], [], [], []]
            for id_, mark, text in zip(batch["id"].to_pylist(), batch["mark"].to_pylist(), raw(batch["text"])):
                words, begins, ends = hashes(text)
                mini, first, size = runs(words, WIDTH, SEED)
                at = slot(mini)
                for i in np.flatnonzero(held(seen, at)):
                    if held(hot, at[i : i + 1])[0]:
                        own = grams(words[first[i] : first[i] + size[i] + WIDTH - 1], WIDTH).astype(np.int64)
                        spans = [(int(b), int(first[i]) + k, 1) for k, b in enumerate(own)]
                    else:
                        spans = [(int(mini[i]), int(first[i]), int(size[i]))]
                    for bucket, start, n in spans:
                        packed = b" ".join(text[begins[start] : ends[start + n + WIDTH - 2]].split())
                        for column, value in zip(out, (bucket, packed, id_, mark, start, n)):
                            column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["bucket", "packed", "id", "mark", "start", "n"])

    return rows.mapInArrow(cut, "bucket long, packed binary, id long, mark int, start int, n int")


def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted buckets: the windows of each string that were met before, as [first, end) pairs."""
    bucket, seen = None, set()
    for batch in it:
        repeats = []
        for own, packed, start, n in zip(batch["bucket"].to_pylist(), batch["packed"].to_pylist(), batch["start"].to_pylist(), batch["n"].to_pylist()):
            if own != bucket:
                bucket, seen = own, set()
            words, spans = packed.split(b" "), []
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            for k in range(n):
                window = packed[ends[k] - len(words[k]) - 1 : ends[k + WIDTH - 1] - 1]
                if window not in seen:
                    seen.add(window)
                elif spans and spans[-1] == start + k:
                    spans[-1] += 1
                else:
                    spans += [start + k, start + k + 1]
            repeats.append(spans)
        yield pa.RecordBatch.from_arrays([batch["id"], batch["mark"], batch["start"], pa.array(repeats, pa.list_(pa.int32()))], ["id", "mark", "start", "spans"])


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``id, mark, spans``: by document the [first, end) pairs of windows that start earlier elsewhere."""
    found = stored(super_kmers(rows), "super-kmers")
    firsts = found.groupBy("bucket", "packed").agg(F.min(F.struct("id", "mark", "start")).alias("at"), F.first("n").alias("n"))
    sorted_ = (
        firsts.select("bucket", "packed", "at.*", "n").repartition("bucket").sortWithinPartitions("bucket", "id", "mark", "start")
    )
    judged = sorted_.mapInArrow(judge, "id long, mark int, start int, spans array<int>")
    every = found.select("id", "mark", "start", "n").distinct()
    whole = F.array("start", F.expr("start + n"))
    return (
        every.join(judged, ["id", "mark", "start"], "left")
        .select("id", "mark", F.coalesce("spans", whole).alias("spans")).where(F.size("spans") > 0)
        .groupBy("id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def removed_words(n: int, spans: list[int], width: int = WIDTH) -> np.ndarray:
    """Which of ``n`` words are covered by the windows of the [first, end) pairs."""
    step = np.zeros(n + 1, np.int64)
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1] + width - 1, -1)
    return np.cumsum(step[:n]) > 0


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (words that stay, joined by one space) of every row of ``docs``."""
    rows = keyed(docs)
    repeats = stored(repeated_windows(rows), "repeats")

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            n, gone, kept = [], [], []
            for text, spans in zip(raw(batch["text"]), batch["spans"].to_pylist()):
                words = text.split()
                n.append(len(words))
                if spans:
                    out = removed_words(len(words), spans)
                    words = [w for w, x in zip(words, out.tolist()) if not x]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

    joined = rows.join(small(repeats), ["id", "mark"], "left").select("id", "text", "spans")
    return joined.mapInArrow(keep, "id long, n_words long, n_removed long, kept string").select(
        doc_id_of("id"), "n_words", "n_removed", "kept"
    )
