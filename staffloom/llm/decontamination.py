"""Benchmark decontamination: shared runs of words find passages, Smith-Waterman alignment scores them.

Words are cut at white space and marks, with A-Z lowered.  One pass over the documents finds every run of ``SEED``
words that also stands in a test item and keeps the passages around those runs.  Every passage and item that share a
run are a pair, however common the run is, so no copy of an item can hide another.  A pair of which fewer item words stand
in the passage than a score of ``threshold`` needs is put aside by that count alone, which loses none; the others are
aligned word by word (match 2, other word -1, gap -1).  A copy of which no ``SEED`` words in a row are left is not found.  The
score is the best local alignment's over the score of the whole item.  A pair with at least ``threshold`` counts.

Test items are a small table beside the corpus: their runs are sent to every task while there are at most
``BROADCAST_GRAMS`` of them, beyond that the documents' runs are joined with them by shuffle.

Defined results: null or empty texts and items, and items of fewer than ``SEED`` words, match nothing; rows that repeat
a doc_id give their best alignment; a null doc_id or item_id stays null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import WordHashes, columns_of, grams, raw, row_key, sliced, stored

SEED = 4
MATCH, OTHER, GAP = 2, -1, -1
THRESHOLD = 0.5
BROADCAST_GRAMS = 2_000_000
MARKS = b".,;:!?\"'()[]{}<>|*#$%&"
PASSAGE = "doc_id long, first int, words array<long>, at array<int>, runs array<long>"


def hasher() -> WordHashes:
    return WordHashes(lower=True, also=MARKS)


def read_items(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = hasher()
    for batch in it:
        words = [hashes(t)[0] for t in raw(batch["text"])]
        yield pa.RecordBatch.from_arrays(
            [batch["item_id"], pa.array([w.astype(np.int64) for w in words], pa.list_(pa.int64())),
             pa.array([grams(w, SEED).astype(np.int64) for w in words], pa.list_(pa.int64()))],
            ["item_id", "item_words", "runs"],
        )


def cut_passages(words: np.ndarray, at: np.ndarray, runs: np.ndarray, reach: int) -> Iterator[tuple]:
    """Passages of ``words`` that hold the runs at ``at`` and ``reach`` words around them; far runs part them."""
    for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1):
        if len(group):
            lo, hi = max(0, int(at[group[0]]) - reach), int(at[group[-1]]) + SEED + reach
            yield lo, words[lo:hi].astype(np.int64), (at[group] - lo).astype(np.int32), runs[group]


def passages(docs: DataFrame, known: DataFrame, reach: int) -> DataFrame:
    """Passages of ``docs`` around runs of words that are in ``known`` (``run``)."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "first", "words", "at", "runs"])

    if known.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        table = known.sparkSession.sparkContext.broadcast(np.sort(known.toArrow()["run"].to_numpy()))

        def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, held = hasher(), table.value
            for batch in sliced(it):
                rows = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), raw(batch["text"])):
                    words = hashes(text)[0]
                    runs = grams(words, SEED).astype(np.int64)
                    if len(held) and len(runs):
                        place = np.searchsorted(held, runs)
                        at = np.flatnonzero(held[np.minimum(place, len(held) - 1)] == runs)
                        rows += [(doc_id, *p) for p in cut_passages(words, at, runs[at], reach)]
                yield batch_of(rows)

        return docs.mapInArrow(find, PASSAGE)

    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text"))

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hasher()
        for batch in sliced(it):
            runs = [grams(hashes(t)[0], SEED).astype(np.int64) for t in raw(batch["text"])]
            size = np.fromiter(map(len, runs), np.int64, len(runs))
            at = np.concatenate([np.arange(n) for n in size] or [np.zeros(0)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {"row": np.repeat(batch["row"].to_numpy(), size), "at": at, "run": np.concatenate(runs or [np.zeros(0, np.int64)])}
            )

    hits = (
        keyed.select("row", "text").mapInArrow(spread, "row long, at int, run long").join(known, "run").distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "run"))).alias("hits"))
    )

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hasher()
        for batch in it:
            rows = []
            for doc_id, text, found in zip(batch["doc_id"].to_pylist(), raw(batch["text"]), batch["hits"].to_pylist()):
                at, runs = (np.asarray([h[c] for h in found], np.int64) for c in ("at", "run"))
                rows += [(doc_id, *p) for p in cut_passages(hashes(text)[0], at, runs, reach)]
            yield batch_of(rows)

    return keyed.join(hits, "row").select("doc_id", "text", "hits").mapInArrow(cut, PASSAGE)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of ``a`` against ``b``: score, and end in each.  One row of ``a`` at a time, gaps along
    ``b`` by a running maximum."""
    best, end_a, end_b = 0, 0, 0
    slope = -GAP * np.arange(len(b) + 1)
    above = np.zeros(len(b) + 1, np.int64)
    for i, word in enumerate(a, 1):
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(b == word, MATCH, OTHER))
        row = np.maximum.accumulate(row + slope) - slope
        j = int(row.argmax())
        if row[j] > best:
            best, end_a, end_b = int(row[j]), i, j
        above = row
    return best, end_a, end_b


def align(it: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Score and span in the document of the pairs of passage and item that are aligned at ``threshold`` or more."""
    for batch in it:
        near, scores, firsts, ends = [], [], [], []
        columns = (batch[c] for c in ("first", "words", "item_words", "spots"))
        for k, (lo, words, item, spots) in enumerate(zip(*columns)):
            lo, words, item, spots = lo.as_py(), words.values.to_numpy(), item.values.to_numpy(), spots.values.to_numpy()
            # only the part of the passage that the shared runs can reach
            reach = 2 * len(item)
            begin, stop = max(0, int(spots.min()) - reach), int(spots.max()) + reach
            part = words[begin:stop]
            if np.isin(item, part).sum() < threshold * len(item):
                continue  # each matched word gives MATCH at most, all others lose
            score, end_item, end = smith_waterman(item, part)
            if score / (MATCH * len(item)) < threshold:
                continue
            _, _, back = smith_waterman(item[:end_item][::-1], part[:end][::-1])
            near.append(k)
            scores.append(score / (MATCH * len(item)))
            firsts.append(lo + begin + end - back)
            ends.append(lo + begin + end)
        kept = batch.select(["doc_id", "item_id"]).take(pa.array(near, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(scores, pa.float64()), pa.array(firsts, pa.int64()), pa.array(ends, pa.int64())],
            ["doc_id", "item_id", "score", "first_word", "end_word"],
        )


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, first_word, end_word`` of every document and item aligned at ``threshold`` or more."""
    tests = stored(columns_of(items, item_id="long", text="string").mapInArrow(read_items, "item_id long, item_words array<long>, runs array<long>"), "items")
    tests = tests.where(F.size("runs") > 0).withColumn("item", F.xxhash64("item_id", "item_words")).dropDuplicates(["item"])
    own = tests.select("item", F.explode(F.array_distinct("runs")).alias("run"))
    reach = tests.agg(F.max(F.size("item_words"))).first()[0] or 0
    found = passages(columns_of(docs, doc_id="long", text="string"), own.select("run").distinct(), reach)
    found = stored(found.withColumn("passage", F.monotonically_increasing_id()), "passages")
    spots = (
        found.select("passage", F.explode(F.arrays_zip("at", "runs")).alias("hit")).select("passage", F.col("hit.at").alias("spot"), F.col("hit.runs").alias("run"))
        .join(own, "run").groupBy("passage", "item").agg(F.array(F.min("spot"), F.max("spot")).alias("spots"))
    )
    pairs = spots.join(found.drop("runs"), "passage").join(tests.select("item", "item_id", "item_words"), "item")
    scored = pairs.select("doc_id", "item_id", "first", "words", "item_words", "spots").mapInArrow(
        lambda it: align(it, threshold), "doc_id long, item_id long, score double, first_word long, end_word long"
    )
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), "end_word")).alias("best")
    return (
        scored.groupBy("doc_id", "item_id").agg(best)
        .select("doc_id", "item_id", "best.score", (-F.col("best.back")).alias("first_word"), "best.end_word")
    )


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, by_text: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no test item; rows that share a doc_id, or have none, are judged together, or each
    by its own text if ``by_text``."""
    own = row_key(docs) if by_text else docs["`doc_id`"].cast("long")
    judged = docs.select(own.alias("doc_id"), docs["`text`"].alias("text"))
    hit = stored(contaminated(judged, items, threshold).select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    return docs.join(hit, own.eqNullSafe(hit["bad_id"]), "left_anti")
