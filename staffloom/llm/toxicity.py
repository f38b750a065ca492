"""Toxicity scores from two class-conditional Kneser-Ney language models.

Labelled texts are split into words (at marks too, A-Z lowered) and counted as runs of ``ORDER`` bytes that end at each byte of a
word or at its end, once as toxic and once as ordinary: models of letters, because expressions are bent and compounded, and
a form never seen shares its stem with forms that were.  Each class has an interpolated Kneser-Ney model: discounted
counts of the longest runs, then continuation counts of shorter ones (runs at a word's beginning have nothing before
them and keep their counts), with discounts estimated from the numbers of runs seen once and twice.  Runs of up to
``SHARED`` bytes are counted over both classes together, so that an expression too rare to judge costs both about the same.

Beside the letters stands a model of whole words: counts less ``WORD_DISCOUNT``, and what that leaves over goes to the word's share
in both classes together, so that words too rare to judge cost both the same.

A word's ratio is its log-likelihood as toxic less that as ordinary.  A text is judged by the ratio per word of the whole
(its length-normalised log-likelihoods compared), of the most telling word and of the three most telling words, as letters and
as words, and by its length; a logistic curve turns these into a value from 0 to 1.  It is fitted with a first model on labelled texts (at most
``curve_rows``, chosen by hash) that this model has not counted; then the final model counts these too.

Counts cover every labelled row that may be learnt from, and are made by Spark.  One row for each distinct run, and for
each word seen more than ``WORD_DISCOUNT`` times in a class, comes to the driver, and one ratio for each goes out to the executors.

Defined results: a null or empty text has no words and gets the curve's value for that; repeated rows are scored
each; null labels, labels without a document and rows without a doc_id teach nothing (a doc_id labelled twice is
toxic if one label says so); with labels of one class only, or none, every score is 0.  Extra columns stay, but
one named as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import WordHashes, columns_of, held_out, raw, sliced, small, stored

#: Bytes of the longest runs (at most 7, as a run is a number), and of the longest ones that the classes share.
ORDER, SHARED = 6, 2
#: What stands before a word and at its end.
BEGIN, END = 1, 32
#: Seen so often or less in a class, a word says nothing about it.
WORD_DISCOUNT = 5
#: Keys of words are from here on, keys of runs below.
WORDS = 1 << 62
CURVE_ROWS = 20_000
FEATURES = 7


class Reader:
    """Words of texts, and the spellings of the distinct ones."""

    def __init__(self):
        self.hashes = WordHashes(lower=True, also=b".,;:!?\"()|")

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Number of the distinct word at each place over all texts, words by text, and the distinct words with their keys."""
        found = [self.hashes(t) for t in texts]
        sizes = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
        if not sizes.sum():
            return np.zeros(0, np.int64), sizes, [], np.zeros(0, np.int64)
        own, first, number = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
        text_of = np.repeat(np.arange(len(texts)), sizes)[first]
        begins, ends = (np.concatenate([f[k] for f in found])[first] for k in (1, 2))
        words = [texts[k][i:j].lower() for k, i, j in zip(text_of, begins.tolist(), ends.tolist())]
        return number, sizes, words, ((own >> np.uint64(2)) | np.uint64(WORDS)).astype(np.int64)


def runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The run of ``ORDER`` bytes up to each byte of each word and up to its end, as a number; where each word begins."""
    spelled = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    place = np.arange(len(spelled))
    begins = np.concatenate([[0], np.flatnonzero(spelled == END)[:-1] + 1])
    begin = np.repeat(begins, np.diff(np.concatenate([begins, [len(spelled)]])))
    out = np.zeros(len(spelled), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        at = place - back
        byte = np.where(at >= begin, spelled[np.maximum(at, 0)], np.where(at == begin - 1, BEGIN, 0))
        out = (out << np.uint64(8)) | byte.astype(np.uint64)
    return out, begins


def count_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by class of each batch of labelled texts."""
    read = Reader()
    for batch in sliced(it, 3000):
        number, sizes, words, keys = read(raw(batch["text"]))
        if not words:
            continue
        toxic = np.repeat(np.asarray(batch["toxic"].to_pylist(), bool), sizes)
        n = np.bincount(number, minlength=len(words))
        bad = np.bincount(number[toxic], minlength=len(words))
        run, _ = runs(words)
        length = [len(w) + 1 for w in words]
        own, at = np.unique(run, return_inverse=True)
        all_, ill = (np.bincount(at, np.repeat(c, length), len(own)).astype(np.int64) for c in (n, bad))
        both = {"run": (own.astype(np.int64), keys), "toxic": (ill, bad), "plain": (all_ - ill, n - bad)}
        yield pa.RecordBatch.from_pydict({name: np.concatenate(parts).astype(np.int64) for name, parts in both.items()})


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``table``, and whether they are there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def last(run: np.ndarray, n: int) -> np.ndarray:
    return run & np.uint64((1 << 8 * n) - 1)


def shorter(run: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` bytes that end those of ``size + 1``: by how many of these they are continued, or (at a word's beginning) how often they are seen."""
    own, at = np.unique(last(run, size), return_inverse=True)
    begins = (own >> np.uint64(8 * (size - 1))) <= BEGIN
    return own, np.where(begins, np.bincount(at, n, len(own)), np.bincount(at, minlength=len(own))).astype(np.float64)


def together(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return own, np.bincount(at, np.concatenate([a[1], b[1]]), len(own))


class Level:
    """One class's runs of one length: counts less the discount, and what is kept for shorter runs, by context."""

    def __init__(self, run: np.ndarray, n: np.ndarray):
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        self.run, self.seen = run, n - discount * np.minimum(n, 1)
        self.context, at = np.unique(run >> np.uint64(8), return_inverse=True)
        self.whole = np.bincount(at, n, len(self.context))
        self.kept = discount * np.bincount(at, np.minimum(n, 1), len(self.context))

    def probability(self, run: np.ndarray, shorter_one: np.ndarray) -> np.ndarray:
        at, known = find(self.run, run)
        seen = np.where(known, self.seen[at], 0) if len(self.run) else np.zeros(len(run))
        at, known = find(self.context, run >> np.uint64(8))
        if not len(self.context):
            return shorter_one
        return np.where(known, (seen + self.kept[at] * shorter_one) / self.whole[at], shorter_one)


@dataclass(frozen=True)
class WordCounts:
    """Words that are seen more than ``WORD_DISCOUNT`` times in a class, and by class all words and what the discount takes."""

    keys: np.ndarray
    counts: tuple[np.ndarray, np.ndarray]
    whole: tuple[float, float]
    taken: tuple[float, float]

    def ratios(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Keys, sorted, with their log ratios; the ratio of all other words."""
        if not all(self.taken):
            return np.zeros(0, np.int64), np.zeros(0), 0.0
        share = (self.counts[0] + self.counts[1]) / sum(self.whole)
        parts = [(np.maximum(n - WORD_DISCOUNT, 0) + t * share) / w for n, w, t in zip(self.counts, self.whole, self.taken)]
        rare = np.log(self.taken[0] / self.whole[0]) - np.log(self.taken[1] / self.whole[1])
        return self.keys, (np.log(parts[0]) - np.log(parts[1])).astype(np.float32), float(rare)


class Model:
    """Log ratios of all known runs and contexts, by length, and the curve."""

    def __init__(self, run: np.ndarray, toxic: np.ndarray, plain: np.ndarray, words: WordCounts | None = None):
        self.words, self.word_ratio, self.rare = words.ratios() if words else (np.zeros(0, np.int64), np.zeros(0), 0.0)
        counts = [{}, {}]
        for c, n in enumerate((toxic, plain)):
            own = run[n > 0], n[n > 0].astype(np.float64)
            for size in range(ORDER, 0, -1):
                counts[c][size] = own
                if size > 1:
                    own = shorter(*own, size - 1)
        for size in range(1, SHARED + 1):
            counts[0][size] = counts[1][size] = together(counts[0][size], counts[1][size])
        single = np.bincount(counts[0][1][0].astype(np.int64), counts[0][1][1], 256) + 1
        self.base = single / single.sum()
        levels = [{size: Level(*counts[c][size]) for size in range(1, ORDER + 1)} for c in (0, 1)]

        def logs(c: int, wanted: np.ndarray, size: int) -> np.ndarray:
            p = self.base[last(wanted, 1).astype(np.int64)]
            for k in range(1, size + 1):
                p = levels[c][k].probability(last(wanted, k), p)
            return np.log(p)

        self.runs, self.ratios, self.contexts, self.backoffs = [], [], [], []
        for size in range(1, ORDER + 1):
            two = levels[0][size], levels[1][size]
            self.runs.append(np.union1d(two[0].run, two[1].run))
            self.ratios.append((logs(0, self.runs[-1], size) - logs(1, self.runs[-1], size)).astype(np.float32))
            self.contexts.append(np.union1d(two[0].context, two[1].context))
            parts = []
            for level in two:
                at, known = find(level.context, self.contexts[-1])
                parts.append(np.log(np.where(known, level.kept[at] / level.whole[at], 1)) if len(level.context) else np.zeros(len(at)))
            self.backoffs.append((parts[0] - parts[1]).astype(np.float32))
        self.curve = np.zeros(FEATURES + 1)
        self.curve[0] = -30.0  # until it is fitted

    @classmethod
    def of(cls, state: dict) -> Model:
        """The model of a broadcast ``vars(model)``: arrays only, which any worker can read."""
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def ratio(self, run: np.ndarray) -> np.ndarray:
        """Log ratio of each run: from the longest known end of it, and what its unknown contexts cost."""
        out, rest = np.zeros(len(run)), np.arange(len(run))
        for size in range(ORDER, 0, -1):
            own = last(run[rest], size)
            at, known = find(self.runs[size - 1], own)
            out[rest[known]] += self.ratios[size - 1][at[known]]
            rest, own = rest[~known], own[~known]
            at, known = find(self.contexts[size - 1], own >> np.uint64(8))
            out[rest[known]] += self.backoffs[size - 1][at[known]]
        return out

    def word_ratios(self, words: list[bytes]) -> np.ndarray:
        run, begins = runs(words)
        own, at = np.unique(run, return_inverse=True)
        return np.add.reduceat(self.ratio(own)[at], begins)

    def whole_words(self, keys: np.ndarray) -> np.ndarray:
        at, known = find(self.words, keys)
        return np.where(known, self.word_ratio[at] if len(self.words) else 0.0, self.rare)

    def features(self, texts: tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]) -> np.ndarray:
        """By text: ratio per word of the whole, of the top word, of the top three, by letters and by words; log of the length."""
        number, sizes, words, keys = texts
        kinds = [of[number] for of in (self.word_ratios(words), self.whole_words(keys))] if words else []
        out, edge = np.zeros((len(sizes), FEATURES)), np.concatenate([[0], np.cumsum(sizes)])
        for i, n in enumerate(sizes):
            if n:
                told = []
                for ratio in kinds:
                    r = ratio[edge[i] : edge[i + 1]]
                    top = np.partition(r, -3)[-3:] if n > 3 else r
                    told += [r.mean(), top.max(), top.mean()]
                out[i] = *told, np.log1p(n)
        return out

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton's method, with a small ridge."""
        if not len(y) or not 0 < y.sum() < len(y):
            return
        one, b = np.column_stack([np.ones(len(x)), x]), np.zeros(FEATURES + 1)
        ridge = 1e-2 * np.eye(FEATURES + 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(one @ b, -30, 30)))
            b += np.clip(np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + ridge, one.T @ (y - p) - ridge @ b), -5, 5)
        self.curve = b

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, part`` of the labelled rows outside the held-out fifth; ``part`` 1 fits the curve.

    The labels are sent to the texts while they are few, which saves shuffling the texts.
    """
    marks = stored(
        columns_of(labels, doc_id="long", toxic="int").where("toxic is not null and doc_id is not null")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")),
        "toxic-labels",
    )
    return (
        columns_of(docs, doc_id="long", text="string").where("doc_id is not null").where(~held_out(F.col("doc_id")))
        .join(small(marks), "doc_id").withColumn("part", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5)
    )


def count(rows: DataFrame) -> DataFrame:
    """``run, toxic, plain``: counts of runs and words (by their keys) in labelled texts by class."""
    found = rows.select("text", "toxic").mapInArrow(count_runs, "run long, toxic long, plain long")
    return found.groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def model_of(counts: DataFrame) -> Model:
    """The model of stored counts."""
    rows = counts.where(F.col("run") < WORDS).toArrow().sort_by("run")
    words = counts.where(F.col("run") >= WORDS)
    least = lambda c: F.sum(F.least(c, F.lit(WORD_DISCOUNT)))
    all_ = [float(v or 0) for v in words.agg(F.sum("toxic"), F.sum("plain"), least("toxic"), least("plain")).first()]
    often = words.where(F.greatest("toxic", "plain") > WORD_DISCOUNT).toArrow().sort_by("run")
    of_words = WordCounts(often["run"].to_numpy(), (often["toxic"].to_numpy(), often["plain"].to_numpy()), (all_[0], all_[1]), (all_[2], all_[3]))
    return Model(rows["run"].to_numpy().astype(np.uint64), rows["toxic"].to_numpy(), rows["plain"].to_numpy(), of_words)


def fit(docs: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS) -> Model:
    """Count both class models with Spark, fit the curve on texts that were not counted, then count these too."""
    rows = learnable(docs, labels)
    first_counts = stored(count(rows.where("part <> 1")), "toxic-counts")
    model = model_of(first_counts)
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, first = Reader(), Model.of(held.value)
        for batch in sliced(it, 1000):
            x = first.features(read(raw(batch["text"])))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["toxic"], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "x"]
            )

    curve = (
        rows.where("part = 1").select("doc_id", "toxic", "text").mapInArrow(describe, "doc_id long, toxic boolean, x array<double>")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(curve_rows).toArrow()
    )
    x = np.asarray(curve["x"].to_pylist()).reshape(-1, FEATURES)
    model.fit_curve(x, np.asarray(curve["toxic"].to_pylist(), float))
    fitted = model.curve
    held.unpersist()
    del model
    both = first_counts.union(count(rows.where("part = 1"))).groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    final = model_of(stored(both, "toxic-counts"))
    final.curve = fitted
    return final


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with ``name`` (0 to 1, higher: likelier toxic), from the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("double")
    def rate(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read, ready = Reader(), Model.of(held.value)
        for texts in it:
            parts = [ready.features(read(raw(texts.slice(k, 1000)))) for k in range(0, len(texts), 1000)]
            yield pa.array(ready.scores(np.concatenate(parts)) if parts else [], pa.float64())

    return docs.withColumn(name, rate(F.col("text").cast("string")))


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    rated = score(docs, fit(docs, labels), "__toxicity")
    return rated.where(F.col("__toxicity") < threshold).select(*(f"`{c}`" for c in docs.columns))
