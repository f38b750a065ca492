"""Quality rules by line sequence labelling with a linear-chain conditional random field.

Every line that holds a word is described by a few figures (length, capitals, digits, symbols, marks, repeats).  A
conditional random field over the lines of a text marks each as content or boilerplate by Viterbi decoding; the
share of words in content lines decides whether the text stays.  Lines are learnt from labelled documents: those of
a good document as content, those of a bad one as boilerplate; the chain carries what most lines say to the rest.
The model and the least share are fitted on at most ``sample_rows`` labelled documents outside the held-out fifth,
chosen by hash; everything else reads all rows.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged each; without
labels of both kinds every text that passes the base rules stays.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import WordHashes, columns_of, grams, held_out, raw

WINDOW = 8
SAMPLE_ROWS = 3000
STEPS = 120
SYMBOLS = b"#*$%&|<>"
FIGURES = 13


def byte_classes() -> np.ndarray:
    """A column of 0 and 1 for each class of bytes: capitals, digits, symbols, bars, marks, calls, code point starts, gaps."""
    at = np.zeros((8, 256), np.int64)
    at[0, 65:91] = at[1, 48:58] = 1
    for k, chars in ((2, SYMBOLS), (3, b"|"), (4, b".,;:?"), (5, b"!"), (7, b" \t\n\x0b\x0c\r")):
        at[k, list(chars)] = 1
    at[6] = 1
    at[6, 128:192] = 0  # UTF-8 continuation bytes
    return at


class Text:
    """Base counts of a text and the figures of its lines."""

    def __init__(self, text: bytes | None, hashes: WordHashes, classes: np.ndarray):
        data = np.frombuffer(text or b"", np.uint8)
        words, starts, ends = hashes(text)
        self.n_words = len(words)
        edges = np.concatenate([[-1], np.flatnonzero(data == 10), [len(data)]])
        first, last = np.searchsorted(starts, edges[:-1]), np.searchsorted(starts, edges[1:])
        live = last > first
        lines = (text or b"").split(b"\n")
        seen: set[bytes] = set()
        dup = np.zeros(len(lines), bool)
        for i in np.flatnonzero(live):
            dup[i] = lines[i] in seen
            seen.add(lines[i])
        self.n_dup_lines = int(dup.sum())
        again = np.zeros(len(words) + 1, np.int64)
        runs = grams(words, WINDOW)
        if len(runs):
            order = np.argsort(runs, kind="stable")
            same = runs[order[1:]] == runs[order[:-1]]
            twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            again[twice] += 1
            again[: len(words)] = np.cumsum(again[:-1] - np.concatenate([np.zeros(WINDOW, np.int64), again[:-1]])[: len(words)])
        repeat = np.concatenate([[0], np.cumsum(again[: len(words)] > 0)])
        self.n_repeat_words = int(repeat[-1])
        sums = np.concatenate([np.zeros((8, 1), np.int64), np.cumsum(classes[:, data], 1)], 1) if len(data) else np.zeros((8, 1), np.int64)
        self.word_chars, self.n_symbols = int(sums[6, -1] - sums[7, -1]), int(sums[2, -1])
        self.line_words = (last - first)[live]
        lo, hi = edges[:-1][live] + 1, edges[1:][live]
        n, by = self.line_words, (sums[:, hi] - sums[:, lo]).astype(float)
        chars = np.maximum(by[6] - by[7], 1)
        tail = data[ends[last[live] - 1] - 1] if len(n) else np.zeros(0, np.uint8)
        cap = lambda x: np.minimum(x, 3.0)
        self.figures = np.stack(
            [np.ones(len(n)), np.log1p(n) / 4, n < 4, by[0] / chars, by[0] > 0.4 * chars, cap(by[1] / n), cap(by[2] / n), cap(by[3] / n), cap(by[4] / n),
             cap(by[5] / n), np.isin(tail, list(b".!?")), dup[live], (repeat[last] - repeat[first])[live] / np.maximum(n, 1)], 1,
        ).astype(np.float32) if len(n) else np.zeros((0, FIGURES), np.float32)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


class Chain:
    """Two states by line (0 boilerplate, 1 content): weights of the figures for content, and transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, least: float):
        self.weights, self.moves, self.least = weights, moves, least

    def decode(self, figures: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest states of the lines."""
        content = (figures @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.moves.tolist()
        back, b, c = [], 0.0, 0.0
        for x in content:
            from_b, from_c = (b + bb >= c + cb), (c + cc >= b + bc)
            back.append((from_b, from_c))
            b, c = (b + bb if from_b else c + cb), (c + cc if from_c else b + bc) + x
        states = np.zeros(len(content), np.int64)
        state = int(c >= b)
        for t in range(len(content) - 1, -1, -1):
            states[t] = state
            stays = back[t][state]
            state = state if stays else 1 - state
        return states

    def content_share(self, text: Text) -> float:
        """Share of words in lines marked content; 1 for a text without lines."""
        total = text.line_words.sum()
        return float((text.line_words * self.decode(text.figures)).sum() / total) if total else 1.0


def fit_chain(figures: list[np.ndarray], good: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of greatest likelihood (Adam on the exact gradient, all chains of a step at once)."""
    order = sorted((i for i in range(len(figures)) if len(figures[i])), key=lambda i: -len(figures[i]))
    sizes = np.array([len(figures[i]) for i in order])
    alive = [int((sizes > t).sum()) for t in range(sizes[0])]
    x = [np.stack([figures[i][t] for i in order[:k]]).astype(float) for t, k in enumerate(alive)]
    y = good[order].astype(int)
    theta, m, v = np.zeros(FIGURES + 4), np.zeros(FIGURES + 4), np.zeros(FIGURES + 4)
    total = sizes.sum()
    for step in range(1, steps + 1):
        w, a = theta[:FIGURES], theta[FIGURES:].reshape(2, 2)
        e = [np.stack([np.zeros(len(f)), f @ w], 1) for f in x]
        fore = [e[0]]
        for t in range(1, len(e)):
            fore.append(np.logaddexp.reduce(fore[-1][: alive[t], :, None] + a, 1) + e[t])
        grad, after = np.zeros_like(theta), np.zeros((len(order), 2))
        z = np.zeros(len(order))
        for t, k in enumerate(alive):
            ends = sizes[:k] == t + 1
            z[:k][ends] = np.logaddexp.reduce(fore[t][ends], 1)
        for t in range(len(e) - 1, -1, -1):
            k = alive[t]
            p = np.exp(fore[t][:, 1] + after[:k, 1] - z[:k])
            grad[:FIGURES] += x[t].T @ (y[:k] - p)
            if t:
                step_ = fore[t - 1][:k, :, None] + a + (e[t] + after[:k])[:, None, :] - z[:k, None, None]
                grad[FIGURES:] -= np.exp(step_).sum(0).ravel()
                grad[FIGURES + 3] += y[:k].sum()
                grad[FIGURES] += (1 - y[:k]).sum()
                after[:k] = np.logaddexp.reduce(a + (e[t] + after[:k])[:, None, :], 2)
        grad = grad / total - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:FIGURES], theta[FIGURES:].reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit on at most ``sample_rows`` labelled documents."""
    chosen = (
        columns_of(labels, doc_id="long", quality="int").where("quality is not null and doc_id is not null")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes = WordHashes(), byte_classes()
        for batch in it:
            texts = [Text(t, hashes, classes) for t in raw(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["quality"], pa.array([t.figures.ravel() for t in texts], pa.list_(pa.float32())),
                 pa.array([t.line_words for t in texts], pa.list_(pa.int64()))],
                ["doc_id", "quality", "figures", "line_words"],
            )

    rows = (
        columns_of(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "quality", "text")
        .mapInArrow(describe, "doc_id long, quality int, figures array<float>, line_words array<long>").toArrow().sort_by("doc_id")
    )
    figures = [np.asarray(f, np.float32).reshape(-1, FIGURES) for f in rows["figures"].to_pylist()]
    good = np.asarray(rows["quality"].to_pylist(), int) > 0
    if not any(map(len, figures)) or not 0 < good.sum() < len(good):
        return Chain(np.zeros(FIGURES), np.zeros((2, 2)), 0.0)
    chain = Chain(*fit_chain(figures, good), 0.0)
    share = []
    for f, n in zip(figures, rows["line_words"].to_pylist()):
        n = np.asarray(n, float)
        share.append((n * chain.decode(f)).sum() / n.sum() if len(n) else 1.0)
    share = np.asarray(share)
    grid = np.linspace(0.05, 0.95, 19)
    chain.least = float(grid[int(np.argmax([((share >= g) == good).mean() for g in grid]))])
    return chain


COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
)


def judge(docs: DataFrame, chain: Chain) -> DataFrame:
    """Base counts, verdict of the base rules, content share and final verdict of every text."""

    def rate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes = WordHashes(), byte_classes()
        for batch in it:
            rows = []
            for text in raw(batch["text"]):
                t = Text(text, hashes, classes)
                share = chain.content_share(t)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, not t.base_failed and share >= chain.least, share))
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return columns_of(docs, doc_id="long", text="string").mapInArrow(rate, COLUMNS)
