"""Small helpers that the operators share: words, hashes, Arrow columns, shared tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="llm-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, lost executors redo nothing."""
    path = f"{scratch(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table that says something about some documents is sent to every task while it has at most so many rows.
BROADCAST_ROWS = 200_000
NO_ID = -(1 << 63)


def small(df: DataFrame) -> DataFrame:
    """``df`` (a stored table), to be broadcast if it has at most ``BROADCAST_ROWS`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def keyed(docs: DataFrame) -> DataFrame:
    """``id, mark, text``: doc_id with nulls first, a checksum that tells apart texts under one doc_id."""
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    doc_id = F.coalesce(F.col("`doc_id`").cast("long"), F.lit(NO_ID))
    return docs.select(doc_id.alias("id"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int").alias("mark"), text.alias("text"))


def row_key(docs: DataFrame) -> Column:
    """Hash of a row's doc_id and text."""
    text = F.coalesce(docs["`text`"].cast("string"), F.lit(""))
    return F.xxhash64(F.coalesce(docs["`doc_id`"].cast("long"), F.lit(NO_ID)), text)


def doc_id_of(name: str) -> Column:
    """The document's id again, null where it was null."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias("doc_id")


def columns_of(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, each cast to its type; others (of whatever name) are left out."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()))


def sliced(it: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches (without copying), so a task works on few texts at a time."""
    for batch in it:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def raw(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def split(text: bytes | None) -> list[bytes]:
    """Words of a text: ``bytes.split`` cuts at just the characters that :data:`WORD` leaves out."""
    return text.split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _odd_powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.multiply.accumulate(np.full(n - 1, 0x9E3779B97F4A7C15, np.uint64))
    return out


class WordHashes:
    """64-bit hashes of all words of a text at once: a polynomial over random values of the bytes, then mixed.

    Words end at the white space of :data:`WORD` and at the bytes of ``also``; ``lower`` takes A-Z as a-z.
    Long texts are taken in stretches cut between words, so memory stays bounded by the longest word.
    """

    STRETCH = 1 << 19
    POWERS = 1 << 12

    def __init__(self, lower: bool = False, also: bytes = b""):
        self.gap = np.zeros(256, bool)
        self.gap[list(b" \t\n\x0b\x0c\r" + also)] = True
        self.value = mix(np.arange(1, 257, dtype=np.uint64))
        if lower:
            self.value[65:91] = self.value[97:123]
        self.powers = _odd_powers(self.POWERS)

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end of every word."""
        if not text:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = np.frombuffer(text, np.uint8)
        gaps = self.gap[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gaps, [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        out = np.zeros(len(starts), np.uint64)
        cut = 0
        while cut < len(starts):
            stop = max(cut + 1, int(np.searchsorted(ends, starts[cut] + self.STRETCH, "right")))
            size = ends[cut:stop] - starts[cut:stop]
            first = np.cumsum(size) - size
            inside = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
            held = inside + np.repeat(starts[cut:stop], size)
            with np.errstate(over="ignore"):
                bits = self.value[data[held]] * self.powers[inside % self.POWERS]
                out[cut:stop] = mix(np.add.reduceat(bits, first) + size.astype(np.uint64))
            cut = stop
        return out, starts, ends


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; none where the text is shorter."""
    m = len(words) - n + 1
    if m <= 0:
        return words[:0]
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
    return mix(h)


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable over ``edges`` (``a, b``) for every row of ``nodes`` (``id``).

    Each round sends every label along the edges and then follows labels one step (pointer jumping), so a
    chain of n links takes about log n rounds.  Rounds are written to the shared folder; nothing but one
    count of changes comes to the driver.  Ids without an edge never take part in a round.
    """
    links = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        sent = links.join(labels, links.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        best = labels.join(sent, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        moved = best.join(jump, "near", "left").select("id", "old", F.least("near", "far").alias("label"))
        moved = stored(moved, "labels")
        labels = moved.select("id", "label")
        if moved.where("old <> label").isEmpty():
            break
    return nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))

