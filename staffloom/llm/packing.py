"""Packing of tokenised documents into sequences of bounded length.

Tasks tokenise whole texts and cut each into pieces of at most ``capacity`` tokens.  Pieces are dealt at random,
by a number drawn while they are written, into groups of about ``group_rows``; each group is packed on its own by
first-fit decreasing.  A tournament tree over the bins' free room finds the first bin that fits in log n steps.
A piece that fills a sequence alone needs no search.

Defined results: a null or empty text is the end token alone; repeated rows (also of one doc_id) are packed each,
told apart by nothing but their place; a null doc_id stays null; an empty table gives no rows.  Ties of length are
broken by doc_id, start and arrival, so a group that is packed again after a loss comes out the same.  Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import columns_of, sliced, stored

CAPACITY, END = 1024, 0
GROUP_ROWS = 4000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long"


class RankTokenizer:
    """Ids of a byte-level BPE vocabulary given as ranks: the same ids as its JSON file gives, in a third of the time.

    The strings of special tokens stand for those tokens, as they do with the JSON file.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.encoding.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype("<u4").tobytes()


class Tournament:
    """Bins by number; ``first(n)`` is the lowest bin with room for ``n``, found down a tree of largest rooms."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.size)

    def first(self, n: int) -> int:
        at = 1
        while at < self.size:
            at *= 2
            if self.room[at] < n:
                at += 1
        return at - self.size

    def take(self, bin_: int, n: int) -> int:
        """Put ``n`` into the bin; the offset that it gets, as room is counted down from the capacity."""
        at = bin_ + self.size
        before = self.room[at]
        self.room[at] = before - n
        while at > 1:
            at //= 2
            self.room[at] = max(self.room[2 * at], self.room[2 * at + 1])
        return before


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, taken longest first; ties in the order given."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    tree = Tournament(len(lengths), capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = tree.first(lengths[i])
        bins[i], offsets[i] = b, capacity - tree.take(b, lengths[i])
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: dict, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece, and a random ``draw`` that stays with it.

    ``tokenizer`` has the arguments of :class:`RankTokenizer`; each task opens its own.
    """

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = RankTokenizer(**tokenizer), TaskContext.get().partitionId()
        rng, end = np.random.default_rng(part), np.asarray([END], "<u4").tobytes()
        for batch in sliced(it):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part_ids = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (doc_id, start, len(part_ids) // 4, zlib.crc32(part_ids), n)):
                        column.append(value)
            draw = rng.integers(0, 1 << 62, len(rows[0]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in rows), pa.array(draw)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw"],
            )

    return columns_of(docs, doc_id="long", text="string").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: dict, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: its document, place and checksum, its ``sequence_id`` and the ``offset`` in that sequence."""
    rows = stored(pieces(docs, tokenizer, capacity), "pieces")
    groups = max(1, -(-rows.count() // group_rows))

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "start", "draw")])[::-1]
        lengths = table["length"].to_numpy()
        whole = int((lengths == capacity).sum())  # longest first, so these stand in front
        bins, offsets = first_fit_decreasing(lengths[whole:].tolist(), capacity)
        sequence = np.concatenate([np.arange(whole), whole + np.asarray(bins, np.int64)]).astype(np.int64)
        at = np.concatenate([np.zeros(whole, np.int64), np.asarray(offsets, np.int64)])
        out = table.drop_columns(["draw", "pack_group"])
        return out.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32))).append_column("offset", pa.array(at))

    kept = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.withColumn("pack_group", F.pmod(F.col("draw"), F.lit(groups)).cast("long")).groupBy("pack_group").applyInArrow(fill, kept)
