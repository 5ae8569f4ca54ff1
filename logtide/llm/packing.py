"""Best-fit packing planned on a histogram of lengths.

Texts are tokenised once; documents over the capacity are cut. Best-fit
decreasing runs on the driver over the counts of each length, never over
documents: bins with the same room are one range of numbers, so the plan has a
few thousand entries however many documents there are. Pieces then take the
planned slots by their rank within their length.

Defined results: a null text is the empty text, which is the closing id alone;
a null id stays null on its pieces; a text of any length is cut into as many
pieces as it needs; repeated rows are packed each; other columns, whatever their
names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, id_and_text, only, runs

CAPACITY = 2048
#: Chunks of text whose ids a worker remembers at most.
REMEMBERED = 600_000
#: Rows of one length that one rank window holds, on average.
RANK_ROWS = 200_000


#: Closing ASCII punctuation right after a letter and before a blank. No rule of the tokenizer joins it to the letter.
CLOSING = re.compile(r"(?<=[a-zà-öø-ÿ])([,.!?;:%*#$&)]+)(?= )")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class ChunkTokenizer:
    """Ids of whole texts from remembered ids of their chunks between blanks.

    The tokenizer's rules treat a blank as a boundary, so the ids of a text are
    those of its chunks in order. Only blanks that every white-space rule has
    (space, line feed, tab) split here; the rest is left to the tokenizer. It
    lower-cases, so that A-Z are lowered before chunks are looked up, but in
    texts where that could make a special token's string.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._remembered = remembered
        self._tokenizer = Tokenizer.from_file(path)
        # Two generations: when the young one is full it becomes the old one, and what is used again moves back.
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks = [self._chunks(text) for text in texts]
        young, old = self._young, self._old
        new = []
        for chunk in set().union(*chunks).difference(young):
            found = old.get(chunk)
            if found is None:
                new.append(chunk)
            else:
                young[chunk] = found
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            for chunk, found in zip(part, self._tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                young[chunk] = array("I", found.ids).tobytes()
        out = [b"".join(map(young.__getitem__, own)) for own in chunks]
        if len(young) > self._remembered:
            self._young, self._old = {}, young
        return out

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if "<|" not in text:
            text = text.encode().translate(LOWER).decode()
        return CLOSING.sub(r" \1", text.replace("\n", " ").replace("\t", " ")).split(" ")


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of at most `capacity` tokens."""
    end, step = array("I", [end_id]).tobytes(), 4 * capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = only(ChunkTokenizer, vocabulary, remembered)
        for batch in batches:
            ids, rows = iter(batch.column(0).to_pylist()), []
            for group in runs(batch.column(1).to_pylist(), 1_000_000):
                for found in tokenizer.encode(group):
                    data, doc = found + end, next(ids)
                    rows += [(doc, at // step, at // 4, min(step, len(data) - at) // 4, zlib.crc32(data[at : at + step])) for at in range(0, len(data), step)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_best_fit(counts: Mapping[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts: (placements, number of bins).

    A placement is (length, first rank, first bin, offset): pieces of this
    length from this rank on take one slot each at this offset, in bins from
    first bin on, until the next placement of the length. The result equals
    that of best-fit decreasing over single pieces.
    """
    rooms: list[int] = []  # distinct free room of open bins, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)
    placed: list[tuple[int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                n, fill = (left // each, each) if left >= each else (1, left)
                first, room, bins = bins, capacity, bins + n
            else:
                room, fill = rooms[at], 1
                first, n = ranges[room].pop()
                if n > left:
                    ranges[room].append((first + left, n - left))
                    n = left
                if not ranges[room]:
                    del ranges[room], rooms[at]
            for _ in range(fill):
                placed.append((length, rank, first, capacity - room))
                rank, left, room = rank + n, left - n, room - length
            put(room, first, n)
    return np.array(placed, np.int64).reshape(-1, 4), bins


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """pieces() with sequence_id and offset."""
    cutted = cut(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, remembered))
    counts = {row["length"]: row["n"] for row in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = plan_best_fit(counts, capacity)
    deals = max(64, sum(counts.values()) // RANK_ROWS)

    # The rank within a length: rows are dealt by hash, so that no length is one task's.
    dealt = cutted.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deals)))
    sizes = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = sizes.select("length", "deal", (F.sum("n").over(W.partitionBy("length").orderBy("deal")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "deal").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "deal"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    most = max(counts.values(), default=0) + 1
    keys, rank0, bin0, offset = plan[:, 0] * most + plan[:, 1], plan[:, 1], plan[:, 2], plan[:, 3]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(keys, length * most + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bin0[at] + rank - rank0[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(take, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
