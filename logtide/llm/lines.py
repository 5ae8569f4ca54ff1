"""Line deduplication by a segment-partition edit join.

Distinct lines are joined at edit distance `DISTANCE` or less. If a line of
length l is cut into DISTANCE + 1 segments, a line that near keeps one of them
whole, at a place that its length bounds. So each line is indexed by its
segments, and probes, for its own and each shorter length in reach, the few
substrings that can hold such a segment; keys that only probes have go at
once. What meets and has nearly the same symbols, by parities of their numbers,
is verified with a banded bit-parallel edit distance. Short
lines are joined like any other: of a line under DISTANCE + 1 characters some
segments are empty, and an empty one meets wherever its place is in the line.

Copies of a line are one row from the start. A key that many lines share is cut
into blocks that are compared block by block; of a block just the number of
each line's links and a spanning forest are handed on, never its pairs. A link
counts in the first of its keys alone.

Defined results: a null text is the empty text, with one empty line; copies in
repeated rows count; the least id of a line ignores nulls; lines of any length
join; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, runs
from .components import components

DISTANCE = 2
BLOCK = 256


def distance_within(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is `most` or less: a band of 2 * most + 1 diagonals, its columns as bits of one number.

    Of each symbol the places in the band are kept as bits, shifted when they are next looked at.
    """
    if abs(len(a) - len(b)) > most:
        return None
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b:
        n = max(len(a), len(b))
        return n if n <= most else None
    full, top = (1 << 2 * most + 1) - 1, 1 << 2 * most
    places: dict[str, tuple[int, int]] = {}  # symbol: bit i for place `at` + i - most in b, and that `at`
    for i, symbol in enumerate(b[:most]):
        places[symbol] = places.get(symbol, (0, 0))[0] | 1 << (most + i), 0
    # reach[d]: the diagonals (bit i: place in b = place in a + i - most) that d edits reach at this place of a.
    reach = [sum(1 << (most + i) for i in range(d + 1)) & full for d in range(most + 1)]
    for place, symbol in enumerate(a):
        if place + most < len(b):
            bits, at = places.get(b[place + most], (0, place))
            places[b[place + most]] = bits >> (place - at) | top, place
        bits, at = places.get(symbol, (0, place))
        same, new, before = bits >> (place - at), [], 0
        for d in range(most + 1):
            own = reach[d] & same  # equal
            if d:
                own |= reach[d - 1]  # replaced
                own |= reach[d - 1] >> 1  # a's symbol has no partner
                own |= before << 1 & full  # b has one more
                own |= before
            new.append(own)
            before = own
        reach = new
        if not reach[most]:
            return None
    last = len(b) - len(a) + most
    return next((d for d in range(most + 1) if reach[d] >> last & 1), None)


def parities(lines: list[str]) -> list[int]:
    """64 bits for each line: how many of its symbols fall on each, modulo 2. An edit changes at most two."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    bits = np.uint64(1) << (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
    upto = np.r_[np.uint64(0), np.bitwise_xor.accumulate(bits)] if len(bits) else np.zeros(1, np.uint64)
    ends = np.cumsum([0, *map(len, lines)])
    return (upto[ends[1:]] ^ upto[ends[:-1]]).tolist()


def _window(i: int, shorter: int, distance: int) -> range:
    """Shifts against segment i's start at which a line longer by `shorter` can hold it."""
    return range(max(-i, shorter - (distance - i)), min(i, shorter + distance - i) + 1)


@lru_cache
def _codes(distance: int) -> list[tuple[int, int, int]]:
    """(segment, how much shorter the indexed line is, shift) of each key of a line by its code; own segments come first."""
    own = [(i, 0, 0) for i in range(distance + 1)]
    probes = [(i, shorter, shift) for shorter in range(distance + 1) for i in range(distance + 1) for shift in _window(i, shorter, distance)]
    return own + [p for p in probes if p not in own]


def _code_bits(distance: int) -> int:
    return (len(_codes(distance)) - 1).bit_length()


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of substrings of many lines at once, from one prefix sum of symbols times powers of an odd base."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self._symbols = _mix(np.arange(1, 1 << 16 | 1, dtype=np.uint64))
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 1 << 20)
            inverse = pow(self.BASE, -1, 1 << 64)
            self._up, self._down = (np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (self.BASE, inverse))
        return self._up, self._down

    def keys(self, lines: list[str], codes: list[tuple[int, int, int]], distance: int) -> tuple[np.ndarray, np.ndarray]:
        """One row of hashes for each code, of segment, length of the indexed line and substring; and whether the line has such a place."""
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        up, down = self._powers(len(points) + 1)
        value = self._symbols[points & 0xFFFF] ^ (points >> 16).astype(np.uint64)
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value * up[: len(points)], out=prefix[1:])
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        first = np.cumsum(length) - length
        out, has = np.empty((len(codes), len(lines)), np.uint64), np.empty((len(codes), len(lines)), bool)
        for row, (i, shorter, shift) in enumerate(codes):
            start, size = _segment(np.maximum(length - shorter, 0), i, distance)
            has[row] = (length >= shorter) & (start + shift >= 0) & (start + shift + size <= length)
            at = np.where(has[row], first + start + shift, 0)
            size = np.where(has[row], size, 0)
            seed = _mix(((length - shorter) * (distance + 1) + i).astype(np.uint64))
            out[row] = _mix((prefix[at + size] - prefix[at]) * down[at] ^ seed)
        return out, has


def _segment(length, i: int, distance: int):
    """(start, length) of segment i of a line, or of many: segments are even, the longer ones last."""
    base, left = length // (distance + 1), length % (distance + 1)
    past = i - (distance + 1 - left)
    return i * base + past * (past > 0), base + (past >= 0)


@lru_cache(1)
def _hasher() -> RollingHash:
    return RollingHash()


def _keyed(lines: DataFrame, distance: int, own: bool = False) -> DataFrame:
    """(key, line_key): a line's own segments and, unless own alone are asked for, what else it probes.

    A key is a hash whose low bits are the code of what it hashes. Against lines
    of its own length a line also probes its own segments where they are.
    """
    codes = _codes(distance)[: distance + 1 if own else None]
    bits = np.uint64(_code_bits(distance))
    low = np.arange(len(codes), dtype=np.uint64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            names, at = batch.column(1).to_numpy(), 0
            for group in runs(batch.column(0).to_pylist(), 500_000):
                keys, has = hasher.keys(group, codes, distance)
                keys = (keys >> bits << bits | low)[has]
                mine = np.broadcast_to(names[at : at + len(group)], has.shape)[has]
                at += len(group)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(mine)], names=["key", "line_key"])

    return lines.select("line", "line_key").mapInArrow(run, "key long, line_key long")


def first_key(probing: str, indexed: str, distance: int) -> tuple[int, int] | None:
    """(segment, shift) of the first key in which the two lines meet."""
    shorter = len(probing) - len(indexed)
    for i in range(distance + 1):
        start, size = _segment(len(indexed), i, distance)
        for shift in _window(i, shorter, distance):
            if 0 <= start + shift <= len(probing) - size and probing[start + shift : start + shift + size] == indexed[start : start + size]:
                return i, shift
    return None


def _links(distance: int):
    """For rows sorted by bucket, x, y: links of each group as (a, b, n), with b null and n the number of a's links, or n 0."""
    codes = _codes(distance)

    def near(rows: list[tuple], indexed: list[tuple]) -> Iterator[tuple[tuple, tuple]]:
        """Pairs whose parities differ in few enough bits."""
        most = 2 * distance
        if len(rows) * len(indexed) <= 256:
            yield from ((a, b) for a in rows for b in indexed if (a[4] ^ b[4]).bit_count() <= most)
        else:
            one, other = (np.array([r[4] for r in own], np.uint64) for own in (rows, indexed))
            for i, j in zip(*np.nonzero(np.bitwise_count(one[:, None] ^ other) <= most), strict=True):
                yield rows[i], indexed[j]

    def group(x: int, y: int, rows: list[tuple]) -> Iterator[tuple]:
        indexed = [row for row in rows if row[3] <= distance]
        counts: dict[str, int] = {}
        root: dict[str, str] = {}

        def find(n: str) -> str:
            while root.setdefault(n, n) != n:
                n = root[n]
            return n

        for (a, line, own_a, code, _), (b, other, own_b, _, _) in near(rows, indexed):
            i, shorter, shift = codes[code]
            if a == b or len(line) - len(other) != shorter or (not shorter and a < b) or (min(own_a, own_b), max(own_a, own_b)) != (x, y):
                continue
            if first_key(line, other, distance) == (i, shift) and distance_within(line, other, distance) is not None:
                counts[a], counts[b] = counts.get(a, 0) + 1, counts.get(b, 0) + 1
                p, q = find(a), find(b)
                if p != q:
                    root[p] = q
                    yield a, b, 0
        for a, n in counts.items():
            yield a, None, n

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = chain.from_iterable(zip(*(p[name].tolist() for name in p.columns), parities(p["line"].tolist()), strict=True) for p in parts)
        out = []
        for (_, x, y), own in groupby(rows, key=lambda r: r[:3]):
            out += group(x, y, [r[3:] for r in own])
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["a", "b", "n"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b", "n"])

    return run


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(line, line_id, line_key, n_copies, doc_id): line_id is the MD5 of the line, doc_id the least that has it."""
    texts = id_and_text(docs, id_col, text_col)
    each = texts.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return each.groupBy("line").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("doc_id")).select("*", F.md5("line").alias("line_id"), F.xxhash64("line").alias("line_key"))


def join_lines(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """line_id, doc_id, n_copies, n_links, class_id: one row for each distinct line; class_id is the least line_id reached."""
    lines = cut(distinct_lines(docs, id_col, text_col), as_table=True)
    bits = _code_bits(distance)
    bucket = F.shiftrightunsigned("key", bits)
    indexed = _keyed(lines, distance, own=True).groupBy(bucket.alias("bucket")).agg(F.lit(1).alias("one"))
    # Buckets without an indexed line go in the join, those of one row alone after it.
    held = cut(_keyed(lines, distance).join(indexed, bucket == F.col("bucket")).select("bucket", (F.col("key").bitwiseAND((1 << bits) - 1)).cast("byte").alias("code"), "line_key"), as_table=True)
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n"))
    shared = sizes.filter("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.col("line_key"), F.col("blocks")).cast("int")
    met = cut(held.join(shared, "bucket").select("bucket", "code", "line_key", "blocks", own.alias("own")), as_table=True)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = met.select("*", other).select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "code", "line_key", "own")
    named = dealt.join(lines.select("line_key", "line_id", "line"), "line_key").select("bucket", "x", "y", "line_id", "line", "own", "code")
    grouped = named.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    links = cut(grouped.mapInPandas(_links(distance), "a string, b string, n long"))
    counts = links.filter("b is null").groupBy("a").agg(F.sum("n").alias("n_links"))
    classes = components(links.filter("b is not null").select("a", "b"))
    return (
        lines.join(counts, lines.line_id == counts.a, "left")
        .join(classes, F.col("line_id") == classes.node, "left")
        .select("line_id", "doc_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "line_id").alias("class_id"))
    )


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = id_and_text(docs, id_col, text_col)
    return texts.select("doc_id", F.md5("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("place", "line"))


def members(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place, line_id, n_copies, n_links, class_id: one row for each line of each row of docs; place counts a text's lines from 0."""
    each = _placed(docs, id_col, text_col).select("doc_id", "place", F.unhex(F.md5("line")).alias("_line"))
    found = cut(join_lines(docs, distance, id_col, text_col).select(F.unhex("line_id").alias("_line"), "line_id", "n_copies", "n_links", "class_id"), as_table=True)
    return each.join(found, "_line").select("doc_id", "place", "line_id", "n_copies", "n_links", "class_id")


def without_copies(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: of each class of lines the first stays, by id (null last), text and place; empty lines are a class like any other.

    Rows that repeat id and text are one; one that keeps no line goes.
    """
    each = _placed(docs, id_col, text_col).distinct().withColumn("line_id", F.md5("line"))
    classed = cut(each.join(join_lines(docs, distance, id_col, text_col).select("line_id", "class_id"), "line_id"), as_table=True)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id", "place")
    first = classed.groupBy("class_id").agg(F.min(order).alias("first")).select("class_id", "first.*")
    mine = F.struct("place", "line")
    kept = classed.alias("c").join(first.alias("f"), (F.col("c.class_id") == F.col("f.class_id")) & F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("c.text_id") == F.col("f.text_id")) & (F.col("c.place") == F.col("f.place"))).select("c.*")
    texts = kept.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(mine)).alias("lines"))
    return texts.select("doc_id", F.array_join(F.col("lines.line"), "\n").alias("text"))
