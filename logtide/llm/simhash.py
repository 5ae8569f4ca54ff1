"""SimHash near-duplicates with pigeonring candidate filtering.

The 64 bits of a fingerprint lie on a ring of eight segments. If two
fingerprints differ in at most 3 bits, then from some segment on, every chain
of i consecutive segments differs in at most floor(3i/8) bits: the first two
segments are equal, the first five differ in at most one bit, and so on. The
two equal segments and the half of the next three that must be equal make a
bucket key of 28 bits; the other budgets prune what shares a bucket before the
full Hamming check.

Equal fingerprints are one node. A bucket of two is checked as it is; a larger
one is cut into blocks that are compared block by block, and only a spanning
forest of its links is handed on, never its pairs.

Defined results: a null text is the empty text; no words give fingerprint zero,
linked like any other; a null id joins its fingerprint's component, whose id is
its least non-null one; texts of any length count whole; repeated rows give repeated
results; other columns, whatever their names, don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text
from .components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS, SEGMENTS = 64, 8
#: Members of one block of a large bucket.
BLOCK = 256
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16


def words(text: str) -> list[bytes]:
    """A-Z lower-cased; words are stretches without space and \\t \\n \\v \\f \\r."""
    return text.encode().translate(LOWER).split()


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included; fewer words than the width are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(own[i:] for i in range(width)), strict=False)) if len(own) >= width else [b" ".join(own)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, width, seed) for text in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def budgets(distance: int) -> list[int]:
    """Most differing bits in a chain of 1 to SEGMENTS segments."""
    return [distance * i // SEGMENTS for i in range(1, SEGMENTS + 1)]


def _rotated(bits: Column, start: Column) -> Column:
    """bits with segment `start` on top."""
    by = start * 8
    return F.call_function("shiftleft", bits, by).bitwiseOR(F.call_function("shiftrightunsigned", bits, F.lit(BITS) - by))


def _top(bits: Column, n: int) -> Column:
    return F.shiftrightunsigned(bits, BITS - n) if n < BITS else bits


def _chain(a: Column, b: Column, start: Column, distance: int) -> Column:
    """Whether each chain from segment `start` on is within its budget; the last budget is the full check."""
    turned = _rotated(a.bitwiseXOR(b), start)
    passed = F.lit(True)
    for i, budget in enumerate(budgets(distance), 1):
        passed = passed & (F.bit_count(_top(turned, 8 * i)) <= budget)
    return passed


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, fp): 16 keys for each fingerprint. A key is start, half, two segments and half of the next three."""
    keys = []
    for start in range(SEGMENTS):
        turned = _rotated(F.col("fp"), F.lit(start))
        two, three = _top(turned, 16), F.shiftrightunsigned(turned, 24).bitwiseAND(F.lit((1 << 24) - 1))
        for half, part in enumerate((F.shiftrightunsigned(three, 12), three.bitwiseAND(F.lit((1 << 12) - 1)))):
            keys.append(F.lit((start * 2 + half) << 28).cast("long").bitwiseOR(F.shiftleft(two, 12)).bitwiseOR(part))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(fps: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a few hundred fingerprints whose chain begins at segment `start`."""
    differ = fps[:, None] ^ fps[None, :]
    turned = (differ << np.uint64(8 * start)) | (differ >> np.uint64(BITS - 8 * start)) if start else differ
    near = np.ones(differ.shape, bool)
    for i, budget in enumerate(budgets(distance), 1):
        near &= np.bitwise_count(turned >> np.uint64(BITS - 8 * i)) <= budget
    left = np.ones(len(fps), bool)
    a, b = [], []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        reach = [root]
        while reach:
            node = reach.pop()
            found = np.flatnonzero(near[node] & left)
            left[found] = False
            reach += found.tolist()
            a += [node] * len(found)
            b += found.tolist()
    return fps[a], fps[b]


def _forests(distance: int):
    """For rows (key, x, y, fp) sorted by the first three: links of each group."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def links(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            group = part[["key", "x", "y"]].to_numpy()
            edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1), True])
            fps = part["fp"].to_numpy().view(np.uint64)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                a, b = _forest(fps[lo:hi], int(group[lo, 0] >> 29), distance)
                if len(a):
                    yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for part in parts:
            if rest is not None:
                part = pd.concat([rest, part], ignore_index=True)
            group = part[["key", "x", "y"]].to_numpy()
            last = np.flatnonzero((group != group[-1]).any(1)) if len(part) else []
            cut_at = last[-1] + 1 if len(last) else 0  # the last group may go on
            rest = part.iloc[cut_at:].reset_index(drop=True)
            if cut_at:
                yield from links(part.iloc[:cut_at])
        if rest is not None and len(rest):
            yield from links(rest)

    return run


def near_links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that connect whatever the pairs of fingerprints at `distance` or less connect. nodes: distinct fp."""
    keyed = _keyed(nodes)
    buckets = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    start = F.shiftrightunsigned(F.col("key"), 29).cast("int")
    pairs = buckets.filter("n = 2").filter(_chain(F.col("a"), F.col("b"), start, distance)).select("a", "b")
    large = buckets.filter("n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = keyed.join(large, "key").select("key", "fp", own.alias("own"), other).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return pairs.unionByName(dealt.mapInPandas(_forests(distance), "a long, b long"))


def near_groups(docs: DataFrame, distance: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs."""
    if distance != 3:
        raise ValueError("the bucket keys are made for 3 bits")
    marked = cut(fingerprints(docs, width, seed, id_col, text_col))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = components(near_links(nodes.select("fp"), distance))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # Most fingerprints are alone: only linked ones need the least id of their root.
    component = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's, with all their columns; ids are taken to be unique."""
    decided = near_groups(docs, id_col=id_col, text_col=text_col).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_keep_doc")).distinct()
    return docs.join(decided, F.col(id_col).cast("long").eqNullSafe(F.col("_keep_doc")), "left_semi")
