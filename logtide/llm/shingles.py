"""Near-duplicates by the Jaccard similarity of word shingles: fingerprints first, then the rest, exact.

A text is the set of its distinct shingles, those of fewer words than the width
one shingle; equal sets are one node. Three rounds find links, each between
nodes that the rounds before left apart, and each link is verified on the whole
sets:

1. SimHash fingerprints of the shingles within 3 bits, by pigeonring. Sets less
   alike than about 0.95 often differ in more bits, and no number of bits that
   buckets can hold is sure to keep all of 0.8; hence the other rounds.
2. Two sets of similarity t or more share one of the first n - ceil(t * n) + 1
   shingles of each, in any order that all texts keep to; the order here puts
   shingles that many texts have last. Of each such key one node meets all
   others, another node for each key.
3. All pairs of a key that still lie apart, a large key block by block.

Before texts are fetched, pairs are pruned by sizes, places and parity sketches.
A sketch counts, modulo 2, the shingles that fall on each of its bits, so that
two differ in no more bits than their sets do in shingles. A short sketch of a
long text is half ones, and tells nothing; so each longer set has a second one
with a bit or two a shingle, a power of two of them, of which the halves are laid
on one another to compare it with a shorter one.

Defined results: words are those of simhash; a null text is the empty text,
equal to any other without words; rows may repeat ids; the least id of a
component ignores nulls; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, release
from .components import components
from .simhash import majority, near_links, shingle_hashes

SIMILARITY, WIDTH = Fraction(4, 5), 5
#: Members of one block of a large key.
BLOCK = 256
#: Rows whose texts a worker holds at once.
ROWS = 500
#: Slots in which shingles are counted, and how far over the mean a common slot is. They order shingles and decide nothing else.
SLOTS, COMMON = 1 << 16, 4
#: Bits of a sketch, and the seed of the hashes.
SKETCH, SEED = 1024, 42


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, width, SEED))


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of how many of the hashes fall on each bit."""
    return np.packbits(np.bincount((hashes >> np.uint64(32)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).tobytes()


def long_sketch(hashes: np.ndarray) -> bytes:
    """As sketch(), with at least as many bits as hashes; empty where sketch() is as long."""
    bits = 1 << max(0, len(hashes) - 1).bit_length()
    return np.packbits(np.bincount((hashes >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1).tobytes() if bits > SKETCH else b""


def _laid(data: bytes, size: int) -> np.ndarray:
    """A long sketch made as short as one of `size` bytes."""
    own = np.frombuffer(data, np.uint8)
    while len(own) > size:
        own = own[: len(own) // 2] ^ own[len(own) // 2 :]
    return own


def long_may_be_near(a: bytes, b: bytes, sizes: int, similarity: Fraction) -> bool:
    """may_be_near() for two long sketches; true if either set has none."""
    p, q = similarity.numerator, similarity.denominator
    size = min(len(a), len(b))
    return not size or int(np.bitwise_count(_laid(a, size) ^ _laid(b, size)).sum(dtype=np.int64)) * (p + q) <= sizes * (q - p)


def may_be_near(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether sketches (rows of 64-bit numbers) differ in no more bits than sets of that similarity, of `sizes` shingles together, can."""
    p, q = similarity.numerator, similarity.denominator
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64) * (p + q) <= sizes * (q - p)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def node_of(hashes: np.ndarray) -> int:
    return int.from_bytes(md5(hashes.tobytes()).digest()[:8], "little", signed=True)


def _nodes(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, node, size, fp, sketch, long_sketch) and, with node null, (slot, n): how many texts' shingles fall in a slot."""
    names = ["doc_id", "text_key", "node", "size", "fp", "sketch", "long_sketch", "slot", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        slots = np.zeros(SLOTS, np.int64)
        for batch in _few(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                every = shingle_hashes(text, width, SEED)
                own = np.unique(every)
                rows.append((node_of(own), len(own), np.uint64(majority(every)).astype(np.int64), sketch(own), long_sketch(own)))
                np.add.at(slots, (own % np.uint64(SLOTS)).astype(np.int64), 1)
            cols = list(zip(*rows, strict=True))
            held = [pa.array(c, pa.binary()) for c in cols[3:]]
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in cols[:3]), *held, none, none], names=names)
        at = np.flatnonzero(slots)
        none = [pa.nulls(len(at), pa.binary() if "sketch" in name else pa.int64()) for name in names[:7]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at), pa.array(slots[at])], names=names)

    return texts.mapInArrow(run, "doc_id long, text_key long, node long, size long, fp long, sketch binary, long_sketch binary, slot long, n long")


def _common(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the slots far over the mean, by slot."""
    counts = marked.filter("node is null").groupBy("slot").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = sorted(map(tuple, counts.filter(F.col("n") > COMMON * (total // SLOTS + 1)).collect()))
    return np.array([s for s, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def _ordered(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    slots, counts = common
    if not len(slots):
        return hashes
    own = (hashes % np.uint64(SLOTS)).astype(np.int64)
    at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
    return hashes[np.lexsort((hashes, np.where(slots[at] == own, counts[at], 0)))]


def _keyed(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: Fraction, width: int) -> DataFrame:
    """(key, node, n, place): the prefix of each text; n is the size of its set. Rows of equal sets repeat."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in _few(batches):
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for text in batch.column(1).to_pylist():
                own = shingles(text, width)
                n = len(own)
                prefix = _ordered(own, common)[: n + (-n * p // q) + 1]
                for col, x in zip(cols, (prefix.view(np.int64), np.full(len(prefix), node_of(own)), np.full(len(prefix), n), np.arange(len(prefix))), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names=["key", "node", "n", "place"])

    return texts.mapInArrow(run, "key long, node long, n long, place long")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, SKETCH // 64)


def _pairs(similarity: Fraction):
    """For rows sorted by key, x, y: pairs of each group that lie in different components and can overlap enough."""
    p, q = similarity.numerator, similarity.denominator

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def pairs(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            group = part[["key", "x", "y"]].to_numpy()
            edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1), True])
            node, root, n, place, own = (part[c].to_numpy() for c in ("node", "root", "n", "place", "own"))
            sketches = _sketches(part["sketch"])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                x, y = group[lo, 1:]
                s, left = n[lo:hi], n[lo:hi] - place[lo:hi]
                able = (np.minimum(left[:, None], left) * (p + q) >= p * (s[:, None] + s)) & (root[lo:hi, None] != root[lo:hi]) & (node[lo:hi, None] < node[lo:hi])
                o = own[lo:hi]
                able &= (np.minimum(o[:, None], o) == x) & (np.maximum(o[:, None], o) == y)
                a, b = np.nonzero(able)
                near = may_be_near(sketches[lo + a], sketches[lo + b], n[lo + a] + n[lo + b], similarity)
                if near.any():
                    yield pd.DataFrame({"a": node[lo + a[near]], "b": node[lo + b[near]]})

        for part in parts:
            if rest is not None:
                part = pd.concat([rest, part], ignore_index=True)
            group = part[["key", "x", "y"]].to_numpy()
            last = np.flatnonzero((group != group[-1]).any(1)) if len(part) else []
            cut_at = last[-1] + 1 if len(last) else 0  # the last group may go on
            rest = part.iloc[cut_at:].reset_index(drop=True)
            if cut_at:
                yield from pairs(part.iloc[:cut_at])
        if rest is not None and len(rest):
            yield from pairs(rest)

    return run


def _pruned(pairs: DataFrame, nodes: DataFrame, similarity: Fraction) -> DataFrame:
    """Those pairs of nodes (a, b) whose sketches may be as near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            near = may_be_near(_sketches(batch.column(4).to_pylist()), _sketches(batch.column(5).to_pylist()), sizes, similarity) if batch.num_rows else np.zeros(0, bool)
            batch, sizes = batch.filter(pa.array(near)), sizes[near]
            near = [long_may_be_near(a, b, n, similarity) for a, b, n in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), sizes.tolist(), strict=True)]
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    names = ("size", "sketch", "long_sketch")
    of = lambda side: nodes.select(F.col("node").alias(side), *(F.col(name).alias(f"{side}_{name}") for name in names))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", *(f"{side}_{name}" for name in names for side in "ab")).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: Fraction, width: int) -> DataFrame:
    """Those pairs of nodes (a, b) whose whole sets are as similar."""
    p, q = similarity.numerator, similarity.denominator
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "least_id", "least_key"), "node")
    same = F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("text_key") == F.col("least_key"))
    held = cut(texts.join(wanted, same).select("node", "text").dropDuplicates(["node"]), as_table=True)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in _few(batches):
            keep, sets = [], {}
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for node, text in ((a, x), (b, y)):
                    if node not in sets:
                        sets[node] = shingles(text, width)
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * q >= p * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    texts_of = lambda name: held.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))
    return pairs.join(texts_of("a"), "a").join(texts_of("b"), "b").select("a", "b", "a_text", "b_text").mapInArrow(near, "a long, b long")


def _alike(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b) that fingerprints link: those of one fingerprint through its least node, those within 3 bits through these."""
    held = cut(nodes.groupBy("fp").agg(F.min("node").alias("of")))
    links = near_links(held.select("fp"))
    one, other = (held.select(F.col("fp").alias(name), F.col("of").alias(f"of_{name}")) for name in "ab")
    across = links.join(one, "a").join(other, "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    inside = nodes.join(held, "fp").filter("node <> of").select(F.col("of").alias("a"), F.col("node").alias("b"))
    return across.unionByName(inside).distinct()


def near_groups(docs: DataFrame, similarity: Fraction = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: one row for each row of docs; component_id is the least id of what links of `similarity` or more reach."""
    p, q = similarity.numerator, similarity.denominator
    texts = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    marked = cut(_nodes(texts, width), as_table=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    nodes = marked.filter("node is not null").groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("size", "fp", "sketch", "long_sketch")))
    nodes = cut(nodes.select("node", F.col("first.doc_id").alias("least_id"), F.col("first.text_key").alias("least_key"), "size", "fp", "sketch", "long_sketch"), as_table=True)
    checked = lambda pairs: cut(_verified(cut(_pruned(pairs, nodes, similarity)), nodes, texts, similarity, width))

    links = checked(_alike(nodes))
    keyed = cut(_keyed(texts, _common(marked), similarity, width), as_table=True)
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    met = cut(keyed.join(shared, "key").distinct(), as_table=True)

    def apart(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of keys whose nodes have more than one root, with these."""
        rooted = rows.drop("root").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_keys = rooted.groupBy("key").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "held")
        return cut(rooted.drop("held").join(open_keys, "key"), as_table=True)

    left = apart(met, links)
    turn = F.xxhash64("node", "key")
    star = left.groupBy("key").agg(*(F.min_by(c, turn).alias(f"star_{c}") for c in ("node", "n", "place", "root")))
    able = F.least(F.expr("n - place"), F.expr("star_n - star_place")) * (p + q) >= (F.col("n") + F.col("star_n")) * p
    stars = cut(left.join(star, "key").filter("root <> star_root").filter(able).select(F.least("node", "star_node").alias("a"), F.greatest("node", "star_node").alias("b")).distinct())
    links = cut(links.unionByName(checked(stars)))
    # Of a key of two the one pair has been tried.
    left = apart(left.filter("held > 2"), links)
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    held = left.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(nodes.select("node", "sketch"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = held.select("*", other).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "root", "n", "place", "own", "sketch")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    rest = cut(dealt.mapInPandas(_pairs(similarity), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti"))
    found = components(links.unionByName(checked(rest)))
    rooted = nodes.join(found, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    component = rooted.join(lowest, "root").select("node", "component_id")
    return marked.filter("node is not null").join(component, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: Fraction = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's, with all their columns; ids are taken to be unique."""
    decided = near_groups(docs, similarity, width, id_col, text_col).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_keep_doc")).distinct()
    return docs.join(decided, F.col(id_col).cast("long").eqNullSafe(F.col("_keep_doc")), "left_semi")
