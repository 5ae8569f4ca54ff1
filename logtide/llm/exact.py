"""Exact deduplication against an immutable snapshot.

The digests of the snapshot are dealt into buckets by hash, and one static
binary-fuse filter per bucket is built. Digests of the incoming batch are
screened by the filters: what a filter refuses is certainly new; what it lets
through is joined with the exact buckets. Duplicates inside the new batch are
grouped separately, before any join. Every group of two or more rows is then
checked byte by byte: two texts under one digest stop the query.

Filters and exact buckets of a snapshot can be stored once (`store_snapshot`) and
later batches screened against them (`known_texts`).

Defined results: a null text is the empty text; a null id never wins against
another id; rows that repeat id and text are one another's copies, and just the
first is kept; a text of any length moves once, to be checked, if it has a copy;
other columns may have any name and type; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, whole_text

#: Digests in one bucket's filter, on average, if there are buckets enough for all tasks, and buckets for each task then.
BUCKET_KEYS, TASK_BUCKETS = 40_000, 4


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of splitmix, seeded."""
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class FuseFilter:
    """Static 3-wise binary-fuse filter with one byte a slot; no false negatives."""

    def __init__(self, seed: int, segment: int, slots: np.ndarray):
        self.seed, self.segment, self.slots = seed, segment, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        span = n_slots // segment - 2
        first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
        low = np.uint64(segment - 1)
        parts = [(first + np.uint64(j)) * np.uint64(segment) + ((h >> np.uint64(shift)) & low) for j, shift in enumerate((0, 10, 20))]
        mark = (_mix(h, 7) & np.uint64(255)).astype(np.uint8)
        return np.stack(parts).astype(np.int64), mark

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        segment = 1 << min(10, max(2, int(np.log2(max(len(keys), 2)) / 1.7) + 2))
        n_slots = (int(len(keys) * 1.3) // segment + 4) * segment
        for seed in range(1, 1000):
            places, mark = cls._places(keys, seed, segment, n_slots)
            order = cls._peel(places, n_slots)
            if order is not None:
                slots = np.zeros(n_slots, np.uint8)
                for wave, own in reversed(order):
                    a, b, c = places[:, wave]
                    slots[own] = mark[wave] ^ slots[a] ^ slots[b] ^ slots[c]
                return cls(seed, segment, slots)
            if seed % 20 == 0:
                n_slots += n_slots // 10 // segment * segment + segment
        raise RuntimeError("no fuse filter could be built")

    @staticmethod
    def _peel(places: np.ndarray, n_slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Waves of (keys, the slot each has alone); no key of a wave touches another's own slot."""
        n = places.shape[1]
        count = np.bincount(places.ravel(), minlength=n_slots)
        holder = np.zeros(n_slots, np.int64)  # xor of the keys at each slot
        for row in places:
            np.bitwise_xor.at(holder, row, np.arange(n))
        gone, order, left = np.zeros(n, bool), [], n
        alone = np.flatnonzero(count == 1)
        while left:
            alone = alone[count[alone] == 1]
            if not len(alone):
                return None
            wave, at = np.unique(holder[alone], return_index=True)
            fresh = ~gone[wave]
            wave, own = wave[fresh], alone[at[fresh]]
            if not len(wave):
                return None
            gone[wave] = True
            left -= len(wave)
            order.append((wave, own))
            touched = places[:, wave]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(holder, row, wave)
            alone = np.unique(touched.ravel())
        return order

    def contains(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), mark = self._places(keys.astype(np.uint64), self.seed, self.segment, len(self.slots))
        return (self.slots[a] ^ self.slots[b] ^ self.slots[c]) == mark

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment], "<u4").tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        seed, segment = np.frombuffer(data[:8], "<u4")
        return cls(int(seed), int(segment), np.frombuffer(data[8:], np.uint8))


def _keys(digests: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(bytes(d[:8]) for d in digests), "<u8")


def build_filters(groups: DataFrame) -> DataFrame:
    """One row (bucket, filter) for each bucket of groups, which has bucket and digest."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": part["bucket"][:1], "filter": [FuseFilter.build(_keys(part["digest"])).to_bytes()]})

    return groups.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket long, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """incoming with maybe: whether its digest may be in the snapshot. A bucket's digests meet its one filter."""
    names = incoming.columns
    schema = ", ".join(f"{name} {kind}" for name, kind in incoming.dtypes) + ", maybe boolean"

    def probe(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({name: [] for name in [*names, "maybe"]})
        maybe = FuseFilter.from_bytes(bytes(held["filter"][0])).contains(_keys(part["digest"])) if len(held) else False
        return part[names].assign(maybe=maybe)

    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, schema)


def _n_buckets(rows: DataFrame) -> int:
    return max(TASK_BUCKETS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // BUCKET_KEYS)


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    part = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return part.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def exact_groups(docs: DataFrame, snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, digest; groups: digest, keep_id, group_size). snapshot tells the rows that are in the snapshot."""
    flagged = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), F.coalesce(snapshot, F.lit(False)).alias("old"))
    texts = id_and_text(docs, id_col, text_col).withColumn("digest", _digest())
    rows = cut(flagged.select("doc_id", _digest().alias("digest"), "old"))
    buckets = _n_buckets(rows)
    held, new = (_grouped(rows.filter(F.col("old") == old), buckets) for old in (True, False))
    screened = cut(screen(new, build_filters(held)), as_table=True)
    positive = screened.filter("maybe").drop("maybe", "bucket").select("digest", F.col("keep_id").alias("k2"), F.col("group_size").alias("n2"))
    exact = held.join(positive, "digest", "full").select("digest", F.greatest("keep_id", "k2").alias("keep_id"), (F.coalesce("group_size", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("group_size"))
    groups = cut(screened.filter("not maybe").select("digest", "keep_id", "group_size").unionByName(exact))
    many = groups.filter("group_size > 1")
    texts_of = texts.join(many.select("digest"), "digest", "left_semi").groupBy("digest", "text").agg(F.lit(1).alias("one"))
    checked = texts_of.groupBy("digest").agg(F.count("*").alias("n_texts"))
    alike = F.when(F.col("n_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share a digest")).cast("long"))
    verified = many.join(checked, "digest").select("digest", "keep_id", alike.alias("group_size"))
    return rows.drop("old"), groups.filter("group_size = 1").unionByName(verified)


def store_snapshot(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the exact buckets of docs, with one text of each digest, and their filters; a folder is written once."""
    texts = id_and_text(docs, id_col, text_col).withColumn("digest", _digest())
    buckets = _n_buckets(texts)
    groups = texts.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.min("text").alias("text"))
    groups = groups.select("*", F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), F.lit(buckets).alias("buckets"))
    groups.write.parquet(f"{folder}/groups")
    build_filters(docs.sparkSession.read.parquet(f"{folder}/groups")).write.parquet(f"{folder}/filters")


def known_texts(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, known_id: the rows of docs whose text a stored snapshot has, by its filters, then its exact buckets, then byte by byte."""
    groups, filters = (docs.sparkSession.read.parquet(f"{folder}/{name}") for name in ("groups", "filters"))
    buckets = (groups.agg(F.max("buckets")).first()[0]) or 1
    texts = id_and_text(docs, id_col, text_col).withColumn("digest", _digest())
    new = texts.select("digest").distinct().withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    maybe = screen(new, filters).filter("maybe").select("digest")
    found = groups.join(maybe, "digest", "left_semi").select("digest", F.col("keep_id").alias("known_id"), F.col("text").alias("known_text"))
    return texts.join(found, "digest").filter("text = known_text").select("doc_id", "known_id")


def older_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """The snapshot of one table: ids up to the middle between the least and the largest."""
    least, most = docs.agg(F.min(id_col).cast("long"), F.max(id_col).cast("long")).first()
    return F.col(id_col).cast("long") <= F.lit((((least or 0) + (most or 0)) // 2))


def exact_dedup(docs: DataFrame, snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs, dropped ones too."""
    rows, groups = exact_groups(docs, snapshot, id_col, text_col)
    # Rows that repeat id and text differ in nothing that is returned: only how many there are matters.
    each = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")).join(groups, "digest")
    turn = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn")
    return each.select("*", turn).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Of rows that repeat id and text, the first by its columns as JSON stays.
    """
    decided = exact_dedup(docs, snapshot, id_col, text_col)
    kept = cut(decided.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).filter("kept").select("doc_id", "text_sha256", "n"))
    # Rows travel as one struct, so that no name of theirs can clash.
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.sha2(whole_text(text_col), 256).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))
    single = marked.join(kept.filter("n = 1"), same, "left_semi").select("row.*")
    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return single
    twice = marked.join(repeated, same, "left_semi").groupBy("id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.unionByName(twice.select("row.*"))
