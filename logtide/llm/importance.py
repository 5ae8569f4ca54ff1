"""Quality selection by importance resampling.

Two generative models over hashed n-grams are fitted: one on target texts, one
on the whole raw corpus. A text's weight is its likelihood ratio over that of a
text of its length at the limit between good and poor, and texts are drawn
without replacement in proportion to their weights: to the logarithm of each
weight Gumbel noise is added, and the k largest sums are kept. Where weights lie
close together, the seed decides; far from the limit it seldom does.

The limit, a log ratio for each feature, is the one that separates labelled good
from labelled poor texts best; k is the number of texts over it, or the caller's.
Target texts and labels come from a bounded sample of labelled rows (`labelled`,
by hash of the id); the raw model, k and the draw cover all rows.

Defined results: a null text is the empty text; a text without features has
weight 1 and is kept; a null id is drawn as the id 0 would be; rows that repeat
id and text share their fate, and ties at the k-th sum are all kept; without
labels of both kinds the limit is 0; texts of any length count whole; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, only, whole_text

BUCKETS = 1 << 14
LABELLED = 20_000
#: Scales the noise: 1 draws in proportion to the weights, 0 takes the k largest.
TEMPERATURE = 1.0
TOKEN = re.compile(r"\w+|[^\w\s]+")
BINS = 4096
#: Stands for no limit: no feature's log ratio is as low.
BOUND = 1e4


#: Tokens whose hash and shape a worker remembers at most.
REMEMBERED = 300_000


def _mark(token: str) -> int:
    """Hash of the lower-cased token, and three bits for its shape: capitals, marks, a capital first, digits, or else."""
    shape = 1 if token.isupper() and len(token) > 1 else 2 if not token[0].isalnum() else 3 if token[0].isupper() else 4 if token[0].isdigit() else 5
    return crc32(token.lower().encode()) << 3 | shape


def features(text: str, buckets: int) -> np.ndarray:
    """Buckets of the words, marks and neighbouring pairs of a text, and of the pairs of their shapes."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64)
    known: dict[str, int] = only(dict)
    for token in set(tokens).difference(known):
        known[token] = _mark(token)
    marks = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    if len(known) > REMEMBERED:
        known.clear()
    one, shape = marks >> 3, marks & 7
    again = np.r_[False, one[1:] == one[:-1]]  # a word that repeats the one before
    pairs = (one[:-1] * 0x9E3779B1 + one[1:]) & 0xFFFFFFFF
    shapes = (np.r_[0, shape[:-1]] * 8 + shape) * 7919 + again * 104729 + (1 << 33)
    return np.concatenate([one, pairs, shapes]) * 0x2545F491 % 4294967291 % buckets


#: Labelled ids whose hashes are looked at, over those that are wanted.
SPARE = 1.5


def _sample(labels: DataFrame, labelled: int) -> dict[int, int]:
    """quality of at most `labelled` labelled ids, those of the least hashes. Hashes are even, so that a bound on them leaves little more to sort."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, turn = own.count(), F.xxhash64("doc_id")
    bound = -(1 << 63) + int(min(1.0, SPARE * labelled / max(n, 1)) * ((1 << 64) - 1))
    near = own.filter(turn <= bound) if bound < (1 << 63) - 1 else own
    rows = near.orderBy(turn, "doc_id").limit(labelled).collect()
    if len(rows) < min(n, labelled):  # hashes that are not even
        rows = own.orderBy(turn, "doc_id").limit(labelled).collect()
    return {r["doc_id"]: r["quality"] for r in rows}


def fit(texts: DataFrame, good: frozenset[int], buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket; counts are summed per task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time leaves Arrow
                own = np.bincount(features(text.as_py(), buckets), minlength=buckets)
                raw += own
                if doc.as_py() in good:
                    target += own
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    total = np.ones((2, buckets))
    for bucket, raw, target in texts.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # a row for each bucket
        total[:, bucket] += raw, target
    raw, target = total / total.sum(1, keepdims=True)
    return np.log(target) - np.log(raw)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Noise that depends on id and seed alone, so that it is the same when a task runs again."""
    x = (ids.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return -np.log(-np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53))


def weigh(texts: DataFrame, ratios: np.ndarray, temperature: float, seed: int = 0) -> DataFrame:
    """doc_id, text_key, n_features, log_weight (the plain log ratio) and noise. texts: doc_id, text, text_key."""
    buckets = len(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1)):  # the features of one text at a time are held
                found = features(text.as_py(), buckets)
                n[i], weight[i] = len(found), ratios[found].sum()
            noise = temperature * gumbel(np.array([i or 0 for i in batch.column(0).to_pylist()], np.int64), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(weight), pa.array(noise)], names=["doc_id", "text_key", "n_features", "log_weight", "noise"])

    return texts.mapInArrow(run, "doc_id long, text_key long, n_features long, log_weight double, noise double")


def split_point(scores: np.ndarray, good: np.ndarray) -> float:
    """The score that parts good from poor with the greatest sum of their rates; midway in the gap."""
    order = np.argsort(scores)
    scores, good = scores[order], good[order]
    lost = np.r_[0, np.cumsum(good)] / max(1, good.sum())
    caught = np.r_[0, np.cumsum(~good)] / max(1, (~good).sum())
    at = int(np.argmax(caught - lost))
    if at == 0:
        return -np.inf
    return float(scores[at - 1] if at == len(scores) else (scores[at - 1] + scores[at]) / 2)


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the column key, by histograms of BINS bins over ever smaller ranges."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = max(1, -(-(high - low + 1) // BINS))
        bin_ = F.floor((F.col("key") - low) / width).cast("long") if width == 1 else F.expr(f"(key - {low}) div {width}")
        counts = sorted(((r[0], r[1]) for r in keys.filter(F.col("key").between(low, high)).groupBy(bin_.alias("bin")).count().collect()), reverse=True)
        for at, n in counts:
            if k <= n:
                low, high = low + at * width, min(high, low + at * width + width - 1)
                break
            k -= n
    return low


def _selected(docs: DataFrame, labels: DataFrame, buckets: int, labelled: int, temperature: float, seed: int, k: int | None, id_col: str, text_col: str) -> DataFrame:
    texts = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    known = _sample(labels, labelled)
    ratios = fit(texts, frozenset(i for i, q in known.items() if q == 1), buckets)
    scored = cut(weigh(texts, ratios, temperature, seed))
    per_feature = F.col("log_weight") / F.greatest("n_features", F.lit(1))
    quality = F.broadcast(docs.sparkSession.createDataFrame(list(known.items()), "label_id long, quality int"))  # at most `labelled` rows
    rows = scored.join(quality, scored.doc_id == quality.label_id).groupBy("label_id").agg(F.max(per_feature).alias("score"), F.max("quality").alias("quality")).collect()
    good = np.array([r["quality"] == 1 for r in rows], bool)
    point = split_point(np.array([r["score"] for r in rows]), good) if good.any() and not good.all() else 0.0
    point = point if np.isfinite(point) else -BOUND
    relative = F.col("log_weight") - F.lit(point) * F.col("n_features")
    drawn = scored.filter((relative >= 0) & (F.col("n_features") > 0)).count() if k is None else min(k, scored.filter("n_features > 0").count())
    key = F.round((relative + F.col("noise")) * 1e6).cast("long")
    least = kth_largest(scored.filter("n_features > 0").select(key.alias("key")), drawn) if drawn else None
    kept = (F.col("n_features") == 0) | (key >= F.lit(least) if drawn else F.lit(False))
    return scored.select("doc_id", "text_key", "n_features", "log_weight", relative.alias("relative_log_weight"), kept.alias("kept"))


def select(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED, temperature: float = TEMPERATURE, seed: int = 0, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, log_weight, relative_log_weight, kept: one row for each row of docs; k is how many texts with features are drawn."""
    return _selected(docs, labels, buckets, labelled, temperature, seed, k, id_col, text_col).drop("text_key")


def keep_selected(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED, temperature: float = TEMPERATURE, seed: int = 0, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that select keeps, by id and text, with all their columns."""
    kept = _selected(docs, labels, buckets, labelled, temperature, seed, k, id_col, text_col).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_key"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_semi").select("row.*")
