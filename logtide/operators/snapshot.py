"""Backfill of tables in chunks of key order, and what the stream takes from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows as the stream sends them: text values, in table order."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns or df.columns))


def page(df: DataFrame, keys: Sequence[str], rows: int, after: Sequence | None = None) -> DataFrame:
    """The next `rows` rows in key order after a bound, compared on the native keys."""
    if after is not None:
        df = df.filter(F.struct(*keys) > F.struct(*(F.lit(x).cast(df.schema[k].dataType).alias(k) for k, x in zip(keys, after, strict=True))))
    return df.orderBy(*keys).limit(rows)


def chunk_bounds(df: DataFrame, keys: Sequence[str], rows: int, buckets: int = 64) -> DataFrame:
    """chunk, n_rows, first and last key of all chunks, and an empty last one after a full one.

    Ranks are counted inside key ranges and shifted by the rows before, so that
    no task orders the whole table.
    """
    key = F.struct(*keys)
    ranged = df.select(*keys).repartitionByRange(buckets, *keys).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*keys)) - 1
    ranked = ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("chunk", F.floor((F.col("_before") + F.col("_own")) / rows))
    chunks = ranked.groupBy("chunk").agg(F.count("*").alias("n_rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    none = F.lit(None).cast(chunks.schema["first"].dataType)
    closing = chunks.agg(F.coalesce(F.max("chunk") + 1, F.lit(0)).alias("chunk"), F.coalesce(F.max_by("n_rows", "chunk"), F.lit(rows)).alias("_last")).filter(F.col("_last") == rows)
    return chunks.unionByName(closing.select("chunk", F.lit(0).cast("long").alias("n_rows"), none.alias("first"), none.alias("last")))


def drop_written(chunk: DataFrame, writes: DataFrame, keys: Sequence[str], low: Column | int | None = None, high: Column | int | None = None) -> DataFrame:
    """Rows of a chunk that the stream has not written; of writes, keys of old and new images count."""
    if low is not None:
        writes = writes.filter(F.col("commit_lsn") > low)
    if high is not None:
        writes = writes.filter(F.col("commit_lsn") <= high)
    return chunk.join(writes.select(*keys).distinct(), list(keys), "left_anti")


def contended(writes: DataFrame, keyed: bool, cap: int) -> DataFrame:
    """Tables whose chunk must be read again: too many keys written, or any write without a key."""
    n = F.count_distinct("pk") if keyed else F.count("*")
    return writes.groupBy("table").agg(n.alias("n_written")).filter(F.col("n_written") > (cap if keyed else 0))
