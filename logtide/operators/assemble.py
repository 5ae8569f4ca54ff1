"""Frames to committed transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .held import Hold, as_it_is


def drop_aborted(changes: DataFrame, aborts: DataFrame) -> DataFrame:
    """Without what aborted: (xid, subxid) of a sub-transaction; both equal for a whole transaction."""
    whole = aborts.filter("xid = subxid").select("xid").distinct()
    parts = aborts.filter("xid <> subxid").select("xid", "subxid").distinct()
    return changes.join(whole, "xid", "left_anti").join(parts, ["xid", "subxid"], "left_anti")


def after_checkpoint(changes: DataFrame, checkpoint: int | None, lsn: str = "commit_lsn") -> DataFrame:
    """What is not yet delivered. A re-delivered transaction is at or below the checkpoint."""
    return changes if checkpoint is None else changes.filter(F.col(lsn) > F.lit(checkpoint))


def ordinals(items: DataFrame, xid: str = "xid", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One counter per transaction for changes and messages alike, before anything is dropped: gaps stay."""
    return items.withColumn("ordinal", F.row_number().over(W.partitionBy(xid).orderBy(*order)) - 1)


def transactions(changes: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """commit_lsn, n_changes, n_messages: transactions without either don't appear."""
    items = changes.select("commit_lsn", F.lit(1).alias("c"), F.lit(0).alias("m"))
    if messages is not None:
        items = items.unionByName(messages.select("commit_lsn", F.lit(0).alias("c"), F.lit(1).alias("m")))
    return items.groupBy("commit_lsn").agg(F.sum("c").alias("n_changes"), F.sum("m").alias("n_messages"))


def nested(changes: DataFrame, fields: list[str]) -> DataFrame:
    """The delivery form: a row for each transaction with its changes in order. Only for sinks that want it."""
    each = F.struct("ordinal", *fields)
    return changes.groupBy("commit_lsn").agg(F.array_sort(F.collect_list(each)).alias("changes"))


#: Positions whose rows are one window.
STRETCH = 1 << 16


def carry_last(frames: DataFrame, value: str, out: str, bucket: int = STRETCH, before: bool = False, hold: Hold = as_it_is, running: Column | None = None) -> DataFrame:
    """The last non-null `value` at or before each seq (before it, if `before`), without a one-task window.

    Windows run inside buckets of seq; the last value of each bucket is carried
    over the bucket rows, which are few, and joined back. hold: what keeps the
    rows between these two steps, so that frames are made once. running: summed
    up to each seq of a bucket as `_run`, which then stays, as `_bucket` does.
    """
    inside = W.partitionBy("_bucket").orderBy("seq")
    dealt = frames.withColumn("_bucket", F.floor(F.col("seq") / bucket)).withColumn("_inside", F.last(value, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1 if before else 0)))
    dealt = hold(dealt if running is None else dealt.withColumn("_run", F.sum(running).over(inside.rowsBetween(W.unboundedPreceding, 0))))
    lasts = dealt.groupBy("_bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq"))).alias("_last"))
    earlier = F.last("_last", ignorenulls=True).over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    carried = hold(lasts.select("_bucket", earlier.alias("_carried")))
    joined = dealt.join(carried if hold is as_it_is else F.broadcast(carried), "_bucket").withColumn(out, F.coalesce("_inside", "_carried"))
    return joined.drop("_inside", "_carried", *["_bucket"] * (running is None))


def relation_in_force(frames: DataFrame, relations: DataFrame, broadcast_versions: int = 0) -> DataFrame:
    """Each frame with the relation version announced last before it: equal relid, seq within the version's interval.

    Versions are sent to all tasks if they are counted and no more than `broadcast_versions`, so that the frames of a hot table need not meet.
    """
    until = F.lead("seq").over(W.partitionBy("relid").orderBy("seq"))
    held = relations.withColumn("_until", until).withColumnRenamed("seq", "_from")
    if broadcast_versions and relations.count() <= broadcast_versions:
        held = F.broadcast(held)
    frame = frames.alias("f")
    return frame.join(held.alias("r"), (F.col("f.relid") == F.col("r.relid")) & (F.col("f.seq") >= F.col("r._from")) & (F.col("r._until").isNull() | (F.col("f.seq") < F.col("r._until"))), "left").drop(F.col("r.relid"))


def before_halt(transactions_: DataFrame, halts: DataFrame) -> DataFrame:
    """Transactions that committed before the first halt; halts: one column seq."""
    first = halts.agg(F.min("seq").alias("_halt"))
    return transactions_.join(F.broadcast(first), how="cross").filter("_halt is null or seq < _halt").drop("_halt")
