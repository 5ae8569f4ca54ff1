"""Streams of changes into a sink: at-least-once delivery, effects once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Bytes of the log whose commits are one window.
LSN_STRETCH = 1 << 28


class Pipeline:
    """Runs batches of changes through a sink. A fault of the sink stops the stream for good, with the class of the error alone."""

    def __init__(self, changes: DataFrame, sink: Any, checkpoint_folder: str):
        self._changes, self._sink, self._folder = changes, sink, checkpoint_folder
        self.query: StreamingQuery | None = None

    def _deliver(self, batch: DataFrame, _: int) -> None:
        try:
            self._sink.handle_batch(batch)
        except Exception as error:
            raise RuntimeError(f"sink_failed:{type(error).__name__}") from None

    def start(self, available_now: bool = False) -> StreamingQuery:
        writer = self._changes.writeStream.foreachBatch(self._deliver).option("checkpointLocation", self._folder)
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()
        return self.query

    def stop(self) -> None:
        """Stopping twice is stopping once."""
        if self.query is not None and self.query.isActive:
            self.query.stop()


def batch_by_count(commits: DataFrame, n: int) -> DataFrame:
    """commits with the number of its batch, n transactions each. Ranks are counted inside stretches and shifted by the commits before."""
    dealt = commits.withColumn("_stretch", F.floor(F.col("commit_lsn") / LSN_STRETCH))
    sizes = dealt.groupBy("_stretch").agg(F.count("*").alias("_n"))
    before = sizes.select("_stretch", (F.sum("_n").over(W.orderBy("_stretch")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_stretch").orderBy("commit_lsn")) - 1
    return dealt.withColumn("_rank", rank).join(before, "_stretch").withColumn("batch", F.floor((F.col("_before") + F.col("_rank")) / n)).drop("_stretch", "_rank", "_before")


def batch_by_span(commits: DataFrame, span: int) -> DataFrame:
    """commits with the number of its batch: one is cut at the first commit that lies `span` or more past its first.

    A greedy fold has no parallel form in general; commits are folded in order
    by one task, which keeps two numbers.
    """

    def fold(parts):
        base, batch = None, -1
        for part in parts:
            out = []
            for lsn in part["commit_lsn"]:
                if base is None or lsn - base >= span:
                    base, batch = lsn, batch + 1
                out.append(batch)
            yield part.assign(batch=out)

    schema = ", ".join(f"{n} {t}" for n, t in commits.dtypes) + ", batch long"
    return commits.coalesce(1).sortWithinPartitions("commit_lsn").mapInPandas(fold, schema)


def inflight(frames: DataFrame, limit: int) -> DataFrame:
    """For each frame what was received and not yet stored, and whether it is over the limit. frames: seq, wal_end, checkpoint, and spilled if some of it lies on disk.

    Running maxima go over stretches of positions and are carried on.
    """
    dealt = frames.withColumn("_stretch", F.floor(F.col("seq") / POSITIONS))
    tops = dealt.groupBy("_stretch").agg(F.max("wal_end").alias("_wal"), F.max("checkpoint").alias("_cp"), F.min_by("wal_end", "seq").alias("_floor"))
    earlier = W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    first = F.first("_floor").over(W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, 0))
    carried = tops.select("_stretch", F.max("_wal").over(earlier).alias("_wal"), F.max("_cp").over(earlier).alias("_cp"), first.alias("_floor"))
    upto = W.partitionBy("_stretch").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    marked = dealt.withColumn("_own_wal", F.max("wal_end").over(upto)).withColumn("_own_cp", F.max("checkpoint").over(upto)).join(carried, "_stretch")
    spilled = F.coalesce("spilled", F.lit(0)) if "spilled" in frames.columns else F.lit(0)
    lag = F.greatest("_own_wal", "_wal") - F.greatest("_own_cp", "_cp", "_floor") - spilled
    out = marked.withColumn("lag", lag).withColumn("sink_too_slow", F.col("lag") > limit)
    return out.drop("_stretch", "_own_wal", "_own_cp", "_wal", "_cp", "_floor")


#: Positions whose running sum is one window.
POSITIONS = 65_536


def open_streams(frames: DataFrame, limit: int) -> DataFrame:
    """For each frame how many streamed transactions are open after it, and whether they are over the limit.

    frames: seq, kind (start, commit, abort or other), xid, subxid. A start opens
    its transaction unless it is open; a commit, or an abort of the whole (subxid
    null or equal to xid), closes it. Sums of stretches of positions are carried
    on, so that no window holds all frames.
    """
    ends = (F.col("kind") == "commit") | ((F.col("kind") == "abort") & F.coalesce(F.col("subxid") == F.col("xid"), F.lit(True)))
    marked = frames.select("seq", "xid", F.when(F.col("kind") == "start", 1).when(ends, -1).alias("turn"))
    of = marked.filter("turn is not null and xid is not null")
    before = F.coalesce(F.lag("turn").over(W.partitionBy("xid").orderBy("seq")), F.lit(-1))
    moves = of.select("seq", F.when(F.col("turn") != before, F.col("turn")).otherwise(0).alias("d"))
    stretch = F.floor(F.col("seq") / POSITIONS).alias("stretch")
    each = moves.unionByName(marked.filter("turn is null or xid is null").select("seq", F.lit(0).alias("d"))).select("seq", "d", stretch)
    sums = each.groupBy("stretch").agg(F.sum("d").alias("s"))
    carried = sums.select("stretch", F.coalesce(F.sum("s").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    open_ = F.col("carried") + F.sum("d").over(W.partitionBy("stretch").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return each.join(carried, "stretch").select("seq", open_.alias("open_streams")).withColumn("too_many", F.col("open_streams") > limit)


def guard_streams(frames: DataFrame, limit: int) -> None:
    """Stops where more streamed transactions are open than max_concurrent_txns allows."""
    if open_streams(frames, limit).filter("too_many").limit(1).count():
        raise RuntimeError("too_many_streams")


def idle_position(frames: DataFrame, sink_kind: str, checkpoint: int | None) -> Any:
    """Where a state mirror may move its checkpoint when nothing is open: past trailing keepalives. frames: seq, kind (k, begin, commit), wal_end."""
    row = frames.agg(
        F.max_by("kind", F.when(F.col("kind") != "k", F.col("seq"))).alias("last"),
        F.max(F.when(F.col("kind") == "commit", F.col("wal_end"))).alias("commit"),
        F.max(F.when(F.col("kind") == "k", F.col("wal_end"))).alias("idle"),
    ).first()
    free = row["last"] in (None, "commit") and (row["commit"] is None or (checkpoint is not None and checkpoint >= row["commit"]))
    return max(row["idle"], checkpoint or 0) if sink_kind == "state_mirror" and free and row["idle"] is not None else checkpoint


def run_replay(spark: SparkSession, changes_folder: str, schema: str, sink: Any, checkpoint_folder: str) -> Pipeline:
    """Delivers all files of a folder once and waits."""
    pipeline = Pipeline(spark.readStream.schema(schema).parquet(changes_folder), sink, checkpoint_folder)
    pipeline.start(available_now=True).awaitTermination()
    return pipeline
