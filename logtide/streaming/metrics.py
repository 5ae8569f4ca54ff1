"""Events as rows, behind an allowlist: names, keys and shapes of values are fixed, and no row value passes."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The events that are told.
EVENTS = (
    "transaction.assembled", "sink.committed", "sink.failed", "sink.batch_committed", "message.received",
    "schema_change.additive", "schema_change.halted", "checkpoint.advanced", "checkpoint_store.read",
    "checkpoint_store.written", "checkpoint_store.batch_flushed", "checkpoint_store.retrying", "checkpoint_store.failed",
    "connection.connected", "connection.disconnected", "connection.slot_active", "connection.slot_invalidated",
    "connection.session_identity_rejected", "connection.command_error_halt", "snapshot.started", "snapshot.resumed",
    "snapshot.table_completed", "snapshot.chunk_completed", "snapshot.chunk_retried", "snapshot.completed",
    "snapshot.failed", "stream.committed", "stream.aborted", "stream.spilled", "stream.spill_exhausted", "pipeline.halted",
)
# Keys and the shapes of what they hold.
NUMBERS = ("duration", "lag", "byte_size", "change_count", "commit_lsn", "lag_ms", "attempt", "max_retries")
NAMES = ("slot_name", "table", "reason", "error_class", "kind")
FLAGS = ("transactional",)
SCHEMA = "event string, numbers map<string,bigint>, names map<string,string>, flags map<string,boolean>"


class MetricRefused(ValueError):
    """Tells no value."""


def valid(event: str, numbers: Mapping[str, object], names: Mapping[str, object], flags: Mapping[str, object] | None = None) -> None:
    """Fails without the value if an event, a key or a shape is not allowed. Only a lag may be negative; only a position and names may be absent."""
    flags = flags or {}
    if event not in EVENTS or not set(numbers) <= set(NUMBERS) or not set(names) <= set(NAMES) or not set(flags) <= set(FLAGS):
        raise MetricRefused("metric_refused")
    if any(not (v is None and k == "commit_lsn") and (type(v) is not int or (v < 0 and k != "lag")) for k, v in numbers.items()):
        raise MetricRefused("metric_refused")
    if any(v is not None and (not isinstance(v, str) or len(v) > 127 or not v.replace("_", "").replace(".", "").isalnum()) for v in names.values()):
        raise MetricRefused("metric_refused")
    if any(type(v) is not bool for v in flags.values()):
        raise MetricRefused("metric_refused")


class Recorder:
    """Keeps events in the order they were told; `frame` gives them as rows. They are few: some for each batch or chunk, never one for each row."""

    def __init__(self) -> None:
        self.events: list[tuple[str, dict, dict, dict]] = []

    def tell(self, event: str, numbers: Mapping[str, Any] | None = None, names: Mapping[str, Any] | None = None, flags: Mapping[str, Any] | None = None) -> None:
        valid(event, numbers or {}, names or {}, flags)
        self.events.append((event, dict(numbers or {}), dict(names or {}), dict(flags or {})))

    def names(self) -> list[str]:
        return [e[0] for e in self.events]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, SCHEMA)


def allowed(event: Column) -> Column:
    return event.isin(*EVENTS)


def per_transaction(changes: DataFrame, n_bytes: Column, now: Column | None = None) -> DataFrame:
    """transaction.assembled for each commit_lsn: change_count, byte_size and how late it is, never less than nothing. changes: commit_lsn, ts_us."""
    late = F.unix_micros(F.current_timestamp() if now is None else now) - (F.max("ts_us") + F.lit(946_684_800_000_000))
    return changes.groupBy("commit_lsn").agg(F.count("*").alias("change_count"), F.sum(n_bytes).alias("byte_size"), F.greatest(F.lit(0), F.floor(late / 1000)).alias("lag_ms"))


def per_part(changes: DataFrame) -> DataFrame:
    """n_changes by transaction and sub-transaction."""
    return changes.groupBy("xid", "subxid").agg(F.count("*").alias("n_changes"))


def held_bytes(items: DataFrame, ceiling: int, resident: int) -> DataFrame:
    """xid, n_bytes, spilled, exhausted for each open streamed transaction; items: xid, n_bytes.

    The largest go to disk until the rest is within `resident`; the stream is
    exhausted if what went is over `ceiling`. Open transactions are few.
    """
    from pyspark.sql import Window as W

    sums = items.groupBy("xid").agg(F.sum("n_bytes").alias("n_bytes"))
    order = W.orderBy(F.desc("n_bytes"), "xid")
    total = F.sum("n_bytes").over(W.partitionBy(F.lit(1)))
    before = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = sums.withColumn("spilled", total - before > resident)
    gone = F.sum(F.when(F.col("spilled"), F.col("n_bytes")).otherwise(0)).over(W.partitionBy(F.lit(1)))
    return marked.withColumn("exhausted", gone > ceiling)
