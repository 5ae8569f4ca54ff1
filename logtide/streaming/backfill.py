"""Backfill beside the stream: windows, drop-sets, contention, and the reader that goes from chunk to chunk.

Keys that the stream writes count from before a table's first position was
taken until its chunk is applied; a chunk is applied once the stream has passed
the position at which it was read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.assemble import STRETCH
from ..operators.snapshot import drop_written, page
from ..plans.progress import Progress

ATTEMPTS = 3


def frontier(positions: DataFrame) -> DataFrame:
    """positions (seq, lsn) with frontier, the largest lsn so far; no window holds all rows."""
    dealt = positions.withColumn("_stretch", F.floor(F.col("seq") / STRETCH))
    tops = dealt.groupBy("_stretch").agg(F.max("lsn").alias("_top"))
    carried = tops.select("_stretch", F.max("_top").over(W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("lsn").over(W.partitionBy("_stretch").orderBy("seq"))
    return dealt.withColumn("_inside", inside).join(carried, "_stretch").withColumn("frontier", F.greatest("_inside", "_before")).drop("_stretch", "_inside", "_before")


def closed(chunks: DataFrame, reached: Column | int) -> DataFrame:
    """Chunks that the stream has passed: high is at or below what it reached."""
    return chunks.filter(F.col("high") <= reached)


def written_keys(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table, key, known: the keys of all images of a change. A truncate, or a change without a key image, has known false and taints its table."""
    new, old = F.col("record"), F.col("old_record")
    key_of = lambda m: F.when(m.isNotNull(), F.transform(F.array(*(F.lit(k) for k in keys)), lambda k: F.try_element_at(m, k)))
    images = F.when(F.col("op") == "truncate", F.array().cast("array<array<string>>")).when(F.col("op") == "delete", F.array_compact(F.array(key_of(old)))).when(F.col("op") == "update", F.array_compact(F.array(key_of(old), key_of(new)))).otherwise(F.array_compact(F.array(key_of(new))))
    each = changes.select(F.concat_ws(".", "namespace", "name").alias("table"), F.explode_outer(images).alias("key"))
    return each.withColumn("known", F.col("key").isNotNull()).distinct()


def contention(written: DataFrame, keyed: bool, cap: int) -> DataFrame:
    """table, n_keys, reason for tables to be read again: a taint, any write where there is no key, or more keys than the cap."""
    counted = written.groupBy("table").agg(F.count(F.when(F.col("known"), 1)).alias("n_keys"), F.bool_or(~F.col("known")).alias("_taint"))
    reason = F.when(F.col("_taint"), "untrackable").when(F.lit(not keyed), "keyless_write").when(F.col("n_keys") > cap, "drop_cap")
    return counted.select("table", "n_keys", reason.alias("reason")).filter("reason is not null")


class Contended(RuntimeError):
    """A table was read ATTEMPTS times and written each time."""


@dataclass
class Epochs:
    """Tells which run of a reader is the present one: what an older one reports is not heard, and its chunks are gone."""

    present: int = 0
    reached: int = 0
    pending: list[tuple[str, int]] = field(default_factory=list)

    def reset(self) -> int:
        self.present, self.reached, self.pending = self.present + 1, 0, []
        return self.present

    def advance(self, epoch: int, lsn: int) -> int:
        if epoch == self.present:
            self.reached = max(self.reached, lsn)
        return self.reached

    def offer(self, epoch: int, table: str, high: int, most: int) -> str:
        """added, at_capacity, or stale."""
        if epoch != self.present:
            return "stale"
        if len(self.pending) >= most:
            return "at_capacity"
        self.pending.append((table, high))
        return "added"

    def ready(self) -> list[tuple[str, int]]:
        """The leading chunks that the stream has passed; one that is not closed holds back those behind it."""
        out = []
        while self.pending and self.pending[0][1] <= self.reached:
            out.append(self.pending.pop(0))
        return out


def may_open(lag: int, max_inflight: int) -> bool:
    """A new window waits while the stream is behind by more than half of what it may be."""
    return lag <= max_inflight // 2


@dataclass
class Backfill:
    """Reads tables in chunks of key order into sinks.

    read: table to its rows as they are now. keys: table to its key columns, none
    for a keyless table, which is read whole. position: the log's position now.
    catch_up: applies the stream up to a position. written: (table, low, high) to
    the rows (key columns) that the stream wrote there, with a column `known`.
    """

    read: Mapping[str, Callable[[], DataFrame]]
    keys: Mapping[str, Sequence[str]]
    sinks: Mapping[str, Any]
    position: Callable[[], int]
    catch_up: Callable[[int], None]
    written: Callable[[str, int, int], DataFrame]
    rows: int = 1000
    cap: int | None = None
    tell: Callable[..., None] = lambda *_: None

    def run(self, progress: Progress | None = None) -> Progress:
        resumed = progress is not None
        present = list(self.read)
        progress = progress.resume(present) if progress else Progress.new(self.position(), present, [t for t in present if not self.keys[t]])
        self.tell("snapshot.resumed" if resumed else "snapshot.started")
        while not progress.complete:
            progress = progress.next_table()
            progress = self._table(progress.current, progress)
            self.tell("snapshot.table_completed", None, {"table": progress.done[-1]})
        self.tell("snapshot.completed")
        return progress

    def _table(self, table: str, progress: Progress) -> Progress:
        low, tries, keys, sink = self.position(), 1, list(self.keys[table]), self.sinks[table]
        while True:
            rows = self.read[table]()
            kinds = dict(rows.dtypes)
            chunk = (page(rows, keys, self.rows, [_typed(b, kinds[k]) for b, k in zip(progress.bound, keys, strict=True)] if progress.bound else None) if keys else rows).persist()
            try:
                n = chunk.count()
                bound = [str(x) for x in chunk.orderBy(*(F.desc(k) for k in keys)).select(*keys).first()] if keys and n else progress.bound
                high = self.position()
                self.catch_up(high)
                written = self.written(table, low, high).persist()
                reason = self._contended(written, bool(keys))
                if reason:
                    tries += 1
                    if tries > ATTEMPTS:
                        self.tell("snapshot.failed", None, {"table": table, "reason": "snapshot_table_contended"})
                        raise Contended("snapshot_table_contended")
                    self.tell("snapshot.chunk_retried", {"attempt": tries}, {"table": table, "reason": reason})
                    progress, low = progress.redo(), self.position()
                    sink.reset()
                    continue
                last = not keys or n < self.rows
                following = progress.finish() if last else progress.advance(bound)
                kept = drop_written(chunk, written.filter("known"), keys) if keys else chunk
                sink.handle_snapshot(kept, following.encode(), following.complete, high)
                self.tell("snapshot.chunk_completed", {"change_count": n}, {"table": table})
                progress = following
                if last:
                    return progress
            finally:
                chunk.unpersist()

    def _contended(self, written: DataFrame, keyed: bool) -> str | None:
        n, unknown = written.agg(F.count("*"), F.count(F.when(~F.col("known"), 1))).first()
        if unknown:
            return "untrackable"
        if not keyed:
            return "keyless_write" if n else None
        return "drop_cap" if n > (10 * self.rows if self.cap is None else self.cap) else None


def _typed(text: str, kind: str) -> Any:
    return int(text) if kind in ("bigint", "int", "smallint", "tinyint") else float(text) if kind in ("double", "float") else text
