"""From a configuration to a running stream: frames, decoder, assembly, sink, checkpoint, telemetry.

A micro-batch is its frames and the open tail of the one before. What committed
is handed to the sink, which stores rows and position in one step; then the new
tail is stored. If the tail is not stored, the batch comes again and the
position keeps it from counting twice. A fault halts for good, behind what
committed before it, and shows no value.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import schema_change, transactions
from ..operators.assemble import after_checkpoint
from ..plans.config import Config, guard_start
from ..plans.session import SessionIdentity
from ..sources import binary, wal2json
from ..sources.frames import FRAMES, stream_frames
from .metrics import Recorder
from .pipeline import guard_streams, idle_position
from .sinks import Manifest, kind_of


class Halt(RuntimeError):
    """Its text is a reason from a closed set."""


class Replication:
    """frames: a folder of frame files. state: a folder for the tail. of_sink turns assembled changes into what the sink takes; by default they pass as they are."""

    def __init__(self, spark: SparkSession, config: Config, frames: str, state: str, of_sink: Callable[[DataFrame], DataFrame] = lambda c: c, catalog: DataFrame | None = None):
        guard_start(kind_of(config.sink), "empty" if config.sink.checkpoint() is None else "present", config)
        self._spark, self.config, self._frames, self._of_sink, self._catalog = spark, config, frames, of_sink, catalog
        self.state, self.told = Manifest(spark, state), Recorder()
        self.query: StreamingQuery | None = None
        self.halted: str | None = None

    def identify(self, identity: SessionIdentity) -> None:
        """Refuses a server that is not the one before, or that the sink does not want."""
        known = self.state.read().get("identity")
        fits = known is None or (known["system_identifier"], known["database"]) == (identity.system_identifier, identity.database)
        accepts = getattr(self.config.sink, "handle_identity", lambda _: True)
        if not fits or accepts({"system_identifier": identity.system_identifier, "timeline": identity.timeline, "database": identity.database}) is not True:
            self.told.tell("connection.session_identity_rejected", None, {"slot_name": self.config.slot})
            self._halt("session_identity_rejected")
        self.state.write(self.state.read() | {"identity": {"system_identifier": identity.system_identifier, "database": identity.database}})
        self.told.tell("connection.connected", None, {"slot_name": self.config.slot})

    def start(self, available_now: bool = False) -> StreamingQuery:
        self.told.tell("connection.slot_active", None, {"slot_name": self.config.slot})
        writer = stream_frames(self._spark, self._frames).writeStream.foreachBatch(lambda df, _: self.deliver(df)).option("checkpointLocation", f"{self.state.folder}/offsets")
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()
            self.told.tell("connection.disconnected", None, {"slot_name": self.config.slot})

    def _halt(self, reason: str) -> None:
        self.halted = reason
        self.told.tell("pipeline.halted", None, {"reason": reason})
        raise Halt(reason) from None

    def _messages(self, frames: DataFrame) -> DataFrame:
        if self.config.decoder == "wal2json":
            decoded = wal2json.decode(frames)
            return wal2json.as_messages(decoded, wal2json.inferred_relations(decoded, self._catalog))
        messages = binary.decode(transactions.in_segments(frames), self.config.decoder)
        return messages if self._catalog is None or self.config.decoder != "pglogical" else binary.enrich(messages, self._catalog)

    def _drift(self, messages: DataFrame, several: bool) -> DataFrame:
        """Halts at changes of relations that the sink does not go along with. Announcements are few: they are read on the driver."""
        versions = messages.filter("kind = 'relation'").select("seq", "relid", "namespace", "name", F.col("replica_identity").alias("identity"), "columns")
        rows = schema_change.classify(versions).collect() if several else []
        stops = []
        for row in rows:
            if row["kind"] == "additive":
                self.told.tell("schema_change.additive", None, {"kind": row["change"]})
            elif self.config.sink.handle_schema_change({"change": row["change"], "detail": row["detail"]}) != "continue" if hasattr(self.config.sink, "handle_schema_change") else True:
                self.told.tell("schema_change.halted", None, {"kind": row["change"]})
                stops.append((row["seq"], "schema_change"))
        return self._spark.createDataFrame(stops, "seq long, reason string")

    def deliver(self, batch: DataFrame) -> None:
        state, sink = self.state.read(), self.config.sink
        held = [self._spark.read.schema(FRAMES).parquet(state["tail"])] if state.get("tail") else []
        frames = batch.select("seq", "wal_end", "kind", "payload", "in_stream")
        for tail in held:
            frames = frames.unionByName(tail).dropDuplicates(["seq"])
        frames = frames.persist()
        messages = self._messages(frames).persist()
        kept = [frames, messages]

        def hold(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        try:
            times = lambda of: F.count(F.when(F.expr(of), 1))
            starts, aborted, announced, told = messages.agg(times("kind = 'stream_start'"), times("kind = 'stream_abort' and xid = subxid"), times("kind = 'relation'"), times("kind = 'message' and not transactional")).first()
            if starts and self.config.max_concurrent_txns:
                turn = F.when(F.col("kind") == "stream_start", "start").when(F.col("kind") == "stream_commit", "commit").when(F.col("kind") == "stream_abort", "abort").otherwise("other")
                try:
                    guard_streams(messages.select("seq", turn.alias("kind"), "xid", "subxid"), self.config.max_concurrent_txns)
                except RuntimeError:
                    self._halt("too_many_streams")
            assembled = transactions.assemble(messages, self._drift(messages, announced > 1), hold)
            self._apply(assembled, sink, aborted, told)
            reason = assembled.halts.agg(F.min_by("reason", "seq")).first()[0]
            if reason is not None:
                self._halt(reason)
            path = f"{self.state.folder}/tail-{uuid.uuid4().hex}"
            if self.config.decoder != "wal2json":
                transactions.open_tail(frames, messages, assembled).write.parquet(path)
            else:
                path = None
            self.state.write(self.state.read() | {"tail": path})
        finally:
            for df in reversed(kept):
                df.unpersist()

    def _apply(self, assembled: transactions.Assembled, sink: Any, aborted: int, told: int) -> None:
        before = sink.checkpoint()
        changes = after_checkpoint(assembled.changes, before)
        n, n_changes, streamed = after_checkpoint(transactions.delivered(assembled.transactions), before).agg(F.count("*"), F.sum("n_changes"), F.count(F.when(F.col("streamed"), 1))).first()
        if aborted:
            self.told.tell("stream.aborted", None, {"reason": "stream_abort"})
        if n:
            self.told.tell("transaction.assembled", {"change_count": int(n_changes or 0)})
            began = time.monotonic()
            try:
                sink.handle_batch(self._of_sink(changes))
            except Exception as error:
                self.told.tell("sink.failed", None, {"error_class": type(error).__name__})
                self._halt("sink_failed")
            took = int((time.monotonic() - began) * 1000)
            after = sink.checkpoint()
            self.told.tell("sink.batch_committed", {"duration": took, "change_count": int(n_changes or 0)})
            self.told.tell("sink.committed", {"duration": took, "commit_lsn": after})
            if streamed:
                self.told.tell("stream.committed", {"commit_lsn": after})
            if after != before:
                self.told.tell("checkpoint.advanced", {"commit_lsn": after})
        if told and self.config.messages and hasattr(sink, "handle_messages"):
            sink.handle_messages(assembled.standalone)
            self.told.tell("message.received", None, None, {"transactional": False})

    def idle(self, frames: DataFrame) -> int | None:
        """Where the checkpoint may go over what the stream filtered away. frames: seq, kind (k, begin, commit), wal_end."""
        return idle_position(frames, kind_of(self.config.sink), self.config.sink.checkpoint())
