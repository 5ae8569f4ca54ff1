"""Sinks: rows and checkpoint are one atomic step, so that a second delivery changes nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.replay import order_of, replay


class Manifest:
    """One small file in any store that Spark's file systems reach; a rename makes a new version the one.

    One writer at a time is meant to run. A second one is found where the store
    refuses to rename onto a file that is there; other stores need a lock beside it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.folder = folder
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]

    def versions(self) -> list[tuple[int, str]]:
        return sorted((int(n.split("-")[1].split(".")[0]), n) for n in self.names(self.folder) if n.startswith("manifest-") and n.endswith(".json"))

    def load(self, name: str) -> dict[str, Any]:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> dict[str, Any]:
        own = self.versions()
        return self.load(own[-1][1]) if own else {"version": 0, "commit_lsn": None, "progress": None, "data": None, "complete": False}

    def write(self, state: dict[str, Any]) -> None:
        """Fails if another writer made this version first."""
        state = state | {"version": state["version"] + 1}
        part, whole = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifest-{state['version']:012d}.json")
        out = self._fs.create(part, False)
        out.write(json.dumps(state).encode())
        out.close()
        if self._fs.exists(whole) or not self._fs.rename(part, whole):
            raise RuntimeError("manifest_conflict")


class Sink:
    """What a sink may leave out: a destructive change halts, any server and origin is accepted."""

    def handle_schema_change(self, change: dict[str, Any]) -> str:
        return "halt"

    def handle_identity(self, identity: dict[str, Any]) -> bool:
        return True

    def handle_origin(self, lsn: int | None) -> bool:
        return True


def kind_of(sink: Any) -> str:
    """A kind that is not known counts as a state mirror."""
    return "append_log" if getattr(sink, "kind", None) == "append_log" else "state_mirror"


class StateMirror(Sink):
    """The current rows of one table, dealt into buckets by key; a batch rewrites the buckets that it touches.

    Beside each row stand where it came from (`stream` or `snapshot`) and its
    position. Until a backfill is complete, deleted keys and the last truncate
    stay known, so that no older chunk brings a row back.
    """

    kind = "state_mirror"

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], values: Sequence[str], unchanged: str | None = "unchanged", buckets: int = 16):
        self._spark, self.folder, self.keys, self.values, self.unchanged, self.buckets = spark, folder, list(keys), list(values), unchanged, buckets
        self.manifest = Manifest(spark, folder)

    def checkpoint(self) -> int | None:
        return self.manifest.read()["commit_lsn"]

    def snapshot_progress(self) -> str | None:
        return self.manifest.read()["progress"]

    def rows(self, origin: bool = False) -> DataFrame | None:
        """The rows; origin adds _origin and _lsn."""
        state = self.manifest.read()
        if state["data"] is None:
            return None
        return self._held(state, range(self.buckets)).filter("not _gone").select(*self.keys, *self.values, *["_origin", "_lsn"] * origin)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _held(self, state: dict[str, Any], buckets) -> DataFrame:
        paths = [state["data"][str(b)] for b in buckets if str(b) in state["data"]]
        schema = StructType.fromJson(state["schema"])
        return self._spark.read.schema(schema).parquet(*paths) if paths else self._spark.createDataFrame([], schema)

    def _store(self, state: dict[str, Any], rows: DataFrame, touched: list[int], **more: Any) -> None:
        path = f"{self.folder}/data-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        made = {n.split("=")[1]: f"{path}/{n}" for n in self.manifest.names(path) if n.startswith("_bucket=")}
        kept = {b: p for b, p in (state["data"] or {}).items() if int(b) not in touched}
        self.manifest.write(state | {"data": kept | made, "schema": json.loads(rows.schema.json())} | more)

    def handle_batch(self, changes: DataFrame) -> None:
        """Applies all transactions of changes after the checkpoint: op, keys, values, unchanged, commit_lsn, ordinal."""
        state = self.manifest.read()
        fresh = changes if state["commit_lsn"] is None else changes.filter(F.col("commit_lsn") > state["commit_lsn"])
        fresh = fresh.withColumn("_place", order_of()).persist()
        try:
            emptied = F.max(F.when(F.col("op") == "truncate", F.col("commit_lsn")))
            last, emptied, touched = fresh.agg(F.max("commit_lsn"), emptied, F.collect_set(F.when(F.col("op") != "truncate", self._bucket()))).first()
            if last is None:
                return
            touched = list(range(self.buckets)) if emptied is not None else sorted(touched)
            truncates = fresh.filter("op = 'truncate'").select("_place")
            own = fresh.filter("op <> 'truncate'").select("op", "_place", *self.keys, *self.values, *[self.unchanged] * (self.unchanged is not None), F.col("commit_lsn").alias("_lsn"), F.lit("stream").alias("_origin"))
            if state["data"]:
                own = own.unionByName(self._as_changes(self._held(state, touched), own))
            rows = replay(own, self.keys, [*self.values, "_lsn", "_origin"], self.unchanged, truncated=truncates if emptied is not None else None, gone="_gone")
            rows = rows.filter("not _gone") if state["complete"] else rows
            self._store(state, rows, touched, commit_lsn=last, emptied=state.get("emptied") if emptied is None else emptied)
        finally:
            fresh.unpersist()

    handle_transaction = handle_batch

    def _as_changes(self, held: DataFrame, like: DataFrame) -> DataFrame:
        """Rows of the mirror as changes before all others."""
        start = like.schema["_place"].dataType.simpleString()
        place = F.struct(F.lit(-1).cast("long").alias("lsn"), F.lit(-1).cast("long").alias("n"), F.lit(1).alias("half")).cast(start)
        base = held.withColumn("op", F.when(F.col("_gone"), "delete").otherwise("insert")).withColumn("_place", place)
        if self.unchanged is not None:
            base = base.withColumn(self.unchanged, F.array().cast("array<string>"))
        return base.select(*like.columns)

    def handle_snapshot(self, chunk: DataFrame, progress: str, complete: bool = False, lsn: int | None = None) -> None:
        """Adds rows of a chunk, read at lsn, whose keys the mirror does not know: what was streamed wins, deletes too. Progress is stored with them.

        A chunk that is not known to be read after the last truncate is empty.
        """
        state = self.manifest.read()
        emptied = state.get("emptied")
        own = chunk.select(*self.keys, *self.values, F.lit(lsn).cast("long").alias("_lsn"), F.lit("snapshot").alias("_origin"), F.lit(False).alias("_gone"))
        if emptied is not None and (lsn is None or lsn <= emptied):
            own = own.limit(0)
        touched = sorted(b for (b,) in own.select(self._bucket()).distinct().collect())  # at most one for each bucket
        if state["data"]:
            held = self._held(state, touched)
            own = held.unionByName(own.join(held.select(*self.keys), self.keys, "left_anti"))
        self._store(state, own, touched, progress=progress, complete=complete)

    def reset(self) -> None:
        """Takes back what a chunk brought, before a table is read again from its start; what was streamed stays."""
        state = self.manifest.read()
        if state["data"]:
            every = list(range(self.buckets))
            self._store(state, self._held(state, every).filter("_origin = 'stream' or _gone"), every, progress=None, complete=False)

    def handle_snapshot_complete(self, lsn: int) -> None:
        state = self.manifest.read()
        self.manifest.write(state | {"commit_lsn": max(lsn, state["commit_lsn"] or 0), "complete": True})


class AppendLog(Sink):
    """All changes, each once, in a folder for each batch; folders that no manifest names don't count.

    A manifest names its own folder; each `EVERY`-th names all, so that few are read.
    """

    kind = "append_log"
    EVERY = 64

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self.folder, self.manifest = spark, folder, Manifest(spark, folder)

    def checkpoint(self) -> int | None:
        return self.manifest.read()["commit_lsn"]

    def handle_batch(self, changes: DataFrame) -> None:
        state = self.manifest.read()
        fresh = (changes if state["commit_lsn"] is None else changes.filter(F.col("commit_lsn") > state["commit_lsn"])).persist()
        try:
            last = fresh.agg(F.max("commit_lsn")).first()[0]
            if last is None:
                return
            path = f"{self.folder}/data-{uuid.uuid4().hex}"
            fresh.write.parquet(path)
            every = {"every": [*self._folders(), path]} if (state["version"] + 1) % self.EVERY == 0 else {}
            self.manifest.write({k: v for k, v in state.items() if k != "every"} | {"commit_lsn": last, "data": [path]} | every)
        finally:
            fresh.unpersist()

    handle_transaction = handle_batch

    def _folders(self) -> list[str]:
        found: list[str] = []
        for _, name in reversed(self.manifest.versions()):
            state = self.manifest.load(name)
            if "every" in state:
                return [*state["every"], *reversed(found)]
            found += state["data"] or []
        return found[::-1]

    def rows(self) -> DataFrame | None:
        data = self._folders()
        return self._spark.read.parquet(*data) if data else None

    def handle_messages(self, messages: DataFrame) -> None:
        """Standalone messages (lsn, prefix, content): one may come twice, its position tells."""
        messages.select("lsn", "prefix", "content").write.mode("append").parquet(f"{self.folder}/messages")

    def messages(self) -> DataFrame | None:
        there = "messages" in self.manifest.names(self.folder)
        return once(self._spark.read.parquet(f"{self.folder}/messages")) if there else None


class Ledger(AppendLog):
    """An append log of receipts, and of every delivery whether it was applied or skipped."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        self.calls: list[tuple[int | None, str]] = []

    def handle_batch(self, changes: DataFrame) -> None:
        before = self.checkpoint()
        super().handle_batch(receipts(changes))
        after = self.checkpoint()
        self.calls.append((after, "skipped" if after == before else "applied"))

    handle_transaction = handle_batch


def receipts(changes: DataFrame) -> DataFrame:
    """What a ledger keeps of changes: their place and kind, no value."""
    return changes.select("commit_lsn", "op", *(c for c in ("ordinal", "xid", "namespace", "name") if c in changes.columns))


def once(messages: DataFrame) -> DataFrame:
    """Standalone messages come at least once; their position tells them apart."""
    return messages.dropDuplicates(["lsn"])
