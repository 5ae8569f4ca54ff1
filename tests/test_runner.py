"""From configuration to sink: batches, open transactions, restarts, halts; and a backfill beside the stream."""

import pytest
from pyspark.sql import functions as F

from logtide import framed
from logtide.plans import config
from logtide.plans.progress import Progress
from logtide.plans.session import SessionIdentity
from logtide.sources import binary
from logtide.sources.frames import FRAMES
from logtide.streaming.backfill import Backfill, Contended, Epochs, contention, may_open, written_keys
from logtide.streaming.runner import Halt, Replication
from logtide.streaming.sinks import AppendLog, StateMirror

from .test_queries import SF_DIR


def of_table(changes):
    get = lambda m, c: F.try_element_at(m, F.lit(c))
    own = changes.filter("relid = 1")
    return own.select("op", F.coalesce(get("record", "pk"), get("old_record", "pk")).alias("pk"), get("record", "cents").alias("cents"), get("record", "props").alias("props"), "unchanged", "commit_lsn", "ordinal")


def options(sink, **more):
    return config.from_options({"slot": "s", "publication": "p", "sink": sink, "go_forward_only": True, "streaming": True} | more)


def frames(spark, items):
    return spark.createDataFrame([(seq, seq * 10, "w", bytearray(data), False) for seq, data in items], FRAMES)


REL = binary.encode_relation(1, "public", "t", [("pk", 20, True), ("cents", 20, False), ("props", 25, False)])
row = lambda mark, new, old=None, sub=None: binary.encode_row(mark, 1, new, old, subxid=sub)
LOG = [
    (0, REL),
    (1, binary.encode_stream_start(7)), (2, row(b"I", ["1", "10", "a"], sub=70)), (3, row(b"I", ["9", "90", "x"], sub=71)), (4, b"E"),
    (5, binary.encode_begin(60, 0, 8)), (6, row(b"I", ["2", "20", "b"])), (7, binary.encode_message(6, "p", b"m", False)), (8, binary.encode_commit(80, 81, 0)),
    (9, binary.encode_stream_start(7, False)), (10, row(b"U", ["1", "11", binary.UNCHANGED], sub=70)), (11, b"E"),
    (12, binary.encode_stream_abort(7, 71)), (13, binary.encode_stream_commit(7, 130, 131, 0)),
    (14, binary.encode_begin(160, 0, 9)), (15, row(b"D", None, ["2", None, None])), (16, binary.encode_commit(160, 161, 0)),
]
END = [("1", "11", "a")]


@pytest.mark.parametrize("cuts", [(17,), (3, 10, 17)])
def test_open_transactions_cross_batches(spark, tmp_path, cuts):
    sink = StateMirror(spark, str(tmp_path / "m"), ["pk"], ["cents", "props"], buckets=2)
    log = AppendLog(spark, str(tmp_path / "l"))
    sink.handle_message = sink.handle_messages = lambda m: log.handle_messages(m)
    run = Replication(spark, options(sink, messages=True), str(tmp_path / "f"), str(tmp_path / "s"), of_table)
    at = 0
    for cut in cuts:
        run.deliver(frames(spark, LOG[at:cut]))
        at = cut
    assert sorted(map(tuple, sink.rows().collect())) == END and sink.checkpoint() == 160
    assert [r["prefix"] for r in log.messages().collect()] == ["p"]
    assert {"transaction.assembled", "sink.committed", "checkpoint.advanced", "stream.committed", "message.received"} <= set(run.told.names())
    assert run.told.frame(spark).count() == len(run.told.events)


def test_stream_from_files_and_once_more(spark, tmp_path):
    folder = str(tmp_path / "f")
    framed.frames(spark, SF_DIR).repartition(1).sortWithinPartitions("seq").write.parquet(folder)
    sink = StateMirror(spark, str(tmp_path / "m"), ["pk"], ["cents", "props"], buckets=2)
    moved = lambda c: framed_changes(c)
    for state in ("s1", "s2"):
        run = Replication(spark, options(sink), folder, str(tmp_path / state), moved)
        run.start(available_now=True).awaitTermination()
    want = framed.state_of(framed.assembled(spark, SF_DIR).changes, "pk", ["cents", "props"], 1)
    assert sorted(map(str, sink.rows().collect())) == sorted(map(str, want.collect()))


def framed_changes(changes):
    """A key change as the delete and the insert that a mirror by key takes; ordinals leave room between."""
    own = of_table(changes).withColumn("ordinal", F.col("ordinal") * 2 + 1)
    old = F.try_element_at("old_record", F.lit("pk"))
    gone = changes.filter("relid = 1 and op = 'update'").filter(old != F.try_element_at("record", F.lit("pk")))
    return own.unionByName(gone.select(F.lit("delete").alias("op"), old.alias("pk"), F.lit(None).cast("string").alias("cents"), F.lit(None).cast("string").alias("props"), "unchanged", "commit_lsn", (F.col("ordinal") * 2).alias("ordinal")))


@pytest.mark.parametrize(
    ("bad", "reason"),
    [
        ((14, row(b"I", ["5", "5", "canary"])), "config_invalid"),
        ((14, b"?canary"), "unsupported_message"),
        ((14, binary.encode_stream_commit(99, 1, 1, 0)), "config_invalid"),
        ((14, binary.encode_relation(1, "public", "t", [("pk", 20, True)])), "schema_change"),
    ],
)
def test_a_fault_halts_behind_what_committed(spark, tmp_path, bad, reason):
    sink = StateMirror(spark, str(tmp_path / "m"), ["pk"], ["cents", "props"], buckets=2)
    run = Replication(spark, options(sink), str(tmp_path / "f"), str(tmp_path / "s"), of_table)
    late = [(seq + 10, data) for seq, data in LOG[14:]]
    with pytest.raises(Halt) as caught:
        run.deliver(frames(spark, [*LOG[:14], bad, *late]))
    assert str(caught.value) == reason == run.halted and caught.value.__cause__ is None
    assert sorted(r["pk"] for r in sink.rows().collect()) == ["1", "2"] and sink.checkpoint() == 130


def test_identity_and_streams(spark, tmp_path):
    sink = StateMirror(spark, str(tmp_path / "m"), ["pk"], ["cents", "props"], buckets=2)
    run = Replication(spark, options(sink, streaming={"max_concurrent_txns": 1}), str(tmp_path / "f"), str(tmp_path / "s"), of_table)
    run.identify(SessionIdentity.of("77", "1", "0/10", "db"))
    run.identify(SessionIdentity.of("77", 2, "0/20", "db"))
    with pytest.raises(Halt, match="session_identity_rejected"):
        run.identify(SessionIdentity.of("78", 2, "0/20", "db"))
    with pytest.raises(Halt, match="too_many_streams"):
        run.deliver(frames(spark, [(1, binary.encode_stream_start(1)), (2, b"E"), (3, binary.encode_stream_start(2)), (4, b"E")]))
    for odd in (("x", 1, "0/1", "d"), ("1", -1, "0/1", "d"), ("1", 1, "zz", "d"), ("1", 1, "0/1", "")):
        with pytest.raises(ValueError, match="^invalid_session_identity$"):
            SessionIdentity.of(*odd)


class Server:
    """A table of ten rows whose writes happen while chunks are read."""

    def __init__(self, spark, sink, writes):
        self.spark, self.sink, self.lsn, self.rows, self.writes, self.done = spark, sink, 100, {i: f"v{i}" for i in range(10)}, list(writes), []

    def read(self):
        out = self.spark.createDataFrame(sorted(self.rows.items()), "pk long, value string")
        if self.writes:
            op, pk, value = self.writes.pop(0)
            self.lsn += 10
            self.done.append((op, pk, value, [], self.lsn, 0))
            self.rows.pop(pk, None) if op == "delete" else self.rows.__setitem__(pk, value)
        return out

    def catch_up(self, high):
        own = [d for d in self.done if d[4] <= high]
        if own:
            self.sink.handle_batch(self.spark.createDataFrame(own, "op string, pk long, value string, unchanged array<string>, commit_lsn long, ordinal long"))

    def written(self, table, low, high):
        return self.spark.createDataFrame([(d[1], True) for d in self.done if low < d[4] <= high], "pk long, known boolean").distinct()


def test_backfill_converges(spark, tmp_path):
    sink = StateMirror(spark, str(tmp_path / "m"), ["pk"], ["value"], buckets=2)
    server = Server(spark, sink, [("delete", 1, None), ("update", 8, "new"), ("insert", 11, "more")])
    told = []
    fill = Backfill({"t": server.read}, {"t": ["pk"]}, {"t": sink}, lambda: server.lsn, server.catch_up, server.written, rows=4, tell=lambda event, *_: told.append(event))
    progress = fill.run()
    assert progress.complete and sorted(map(tuple, sink.rows().collect())) == sorted(server.rows.items())
    assert Progress.decode(sink.snapshot_progress()).complete
    assert told[0] == "snapshot.started" and told[-1] == "snapshot.completed" and told.count("snapshot.chunk_completed") == 3


def test_contention_is_read_again_and_then_given_up(spark, tmp_path):
    for n, fails in ((2, False), (5, True)):
        sink = StateMirror(spark, str(tmp_path / f"m{n}"), ["pk"], ["value"], buckets=2)
        server = Server(spark, sink, [("update", 1, str(i)) for i in range(n)])
        fill = Backfill({"t": server.read}, {"t": []}, {"t": sink}, lambda: server.lsn, server.catch_up, server.written)
        if fails:
            with pytest.raises(Contended, match="^snapshot_table_contended$"):
                fill.run()
        else:
            fill.run()
            assert sorted(map(tuple, sink.rows().collect())) == sorted(server.rows.items())


def test_window_rules(spark):
    schema = "op string, namespace string, name string, record map<string,string>, old_record map<string,string>"
    own = spark.createDataFrame([("insert", "a", "t", {"k": "1"}, None), ("update", "a", "t", {"k": "3"}, {"k": "2"}), ("delete", "a", "u", None, {"k": "4"}), ("truncate", "a", "v", None, None), ("delete", "a", "w", None, None)], schema)
    keys = written_keys(own, ["k"])
    assert sorted((r["table"], tuple(r["key"] or ())) for r in keys.collect()) == [("a.t", ("1",)), ("a.t", ("2",)), ("a.t", ("3",)), ("a.u", ("4",)), ("a.v", ()), ("a.w", ())]
    found = lambda keyed, cap: {r["table"]: r["reason"] for r in contention(keys, keyed, cap).collect()}
    assert found(True, 2) == {"a.t": "drop_cap", "a.v": "untrackable", "a.w": "untrackable"}
    assert found(False, 2) == {"a.t": "keyless_write", "a.u": "keyless_write", "a.v": "untrackable", "a.w": "untrackable"}
    epochs = Epochs()
    first = epochs.reset()
    assert epochs.offer(first, "t", 10, 2) == "added" and epochs.offer(first, "t", 20, 2) == "added" and epochs.offer(first, "t", 30, 2) == "at_capacity"
    epochs.advance(first, 15)
    assert epochs.ready() == [("t", 10)]
    epochs.reset()
    assert epochs.advance(first, 99) == 0 and epochs.offer(first, "t", 1, 2) == "stale" and epochs.ready() == []
    assert may_open(50, 100) and not may_open(51, 100)
