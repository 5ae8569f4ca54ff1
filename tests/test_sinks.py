"""Delivery, re-delivery and recovery."""

import pytest

from logtide.streaming.pipeline import Pipeline, run_replay
from logtide.streaming.sinks import AppendLog, Ledger, StateMirror

SCHEMA = "op string, pk long, value string, note string, unchanged array<string>, commit_lsn long, ordinal long"


def changes(spark, rows):
    return spark.createDataFrame([(*row[:4], row[4] if len(row) > 6 else [], *row[-2:]) for row in rows], SCHEMA)


LOG = [
    ("insert", 1, "a", "x", [], 10, 0),
    ("insert", 2, "b", "y", [], 10, 1),
    ("update", 1, "c", None, ["note"], 20, 0),
    ("delete", 2, None, None, [], 30, 0),
    ("update", 3, "d", None, [], 30, 1),
]


def state(sink):
    return sorted(tuple(r) for r in sink.rows().select("pk", "value", "note").collect())


def test_redelivery_changes_nothing(spark, tmp_path):
    sink = StateMirror(spark, str(tmp_path / "m"), ["pk"], ["value", "note"])
    assert sink.checkpoint() is None and sink.rows() is None
    sink.handle_batch(changes(spark, LOG[:3]))
    assert state(sink) == [(1, "c", "x"), (2, "b", "y")] and sink.checkpoint() == 20
    for _ in range(2):
        sink.handle_batch(changes(spark, LOG))
        assert state(sink) == [(1, "c", "x"), (3, "d", None)] and sink.checkpoint() == 30


def test_orphan_data_does_not_count(spark, tmp_path):
    sink = AppendLog(spark, str(tmp_path / "a"))
    sink.handle_batch(changes(spark, LOG[:2]))
    changes(spark, LOG).write.parquet(f"{sink.folder}/data-orphan")
    assert sink.rows().count() == 2


def test_ledger_tells_applied_and_skipped(spark, tmp_path):
    sink = Ledger(spark, str(tmp_path / "l"))
    for part in (LOG[:2], LOG[:2], LOG):
        sink.handle_batch(changes(spark, part))
    assert [c for _, c in sink.calls] == ["applied", "skipped", "applied"]
    assert sink.rows().count() == len(LOG)


def test_snapshot_rows_never_beat_streamed_ones(spark, tmp_path):
    sink = StateMirror(spark, str(tmp_path / "s"), ["pk"], ["value", "note"])
    sink.handle_batch(changes(spark, LOG[:2]))
    sink.handle_snapshot(spark.createDataFrame([(1, "old", "old"), (9, "snap", "z")], "pk long, value string, note string"), "token", True)
    assert state(sink) == [(1, "a", "x"), (2, "b", "y"), (9, "snap", "z")]
    assert sink.snapshot_progress() == "token"
    sink.handle_snapshot_complete(5)
    assert sink.checkpoint() == 10


def test_no_chunk_brings_a_deleted_row_back(spark, tmp_path):
    sink = StateMirror(spark, str(tmp_path / "d"), ["pk"], ["value", "note"], buckets=4)
    chunk = lambda *rows: spark.createDataFrame(rows, "pk long, value string, note string")
    sink.handle_batch(changes(spark, LOG))
    sink.handle_snapshot(chunk((2, "old", "old"), (7, "snap", "z")), "token", lsn=5)
    assert state(sink) == [(1, "c", "x"), (3, "d", None), (7, "snap", "z")]
    assert sorted((r["pk"], r["_origin"], r["_lsn"]) for r in sink.rows(True).collect()) == [(1, "stream", 20), (3, "stream", 30), (7, "snapshot", 5)]
    sink.handle_batch(changes(spark, [("truncate", None, None, None, [], 40, 0), ("insert", 8, "e", "f", [], 40, 1)]))
    sink.handle_snapshot(chunk((9, "old", "old")), "token2", lsn=35)
    assert state(sink) == [(8, "e", "f")] and sink.snapshot_progress() == "token2"
    sink.handle_snapshot(chunk((10, "new", "g")), "token3", lsn=41)
    sink.reset()
    assert state(sink) == [(8, "e", "f")]
    sink.handle_snapshot_complete(41)
    sink.handle_batch(changes(spark, [("delete", 8, None, None, [], 50, 0)]))
    assert state(sink) == [] and sink.checkpoint() == 50


def test_log_of_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(AppendLog, "EVERY", 3)
    sink = AppendLog(spark, str(tmp_path / "many"))
    for n in range(1, 8):
        sink.handle_batch(changes(spark, [("insert", n, "a", "b", [], n * 10, 0)]))
    assert sorted(r["pk"] for r in sink.rows().collect()) == list(range(1, 8))
    for _ in range(2):
        sink.handle_messages(spark.createDataFrame([(5, "p", bytearray(b"c"))], "lsn long, prefix string, content binary"))
    assert sink.messages().count() == 1


def test_two_writers_conflict(spark, tmp_path):
    sink = AppendLog(spark, str(tmp_path / "c"))
    before = sink.manifest.read()
    sink.handle_batch(changes(spark, LOG[:1]))
    with pytest.raises(RuntimeError, match="manifest_conflict"):
        sink.manifest.write(before)


def test_stream_restart(spark, tmp_path):
    folder = str(tmp_path / "log")
    sink = StateMirror(spark, str(tmp_path / "m"), ["pk"], ["value", "note"])
    changes(spark, LOG[:3]).coalesce(1).write.parquet(folder)
    run_replay(spark, folder, SCHEMA, sink, str(tmp_path / "cp"))
    changes(spark, LOG).coalesce(1).write.mode("append").parquet(folder)
    run_replay(spark, folder, SCHEMA, sink, str(tmp_path / "cp")).stop()
    assert state(sink) == [(1, "c", "x"), (3, "d", None)]
    run_replay(spark, folder, SCHEMA, sink, str(tmp_path / "other"))  # all files once more
    assert state(sink) == [(1, "c", "x"), (3, "d", None)]


def test_a_fault_shows_no_value(spark, tmp_path):
    class Bad:
        def handle_batch(self, batch):
            raise KeyError("canary-4711 " + str(batch.first()["value"]))

    with pytest.raises(RuntimeError, match="sink_failed:KeyError") as caught:
        Pipeline(None, Bad(), "x")._deliver(changes(spark, LOG), 0)
    assert "canary" not in str(caught.value) and caught.value.__cause__ is None
