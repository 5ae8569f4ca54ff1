"""Odd frames, arrays of several dimensions, the JSON format from frames to a mirror, and what is said to a server."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from logtide.functions import pgtypes
from logtide.operators import transactions
from logtide.plans import config, session
from logtide.plans.connect import Watchdog, origin
from logtide.sources import binary, wal2json
from logtide.sources.frames import FRAMES
from logtide.streaming.runner import Replication
from logtide.streaming.sinks import AppendLog, kind_of


def frames(spark, payloads, in_stream=False):
    return spark.createDataFrame([(i, i, "w", bytearray(p), in_stream) for i, p in enumerate(payloads)], FRAMES)


def test_odd_startup_and_positions_are_rows(spark):
    startup = lambda *pairs: b"S\1" + b"".join(x.encode() + b"\0" for x in pairs)
    got = binary.decode(frames(spark, [startup("min_proto_version", "abc"), startup("min_proto_version", "2"), startup("max_proto_version", "1"), b"B\0" + struct.pack(">QqI", 1 << 63, 0, 1)]), "pglogical")
    assert [(r["kind"], r["reason"]) for r in got.orderBy("seq").collect()] == [("ERROR", "decoder_protocol_unsupported"), ("ERROR", "decoder_protocol_unsupported"), ("startup", None), ("ERROR", "decode_failure")]
    got = binary.decode(frames(spark, [binary.encode_begin((1 << 63) + 5, 0, 1)]), "pgoutput").first()
    assert (got["kind"], got["reason"]) == ("ERROR", "decode_failure")


@pytest.mark.parametrize("second", [False, True])
def test_updates_deletes_nulls_and_unsent_values(spark, second):
    own = [
        binary.encode_relation(1, "a", "t", [("k", 20, True), ("v", 25, False)], second=second),
        binary.encode_row(b"I", 1, ["1", None], second=second),
        binary.encode_row(b"U", 1, ["2", binary.UNCHANGED], ["1", None], second=second),
        binary.encode_row(b"D", 1, None, ["2", None], second=second),
    ]
    begin, commit = binary.encode_begin(9, 0, 5, second), (b"C\0" + struct.pack(">QQq", 9, 10, 0))
    messages = binary.decode(frames(spark, [own[0], begin, *own[1:], commit]), "pglogical" if second else "pgoutput")
    got = transactions.assemble(messages)
    rows = [(r["ordinal"], r["op"], r["record"], r["old_record"], r["unchanged"]) for r in got.changes.orderBy("ordinal").collect()]
    assert rows == [(0, "insert", {"k": "1", "v": None}, None, []), (1, "update", {"k": "2"}, {"k": "1"}, ["v"]), (2, "delete", None, {"k": "2"}, [])]
    assert got.halts.count() == 0 and got.transactions.first()["commit_lsn"] == 9


def test_arrays_of_two_dimensions(spark):
    own = spark.createDataFrame([("{{1,2},{3,4}}",), ("{1,2}",), ("{{1,NULL},{3,x}}",), (None,), ("{}",)], "t string")
    col = F.col("t")
    got = own.select(pgtypes.cast_expr(col, "_float8:2").alias("two"), pgtypes.cast_expr(col, "_float8").alias("one"), pgtypes.cast_expr(F.when(~col.contains("x"), col), "_numeric").alias("strict")).collect()
    assert [r["two"] for r in got] == [[[1.0, 2.0], [3.0, 4.0]], None, None, None, None]
    assert [r["one"] for r in got] == [None, [1.0, 2.0], None, None, []]
    assert [None if r["strict"] is None else [float(x) for x in r["strict"]] for r in got] == [None, [1.0, 2.0], None, None, []]
    with pytest.raises(Exception, match="decode_failure") as caught:
        spark.createDataFrame([("{canary}",)], "t string").select(pgtypes.cast_expr(col, "_numeric")).collect()
    assert "{canary}" not in str(caught.value)


def document(action, **more):
    return json.dumps({"action": action, "xid": 5, **more}).encode()


def values(**own):
    return [{"name": k, "type": "text", "value": v} for k, v in own.items()]


def test_a_json_number_is_an_error_row(spark):
    got = wal2json.decode(frames(spark, [document("I", schema="a", table="t", columns=[{"name": "n", "type": "int4", "value": 4711}]), b"{", document("Z")]))
    assert [(r["kind"], r["reason"]) for r in got.orderBy("seq").collect()] == [("ERROR", "decode_failure"), ("ERROR", "decode_failure"), ("ERROR", "unsupported_message")]


def test_json_frames_to_a_sink(spark, tmp_path):
    table = {"schema": "a", "table": "t"}
    log = [
        document("B", lsn="0/10", nextlsn="0/11"),
        document("I", **table, columns=values(k="1", v="x")),
        document("U", **table, columns=values(k="1"), identity=values(k="1")),
        document("I", **table, columns=values(k="2", v=None, more="m")),
        document("D", **table, identity=values(k="2")),
        document("C", lsn="0/20", nextlsn="0/21"),
    ]
    decoded = wal2json.decode(frames(spark, log))
    catalog = spark.createDataFrame([("a", "t", "default", ["k"])], "namespace string, name string, identity string, keys array<string>")
    relations = wal2json.inferred_relations(decoded, catalog).orderBy("seq").collect()
    assert [(r["seq"], [(c["name"], c["is_key"]) for c in r["columns"]]) for r in relations] == [(1, [("k", True), ("v", False)]), (3, [("k", True), ("v", False), ("more", False)])]
    now = spark.createDataFrame([("a", "t", ["k", "v", "other"])], "namespace string, name string, columns array<string>")
    drift = wal2json.drift(wal2json.inferred_relations(decoded, catalog), now).first()
    assert drift["missing"] == ["more"] and drift["added"] == ["other"]
    sink = AppendLog(spark, str(tmp_path / "l"))
    own = config.from_options({"slot": "s", "decoder": "wal2json", "tables": "a.t", "sink": sink})
    Replication(spark, own, str(tmp_path / "f"), str(tmp_path / "s"), catalog=catalog).deliver(frames(spark, log))
    rows = [(r["ordinal"], r["op"], r["record"], r["old_record"], r["unchanged"]) for r in sink.rows().orderBy("ordinal").collect()]
    assert rows == [
        (0, "insert", {"k": "1", "v": "x"}, None, []),
        (1, "update", {"k": "1"}, None, ["v"]),
        (2, "insert", {"k": "2", "v": None, "more": "m"}, None, []),
        (3, "delete", None, {"k": "2"}, []),
    ]
    assert sink.checkpoint() == 0x20


def test_what_is_said_to_a_server(spark):
    told = session.publication_options(["p", "q"], streaming=True, messages=True)
    assert session.start_command("s", 0x100000010, told) == "START_REPLICATION SLOT s LOGICAL 1/10 (proto_version '2', streaming 'on', publication_names 'p,q', messages 'true')"
    assert session.slot_command("s") == "CREATE_REPLICATION_SLOT s LOGICAL pgoutput NOEXPORT_SNAPSHOT;"
    assert session.slot_command("s", export=True, failover=True).endswith("(FAILOVER, SNAPSHOT 'export');")
    assert session.slot_command("s", version=140000).endswith("pgoutput;")
    assert session.adopt_snapshot("00000003-1B") == "SET TRANSACTION SNAPSHOT '00000003-1B'"
    for bad in (lambda: session.slot_command("s; drop"), lambda: session.start_command("s", -1, {}), lambda: session.start_command("s", 1, {"k": "v'"}), lambda: session.adopt_snapshot("x'y")):
        with pytest.raises(ValueError, match="^invalid_"):
            bad()
    update = session.status_update(7, session.EPOCH_US + 9)
    assert len(update) == 34 and struct.unpack(">QQQqB", update[1:]) == (7, 7, 7, 9, 0)
    got = spark.createDataFrame([("t", "12"), ("f", "x"), (None, None)], "b string, i string").select(session.text_bool(F.col("b")), session.text_int(F.col("i"))).collect()
    assert list(map(tuple, got)) == [(True, 12), (False, None), (None, None)]
    dog = Watchdog(2)
    assert [dog.error() for _ in range(3)] == ["reconnect", "reconnect", "halt:command_error"]
    dog.frame()
    assert dog.error() == "reconnect" and origin(5, 9) == 9 and origin(None, None) is None
    assert kind_of(object()) == "state_mirror"
