"""Pure rules: positions, identifiers, literals, casts, configuration, progress, metrics."""

import struct

import pytest
from pyspark.sql import functions as F

from logtide.functions import arrays, identifiers, lsn, pgtypes
from logtide.plans import config, connect, progress
from logtide.sources import binary
from logtide.streaming import metrics


class Sink:
    def __init__(self, *names):
        for n in names:
            setattr(self, n, lambda *a: None)


FULL = Sink("handle_transaction", "checkpoint")
BASE = {"slot": "s", "publication": "p", "sink": FULL}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"decoder": "other"}, "config_invalid"),
        ({"tables": ["t"]}, "config_invalid"),
        ({"slot": "S"}, "config_invalid"),
        ({"slot": "s\n"}, "config_invalid"),
        ({"allow_keyless_tables": True}, "config_invalid"),
        ({"go_forward_only": True, "snapshot": True}, "conflicting_start_mode"),
        ({"snapshot": True}, "snapshot_unsupported"),
        ({"snapshot": {"mode": "incremental", "chunk_rows": 0}}, "config_invalid"),
        ({"messages": True}, "messages_unsupported"),
        ({"sink": Sink("checkpoint")}, "invalid_sink"),
        ({"sink": Sink("handle_transaction")}, "invalid_sink"),
        ({"batch_delivery": True}, "batch_unsupported"),
        ({"batch": {}}, "config_invalid"),
        ({"batch_delivery": True, "checkpoint_store": {}}, "config_invalid"),
        ({"max_inflight_lag": 0}, "config_invalid"),
        ({"max_command_retries": -1}, "config_invalid"),
        ({"unknown": 1}, "config_invalid"),
    ],
)
def test_config_refuses(change, reason):
    with pytest.raises(config.ConfigError, match=reason):
        config.from_options(BASE | change)


def test_config_defaults():
    own = config.from_options(BASE | {"publication": ["p", "q", "p"], "streaming": True, "checkpoint_store": {"batch": {}}})
    assert own.table_set == ("p", "q") and own.max_concurrent_txns == 64 and own.max_inflight_lag == 64 << 20
    assert own.batch == {"max_transactions": 100, "max_delay_ms": 1000, "max_span": 16 << 20}
    for decoder, key in (("pglogical", "replication_sets"), ("wal2json", "tables")):
        other = {"slot": "s", "sink": FULL, "decoder": decoder, key: ["t"]}
        assert config.from_options(other).decoder == decoder
        with pytest.raises(config.ConfigError, match="decoder_capability_unsupported"):
            config.from_options(other | {"streaming": True})


def test_start_guard():
    own = config.from_options(BASE)
    with pytest.raises(config.ConfigError, match="go_forward_required"):
        config.guard_start("state_mirror", "empty", own)
    for kind, checkpoint in (("append_log", "empty"), ("state_mirror", "fault"), ("state_mirror", "present")):
        config.guard_start(kind, checkpoint, own)


def test_positions():
    assert lsn.parse("16/B374D848") == 0x16B374D848 and lsn.show(0x16B374D848) == "16/B374D848"
    for bad in ("", "1", "x/1", "1/2/3", "1/123456789", "1/2\n"):
        with pytest.raises(ValueError, match="^invalid_lsn$"):
            lsn.parse(bad)


def test_identifiers():
    assert identifiers.is_identifier("a_1") and identifiers.is_snapshot_name("00000003-00000002-1")
    assert not any(map(identifiers.is_identifier, ("", "1a", "A", "a\n", "a" * 64, "a;", None)))
    assert identifiers.is_option("proto", "1, 2") and not identifiers.is_option("a b", "1") and not identifiers.is_option("a", "x'")


@pytest.mark.parametrize("bad", ["{a,,b}", "not", "", "{", "{a", '{"a', "{a}b}"[:2], "{,a}", "{{1},}", '{a"b"}', '{"a"b}', "{{1}{2}}"])
def test_array_literals_refused(bad):
    with pytest.raises(ValueError):
        arrays.parse_array(bad)


def test_array_literals():
    assert arrays.parse_array('{NULLABLE,NULLs,"NULL",nulls,NULL_FLAG,ordinary}') == ["NULLABLE", "NULLs", "NULL", "nulls", "NULL_FLAG", "ordinary"]
    assert arrays.parse_array('{"a\\"b\\\\c",NULL,{"{}"}}') == ['a"b\\c', None, ["{}"]]
    import time

    for big in ('{"' + "x" * 2_000_000 + '"}', "{" + "x" * 2_000_000 + "}"):
        t = time.time()
        assert len(arrays.parse_array(big)[0]) == 2_000_000
        assert time.time() - t < 0.5


CASTS = [("t", "bool", True), ("false", "bool", False), ("x", "bool", None), ("123", "int4", 123), ("NaN", "numeric", None), ("$1234567.89", "money", 1234567.89), ("$1,234.56", "money", 1234.56), ("-$5.00", "money", -5.0), ("1234,56", "money", None), ("1.234,56 €", "money", None), ("($1,234.56)", "money", None), ("2024-02-30", "date", None), ("1e+20", "float8", 1e20), ("Infinity", "float8", float("inf"))]


@pytest.mark.parametrize(("text", "kind", "want"), CASTS)
def test_casts(spark, text, kind, want):
    got = spark.createDataFrame([(text,)], "t string").select(pgtypes.cast_expr(F.col("t"), kind).alias("v")).first()["v"]
    assert (None if got is None else float(got) if kind in ("money", "numeric") else got) == want


@pytest.mark.parametrize(("text", "kind"), [("canary", "numeric"), ("\\xzz-canary", "bytea"), ("{canary}", "_numeric")])
def test_strict_types_stop_without_the_value(spark, text, kind):
    with pytest.raises(Exception, match="decode_failure") as caught:
        spark.createDataFrame([(text,)], "t string").select(pgtypes.cast_expr(F.col("t"), kind).alias("v")).collect()
    assert "canary" not in str(caught.value).split("JVM stacktrace")[0]


def test_array_casts(spark):
    own = spark.createDataFrame([("{1,NULL,3}", "{t,NULL,f}", '{"$1,234.56","$0.50"}', "{1,x}")], "a string, b string, c string, d string")
    kinds = {"a": "_int4", "b": "_bool", "c": "_money", "d": "_int8"}
    row = pgtypes.cast_columns(own, kinds).first()
    assert (row["a"], row["b"], [float(x) for x in row["c"]], row["d"]) == ([1, None, 3], [True, None, False], [1234.56, 0.5], None)
    assert row["_cast_fallback"] == {"d": "{1,x}"}


def test_every_decision_is_reached():
    seen = {connect.decide(s, c, m, p) for s in ("unpromoted", "invalidated", "absent", "present") for c in ("present", "empty", "fault") for m in ("none", "snapshot", "incremental") for p in ("none", "pending", "in_flight", "complete", "fault")}
    assert seen == {row[4] for row in connect.DECISIONS}


def test_progress():
    own = progress.Progress.new(7, ["k", "a", "b"], keyless=["k"])
    assert own.pending == ("a", "b", "k") and progress.stage(own) == "pending"
    own = own.next_table().advance(["5"])
    assert progress.Progress.decode(own.encode()) == own and progress.stage(own) == "in_flight"
    while not own.complete:
        own = own.finish().next_table()
    assert progress.stage(own) == "complete" and own.tables == {"a", "b", "k"}
    for bad in ("", "[]", "{}", own.encode().replace('"version": 1', '"version": 2'), own.encode().replace("7", '"7"'), "null"):
        with pytest.raises(ValueError, match="^progress_invalid$"):
            progress.Progress.decode(bad)


def test_metrics_let_no_value_through():
    metrics.valid("sink.committed", {"change_count": 3}, {"table": "orders"})
    for args in (("row.value", {}, {}), ("sink.committed", {"x": 1}, {}), ("sink.committed", {"change_count": "canary"}, {}), ("sink.failed", {}, {"reason": "canary value"}), ("sink.failed", {}, {"reason": b"canary"}), ("sink.failed", {"duration": -1}, {})):
        with pytest.raises(ValueError, match="^metric_refused$") as caught:
            metrics.valid(*args)
        assert "canary" not in str(caught.value)


def test_frames():
    relation = binary.encode_relation(5, "public", "t", [("id", 20, True), ("note", 25, False)], "f")
    assert binary.decode_first(relation)["columns"][0] == {"name": "id", "type": "int8", "type_modifier": -1, "is_key": True}
    update = b"U" + struct.pack(">I", 5) + b"K" + binary.encode_tuple(["1", None]) + b"N" + struct.pack(">H", 2) + b"t" + struct.pack(">I", 1) + b"2u"
    got = binary.decode_first(update)
    assert got["old_kind"] == "K" and [c["state"] for c in got["new_tuple"]] == ["v", "u"]
    assert binary.decode_first(b"D" + struct.pack(">I", 5) + b"O" + binary.encode_tuple(["1", "x"]))["old_tuple"][1]["text"] == "x"
    assert binary.decode_first(b"C\0" + struct.pack(">QQq", 1, 2, 3))["end_lsn"] == 2
    assert binary.decode_first(b"c" + struct.pack(">I", 9) + b"\0" + struct.pack(">QQq", 1, 2, 3))["xid"] == 9
    assert binary.decode_second(b"S\1min_proto_version\0001\0max_proto_version\0001\0")["kind"] == "startup"
    with pytest.raises(binary.Malformed, match="decoder_protocol_unsupported"):
        binary.decode_second(b"S\1min_proto_version\0002\0max_proto_version\0003\0")
    for i in range(len(update)):
        with pytest.raises(binary.Malformed):
            binary.decode_first(update[:i] if i else b"")
    with pytest.raises(binary.Malformed):
        binary.decode_first(update + b"x")
