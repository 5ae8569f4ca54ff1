"""All registered queries of the engine with their SQL."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, lsn, pgtypes
from .functions.identifiers import valid_identifier
from .operators import assemble, publication, records, schema_change, snapshot, transactions
from .operators.replay import order_of, replay, split_key_changes
from .plans import connect, progress
from .sources import binary, wal2json
from .sources.frames import FRAMES
from .streaming import metrics, pipeline, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The change log that the events table stands for


CHECKPOINT = 40_960
_LOG = {
    "xid": "cast(floor(event_id / 8.0) as bigint)",
    "ordinal": "event_id % 8",
    "commit_lsn": "(cast(floor(event_id / 8.0) as bigint) + 1) * 4096",
    "subxid": "cast(floor(event_id / 8.0) as bigint) * 10 + cast(floor((event_id % 8) / 3.0) as bigint)",
    "op": "case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end",
    "pk": "user_id",
    "value": "value",
    "props": "props",
    "sentinel": "event_type not in ('signup', 'error') and event_id % 3 = 0",
    "pk_change": "event_type not in ('signup', 'error') and event_id % 97 = 0",
}
LOG_SQL = "WITH log AS (SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in _LOG.items()) + " FROM events), live AS (SELECT * FROM log WHERE xid % 17 <> 0)"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").selectExpr("event_id", *(f"{e} as {n}" for n, e in _LOG.items()))
    return log.withColumn("unchanged", F.when(F.col("sentinel"), F.array(F.lit("props"))).otherwise(F.array().cast("array<string>")))


def aborts(log: DataFrame, sub: bool) -> DataFrame:
    whole = log.filter("xid % 17 = 0").select("xid", F.col("xid").alias("subxid")).distinct()
    parts = log.filter("xid % 17 <> 0 and xid % 5 = 0 and subxid % 10 = 1").select("xid", "subxid").distinct()
    return whole.unionByName(parts) if sub else whole


def mirror(changes: DataFrame) -> DataFrame:
    return replay(changes.withColumn("_place", order_of()), ["pk"], ["value", "props"], "unchanged")


_LAST = """, ord AS (SELECT *, commit_lsn * 16 + ordinal * 2 + 1 AS o FROM {source}),
r AS (SELECT pk, arg_max(op, o) AS last_op, max(CASE WHEN op IN ('insert', 'delete') THEN o END) AS reset FROM ord GROUP BY pk),
seg AS (SELECT ord.* FROM ord JOIN r USING (pk) WHERE last_op <> 'delete' AND op <> 'delete' AND (reset IS NULL OR o >= reset))
SELECT pk, arg_max_null(value, o) AS value, arg_max_null(props, o) FILTER (WHERE NOT sentinel) AS props FROM seg GROUP BY pk"""


@registered(LOG_SQL + _LAST.format(source="(SELECT * FROM live WHERE commit_lsn > 40960)"))
def replay_events_mirror(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return mirror(assemble.after_checkpoint(assemble.drop_aborted(log, aborts(log, False)), CHECKPOINT))


@registered(LOG_SQL + ", kept AS (SELECT * FROM live WHERE NOT (xid % 5 = 0 AND subxid % 10 = 1))" + _LAST.format(source="kept"))
def replay_sentinel(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return mirror(assemble.drop_aborted(log, aborts(log, True)))


_MOVED = """, ch AS (SELECT *, CASE WHEN pk_change THEN pk + 100000 ELSE pk END AS npk FROM live),
both_ AS (SELECT npk AS pk, op, value, props, sentinel, commit_lsn * 16 + ordinal * 2 + 1 AS o FROM ch
 UNION ALL SELECT pk, 'delete', value, props, sentinel, commit_lsn * 16 + ordinal * 2 FROM ch WHERE pk_change),
r AS (SELECT pk, arg_max(op, o) AS last_op, max(CASE WHEN op IN ('insert', 'delete') THEN o END) AS reset FROM both_ GROUP BY pk),
seg AS (SELECT b.* FROM both_ b JOIN r USING (pk) WHERE last_op <> 'delete' AND op <> 'delete' AND (reset IS NULL OR o >= reset))
SELECT pk, arg_max_null(value, o) AS value, arg_max_null(props, o) FILTER (WHERE NOT sentinel) AS props FROM seg GROUP BY pk"""


@registered(LOG_SQL + _MOVED)
def replay_pk_change(spark, sf_dir):
    log = change_log(spark, sf_dir)
    live = assemble.drop_aborted(log, aborts(log, False))
    moved = live.withColumn("old_pk", F.col("pk")).withColumn("pk", F.when(F.col("pk_change"), F.col("pk") + 100_000).otherwise(F.col("pk")))
    changes = split_key_changes(moved.withColumn("_place", order_of()), "pk", "old_pk")
    return replay(changes, ["pk"], ["value", "props"], "unchanged")


@registered(LOG_SQL + ", t AS (SELECT max(commit_lsn * 16) AS cut_at FROM live WHERE xid % 211 = 0), kept AS (SELECT live.* FROM live, t WHERE cut_at IS NULL OR commit_lsn * 16 + ordinal * 2 + 1 > cut_at)" + _LAST.format(source="kept"))
def replay_delete_truncate(spark, sf_dir):
    log = change_log(spark, sf_dir)
    live = assemble.drop_aborted(log, aborts(log, False)).withColumn("_place", order_of())
    emptied = live.filter("xid % 211 = 0").select(F.struct(F.col("commit_lsn").alias("lsn"), F.lit(-1).cast("long").alias("n"), F.lit(1).alias("half")).alias("_place"))
    return replay(live, ["pk"], ["value", "props"], "unchanged", truncated=emptied)


# Transactions


@registered(LOG_SQL + " SELECT commit_lsn, count(*) AS n_changes, 0 AS n_messages FROM live GROUP BY commit_lsn")
def assemble_transactions(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return assemble.transactions(assemble.drop_aborted(log, aborts(log, False)))


@registered(LOG_SQL + " SELECT commit_lsn, ordinal, subxid, op, pk FROM live WHERE NOT (xid % 5 = 0 AND subxid % 10 = 1)")
def assemble_streamed_subabort(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return assemble.drop_aborted(log, aborts(log, True)).select("commit_lsn", "ordinal", "subxid", "op", "pk")


@registered(LOG_SQL + " SELECT commit_lsn, count(*) AS change_count, sum(length(props)) AS byte_size, greatest(0, 5000 - max(event_id)) AS lag_ms FROM live GROUP BY commit_lsn")
def transaction_metrics(spark, sf_dir):
    log = change_log(spark, sf_dir)
    live = assemble.drop_aborted(log, aborts(log, False))
    own = live.withColumn("ts_us", F.col("event_id") * 1000)
    now = F.timestamp_micros(F.lit(946_684_800_000_000 + 5_000_000))
    return metrics.per_transaction(own, F.length("props"), now)


@registered(LOG_SQL + " SELECT xid, subxid, count(*) AS n_changes FROM log GROUP BY xid, subxid")
def subtransaction_counts(spark, sf_dir):
    return metrics.per_part(change_log(spark, sf_dir))


_ITEMS = ", items AS (SELECT xid, event_id * 2 AS seq, 'change' AS kind FROM log UNION ALL SELECT conv_id, conv_id * 16 + turn * 2 + 1, 'message' FROM conversations), numbered AS (SELECT *, row_number() OVER (PARTITION BY xid ORDER BY seq) - 1 AS ordinal FROM items)"


def _items(spark, sf_dir) -> DataFrame:
    changes = change_log(spark, sf_dir).select("xid", (F.col("event_id") * 2).alias("seq"), F.lit("change").alias("kind"))
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("xid"), F.expr("conv_id * 16 + turn * 2 + 1").alias("seq"), F.lit("message").alias("kind"))
    return changes.unionByName(messages)


@registered(LOG_SQL + _ITEMS + " SELECT xid, seq, kind, ordinal FROM numbered")
def ordinals_shared(spark, sf_dir):
    return assemble.ordinals(_items(spark, sf_dir)).select("xid", "seq", "kind", "ordinal")


@registered(LOG_SQL + ", kept AS (SELECT * FROM log WHERE op <> 'update') SELECT commit_lsn, count(*) AS n_changes, 0 AS n_messages FROM kept GROUP BY commit_lsn")
def empty_txn_suppressed(spark, sf_dir):
    return assemble.transactions(change_log(spark, sf_dir).filter("op <> 'update'"))


@registered(LOG_SQL + ", m AS (SELECT (conv_id + 1) * 4096 AS commit_lsn, 0 AS c, 1 AS m FROM conversations), i AS (SELECT commit_lsn, 1 AS c, 0 AS m FROM log WHERE op = 'insert' UNION ALL SELECT * FROM m) SELECT commit_lsn, sum(c) AS n_changes, sum(m) AS n_messages FROM i GROUP BY commit_lsn HAVING sum(c) = 0")
def message_only_txn(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select(F.expr("(conv_id + 1) * 4096").alias("commit_lsn"))
    return assemble.transactions(change_log(spark, sf_dir).filter("op = 'insert'"), messages).filter("n_changes = 0")


@registered("SELECT (conv_id + 1) * 4096 + 7 AS lsn, role AS prefix, md5(text) AS content_md5 FROM conversations WHERE turn = 0")
def nontransactional_messages(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.expr("(conv_id + 1) * 4096 + 7").alias("lsn"), F.col("role").alias("prefix"), F.md5("text").alias("content_md5"))
    return own.unionByName(own.filter("lsn % 2 = 1")).dropDuplicates(["lsn"])  # at-least-once: some come twice


@registered(LOG_SQL + " SELECT commit_lsn, ordinal, pk FROM log WHERE commit_lsn > 40960")
def watermark_skip(spark, sf_dir):
    return assemble.after_checkpoint(change_log(spark, sf_dir), CHECKPOINT).select("commit_lsn", "ordinal", "pk")


@registered(LOG_SQL + _LAST.format(source="live"))
def redelivery_idempotent(spark, sf_dir):
    log = change_log(spark, sf_dir)
    live = assemble.drop_aborted(log, aborts(log, False))
    return mirror(live.unionByName(live.filter("commit_lsn > 2000000")))


@registered(LOG_SQL + " SELECT commit_lsn, op, ordinal, xid FROM live")
def receipts_ledger(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return sinks.receipts(assemble.drop_aborted(log, aborts(log, False)))


@registered(LOG_SQL + " SELECT op, count(*) AS n, max(commit_lsn) AS last_lsn FROM live WHERE commit_lsn > 40960 GROUP BY op")
def append_log(spark, sf_dir):
    log = change_log(spark, sf_dir)
    fresh = assemble.after_checkpoint(assemble.drop_aborted(log, aborts(log, False)), CHECKPOINT)
    return fresh.groupBy("op").agg(F.count("*").alias("n"), F.max("commit_lsn").alias("last_lsn"))


@registered(LOG_SQL + " SELECT event_id * 2 + 1 AS seq, xid AS owner FROM log")
def frame_owner(spark, sf_dir):
    """Frames to the transaction begun last before them, by bucketed carry."""
    log = change_log(spark, sf_dir)
    begins = log.groupBy("xid").agg((F.min("event_id") * 2).alias("seq")).select("seq", F.col("xid").alias("begin"))
    frames = begins.unionByName(log.select((F.col("event_id") * 2 + 1).alias("seq"), F.lit(None).cast("long").alias("begin")))
    return assemble.carry_last(frames, "begin", "owner", 1000).filter("seq % 2 = 1").select("seq", "owner")


# Positions and identifiers


@registered("SELECT event_id, printf('%X/%X', (event_id * 123456789) // 4294967296, (event_id * 123456789) % 4294967296) AS lsn FROM events")
def lsn_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", lsn.format_lsn(F.col("event_id") * 123_456_789).alias("lsn"))


@registered("SELECT event_id, event_id * 123456789 AS lsn FROM events")
def lsn_parse(spark, sf_dir):
    shown = lsn.format_lsn(F.col("event_id") * 123_456_789)
    return table(spark, sf_dir, "events").select("event_id", lsn.parse_lsn(shown).alias("lsn"))


_BAD_LSN = [("0/0", 0), ("", None), ("1", None), ("G/0", None), ("0/100000000", None), ("FFFFFFFF/FFFFFFFF", None), ("7FFFFFFF/FFFFFFFF", (1 << 63) - 1), ("1/2/3", None), (" 0/1", None), ("0/1\n", None), ("a/b", (10 << 32) + 11)]


@registered("SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else v}::BIGINT)" for i, (_, v) in enumerate(_BAD_LSN)) + ") t(id, lsn)")
def lsn_parse_invalid(spark, sf_dir):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_BAD_LSN)], "id int, t string").select("id", lsn.parse_lsn(F.col("t")).alias("lsn"))


@registered("SELECT name, regexp_full_match(name, '[a-z_][a-z0-9_]{0,62}') AS valid FROM (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT lower(n_name) || chr(10) FROM nation UNION ALL SELECT repeat('a', 50 + n_nationkey) FROM nation UNION ALL SELECT n_nationkey || 'x' FROM nation)")
def identifier_validate(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    forms = [F.lower("n_name"), F.col("n_name"), F.concat(F.lower("n_name"), F.lit("\n")), F.repeat(F.lit("a"), F.col("n_nationkey") + 50), F.concat(F.col("n_nationkey").cast("string"), F.lit("x"))]
    own = nation.select(F.explode(F.array(*forms)).alias("name"))
    return own.select("name", valid_identifier(F.col("name")).alias("valid"))


# Casts


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag = 'R' AS returned, CAST(l_shipdate AS DATE) AS shipped, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem")
def cast_scalars(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as string) a", "cast(l_linenumber as string) b", "cast(l_partkey as string) c", "cast(l_quantity as string) d", "case when l_returnflag = 'R' then 't' else 'false' end e", "cast(cast(l_shipdate as date) as string) f", "cast(l_tax as string) g")
    cast = lambda c, kind, m=None: pgtypes.cast_expr(F.col(c), kind, m)
    return own.select(cast("a", "int8").alias("l_orderkey"), cast("b", "int4").cast("int").alias("l_linenumber"), cast("c", "int8").alias("l_partkey"), cast("d", "float8").alias("l_quantity"), cast("e", "bool").alias("returned"), cast("f", "date").alias("shipped"), (cast("g", "numeric", (12 << 16) + 2 + 4) * 100).cast("bigint").alias("tax"))


_LENIENT = [("12abc", "int4", 12, None), ("not-a-number", "int4", None, "not-a-number"), ("-7", "int2", -7, None), ("+5x", "int8", 5, None), ("", "int4", None, ""), ("99999999999999999999", "int8", None, "99999999999999999999")]


@registered("SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else v}::BIGINT, {'NULL' if f is None else repr(f)}::VARCHAR)" for i, (_, _, v, f) in enumerate(_LENIENT)) + ") t(id, value, kept)")
def cast_lenient_fallback(spark, sf_dir):
    own = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(_LENIENT)], "id int, value string")
    out = pgtypes.cast_columns(own, {"value": "int8"})
    return out.select("id", "value", F.try_element_at("_cast_fallback", F.lit("value")).alias("kept"))


@registered("SELECT o_orderkey, o_totalprice AS amount, NULL::DOUBLE AS refused FROM orders")
def cast_money(spark, sf_dir):
    shown = F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 2))
    own = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("m"), F.regexp_replace(shown, ",", ".").alias("w"))
    bad = F.when(F.col("w").rlike(r"\..*\."), pgtypes.cast_expr(F.col("w"), "money")).cast("double")
    return own.select("o_orderkey", pgtypes.cast_expr(F.col("m"), "money").cast("double").alias("amount"), bad.alias("refused"))


@registered("SELECT o_orderkey, o_orderpriority AS note FROM orders")
def cast_bytea(spark, sf_dir):
    shown = F.concat(F.lit("\\x"), F.lower(F.hex(F.col("o_orderpriority").cast("binary"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", pgtypes.cast_expr(shown, "bytea").cast("string").alias("note"))


@registered("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def cast_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(pgtypes.cast_expr(F.col("props"), "jsonb"), "$.k", "bigint").alias("k"))


@registered("SELECT event_id, ts, CAST(ts AS DATE) AS d, ts AS z FROM events")
def cast_datetime(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("t"))
    cast = lambda c, kind: pgtypes.cast_expr(c, kind)
    return own.select("event_id", cast(F.col("t"), "timestamp").alias("ts"), cast(F.substring("t", 1, 10), "date").alias("d"), cast(F.concat("t", F.lit("+00")), "timestamptz").cast("timestamp_ntz").alias("z"))


@registered("SELECT o_orderkey, o_totalprice AS exact, CAST(NULL AS DOUBLE) AS surplus FROM orders")
def cast_numeric_scale(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("t"))
    two = (12 << 16) + 2 + 4
    return own.select("o_orderkey", pgtypes.cast_expr(F.col("t"), "numeric", two).cast("double").alias("exact"), pgtypes.cast_expr(F.concat(F.regexp_extract("t", r"^\d+", 0), F.lit(".125")), "numeric", two).cast("double").alias("surplus"))


@registered("SELECT oid, name FROM (VALUES (16, 'bool'), (20, 'int8'), (1700, 'numeric'), (1184, 'timestamptz'), (3802, 'jsonb'), (1007, '_int4'), (99999, '99999')) t(oid, name)")
def oid_names(spark, sf_dir):
    own = spark.createDataFrame([(o,) for o in (16, 20, 1700, 1184, 3802, 1007, 99999)], "oid int")
    return own.select("oid", pgtypes.type_name(F.col("oid")).alias("name"))


@registered("SELECT * FROM (VALUES ('numeric(10,2)', 655366), ('numeric(5)', 327684), ('character varying(20)', 24), ('character(3)', 7), ('timestamp(3) without time zone', 3), ('integer', -1), ('numeric(3,2)[]', -1)) t(formatted, type_modifier)")
def typmod_parse(spark, sf_dir):
    own = spark.createDataFrame([(t,) for t in ("numeric(10,2)", "numeric(5)", "character varying(20)", "character(3)", "timestamp(3) without time zone", "integer", "numeric(3,2)[]")], "formatted string")
    return own.select("formatted", pgtypes.typmod(F.col("formatted")).alias("type_modifier"))


# Array literals


@registered("SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def array_parse_int(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.col("l_partkey").cast("string")), ","), F.lit("}")).alias("t"))
    parsed = arrays.flat_array(F.col("t"), "bigint")
    return own.select("l_orderkey", F.size(parsed).cast("long").alias("n"), F.aggregate(parsed, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@registered("SELECT o_orderkey, o_orderpriority || ', \"q\"' AS first, o_orderstatus AS third FROM orders")
def array_parse_text(spark, sf_dir):
    quoted = F.concat(F.lit('{"'), F.col("o_orderpriority"), F.lit(', \\"q\\"",NULL,'), F.col("o_orderstatus"), F.lit("}"))
    parsed = arrays.nested_array(quoted, "string", 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(parsed, F.lit(0)).alias("first"), F.get(parsed, F.lit(2)).alias("third"))


@registered("SELECT vec_id, CAST(round(embedding[1] * 10000) AS BIGINT) AS a, CAST(round(embedding[2] * 10000) AS BIGINT) AS b, CAST(round(embedding[3] * 10000) AS BIGINT) AS c FROM embeddings")
def array_parse_2d(spark, sf_dir):
    # The product is a float, as it is in SQL: ties of its rounding differ from those of a double.
    whole = lambda i: F.round(F.col("embedding")[i] * F.lit(10000).cast("float")).cast("long").cast("string")
    literal = F.concat(F.lit("{{"), whole(0), F.lit(","), whole(1), F.lit("},{"), whole(2), F.lit(",NULL}}"))
    parsed = arrays.nested_array(literal, "bigint", 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.get(F.get(parsed, F.lit(i)), F.lit(j)).alias(n) for i, j, n in ((0, 0, "a"), (0, 1, "b"), (1, 0, "c"))))


_LITERALS = [("{}", "[]"), ("{1,NULL,3}", '["1", null, "3"]'), ('{"hello, world","foo"}', '["hello, world", "foo"]'), ("{{1,2},{3,4}}", '[["1", "2"], ["3", "4"]]'), ('{{"a}b","c{d"}}', '[["a}b", "c{d"]]'), ("{a,,b}", None), ("not an array", None), ('{"",x}', '["", "x"]'), ("{a", None), ("[0:1]={1,2}", None), ("{1} tail", '["1"]'), ('{"NULL"}', '["NULL"]'), ("{a,}", None)]


@registered("SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else repr(v)}::VARCHAR)" for i, (_, v) in enumerate(_LITERALS)) + ") t(id, parsed)")
def array_parse_invalid(spark, sf_dir):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_LITERALS)], "id int, t string").select("id", arrays.array_json(F.col("t")).alias("parsed"))


# Wire formats


_ORDERS = [("o_orderkey", 20, True), ("o_orderstatus", 25, False), ("o_totalprice", 701, False), ("o_orderpriority", 25, False)]
_ORDERS_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _frames(spark: SparkSession, sf_dir: str, second: bool) -> tuple[DataFrame, DataFrame]:
    """The frames before all rows, relation and begin, and the inserts of all orders."""
    head = [binary.encode_relation(7, "public", "orders", _ORDERS, second=second), binary.encode_begin(4096, 0, 1, second)]
    first = spark.createDataFrame([(i - 2, i, "w", bytearray(p), False) for i, p in enumerate(head)], FRAMES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, binary.HELD_FRAMES):
                part = batch.slice(at, binary.HELD_FRAMES)
                seq, *values = part.columns
                payloads = [binary.encode_insert(7, list(row), second) for row in zip(*(c.to_pylist() for c in values), strict=True)]
                own = {"seq": seq, "wal_end": seq, "kind": pa.array(["w"] * len(seq)), "payload": pa.array(payloads, pa.binary()), "in_stream": pa.array([False] * len(seq))}
                yield pa.RecordBatch.from_pydict(own)

    texts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), *(F.col(c).cast("string").alias(n) for (c, _, _), n in zip(_ORDERS, "abcd", strict=True)))
    # Orders are few bytes of Parquet: by splits of files, few tasks would encode and decode them all.
    dealt = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")
    return first, dealt.mapInArrow(encode, FRAMES)


def _records(spark: SparkSession, sf_dir: str, plugin: str) -> DataFrame:
    head, inserts = (binary.decode(own, plugin) for own in _frames(spark, sf_dir, plugin == "pglogical"))
    # The relation decides how tuples read; it is announced before all rows. As it goes to every task, its rows need not meet in one.
    relation = head.filter("kind = 'relation'").select("seq", "relid", "columns")
    rows = inserts.filter("kind = 'insert'").select("seq", "relid", "new_tuple")
    return assemble.relation_in_force(rows, relation, transactions.BROADCAST_VERSIONS).select(records.record(F.col("columns"), F.col("new_tuple")).alias("record"))


def _orders_of(rows: DataFrame) -> DataFrame:
    get = lambda c: F.try_element_at("record", F.lit(c))
    return rows.select(pgtypes.cast_expr(get("o_orderkey"), "int8").alias("o_orderkey"), get("o_orderstatus").alias("o_orderstatus"), pgtypes.cast_expr(get("o_totalprice"), "float8").alias("o_totalprice"), get("o_orderpriority").alias("o_orderpriority"))


@registered(_ORDERS_SQL)
def decode_pgoutput(spark, sf_dir):
    return _orders_of(_records(spark, sf_dir, "pgoutput"))


@registered(_ORDERS_SQL)
def decode_pglogical(spark, sf_dir):
    return _orders_of(_records(spark, sf_dir, "pglogical"))


def _json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = wal2json.encode_inserts(table(spark, sf_dir, "orders"), "public", "orders", {c: pgtypes.OIDS[o] for c, o, _ in _ORDERS}, F.lit(1).cast("long"), F.col("o_orderkey"))
    return wal2json.decode(frames).filter("kind = 'insert'").select("record")


@registered(_ORDERS_SQL)
def decode_wal2json(spark, sf_dir):
    return _orders_of(_json_records(spark, sf_dir))


@registered("SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM orders")
def decoder_parity(spark, sf_dir):
    """Rows that the three decoders do not deliver alike."""
    shown = lambda df: df.select(records.ordered_pairs(F.col("record")).alias("row"))
    three = [shown(_records(spark, sf_dir, "pgoutput")), shown(_records(spark, sf_dir, "pglogical")), shown(_json_records(spark, sf_dir))]
    every = three[0].unionByName(three[1]).unionByName(three[2]).groupBy("row").agg(F.count("*").alias("n"))
    return every.agg(F.count("*").alias("n_rows"), F.sum((F.col("n") % 3 != 0).cast("long")).alias("n_different"))


@registered("SELECT * FROM (VALUES (0, 'ERROR', 'unsupported_message'), (1, 'ERROR', 'decode_failure'), (2, 'ERROR', 'decode_failure'), (3, 'truncate', NULL), (4, 'message', NULL), (5, 'stream_abort', NULL), (6, 'insert', NULL)) t(seq, kind, reason)")
def decode_errors(spark, sf_dir):
    frames = [b"?x", b"I\0", b"T" + struct.pack(">IB", 2, 1) + struct.pack(">I", 5), b"T" + struct.pack(">IBI", 1, 3, 5), b"M\1" + struct.pack(">Q", 9) + b"p\0" + struct.pack(">I", 2) + b"hi", b"A" + struct.pack(">II", 3, 4), b"I" + struct.pack(">I", 3) + binary.encode_insert(7, ["a", None])[1:]]
    own = spark.createDataFrame([(i, i, "w", bytearray(p), i == 6) for i, p in enumerate(frames)], FRAMES)
    return binary.decode(own, "pgoutput").select(F.col("seq").cast("int").alias("seq"), "kind", "reason")


@registered("SELECT o_orderkey, 'o_orderkey=' || o_orderkey AS key_image, CASE WHEN o_orderkey % 2 = 0 THEN 'o_orderkey=' || o_orderkey || ',o_orderstatus=' || o_orderstatus ELSE 'o_orderkey=' || o_orderkey END AS old_image FROM orders")
def replica_identity_old_record(spark, sf_dir):
    columns = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(k).alias("is_key")) for c, k in (("o_orderkey", True), ("o_orderstatus", False))))
    values = F.array(*(F.struct(F.lit("v").alias("state"), F.col(c).cast("string").alias("text")) for c in ("o_orderkey", "o_orderstatus")))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "O").otherwise("K")
    image = lambda k: records.ordered_pairs(records.old_record(columns, values, k))
    return table(spark, sf_dir, "orders").select("o_orderkey", image(F.lit("K")).alias("key_image"), image(kind).alias("old_image"))


# Relation versions


_VERSIONS = [
    (10, 1, "default", [("id", "int8", -1, True), ("note", "text", -1, False)]),
    (2000, 1, "default", [("id", "int8", -1, True), ("note", "text", -1, False), ("extra", "int4", -1, False)]),
    (3000, 1, "default", [("id", "int8", -1, True), ("extra", "int4", -1, False)]),
    (4000, 1, "default", [("id", "int8", -1, True), ("extra", "int8", -1, False)]),
    (5000, 1, "all_columns", [("id", "int8", -1, True), ("extra", "int8", -1, False)]),
    (6000, 1, "all_columns", [("extra", "int8", -1, False), ("id", "int8", -1, True)]),
    (20, 2, "index", [("a", "varchar", 24, True), ("b", "text", -1, False)]),
    (7000, 2, "index", [("a", "varchar", 14, True), ("b", "text", -1, False)]),
    (8000, 2, "index", [("a", "varchar", 14, False), ("b", "text", -1, True)]),
]
_CHANGES = [(2000, 1, "additive", "column_added", "extra"), (3000, 1, "destructive", "column_dropped", "note"), (4000, 1, "destructive", "type_changed", "extra"), (5000, 1, "destructive", "replica_identity_changed", None), (7000, 2, "destructive", "type_changed", "a"), (8000, 2, "destructive", "replica_identity_changed", None)]


def _versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_VERSIONS, "seq long, relid long, identity string, columns array<struct<name:string,type:string,type_modifier:int,is_key:boolean>>")


@registered("WITH v(seq, relid) AS (VALUES " + ", ".join(f"({s}, {r})" for s, r, *_ in _VERSIONS) + "), f AS (SELECT event_id, 1 + event_id % 2 AS relid FROM events) SELECT f.event_id, v.seq AS version FROM f ASOF LEFT JOIN v ON f.relid = v.relid AND f.event_id >= v.seq")
def asof_relation(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 2 + 1).alias("relid"))
    return assemble.relation_in_force(frames, _versions(spark)).select(F.col("seq").alias("event_id"), F.col("_from").alias("version"))


@registered("SELECT * FROM (VALUES " + ", ".join(f"({s}, {r}, '{k}', '{c}', {'NULL' if d is None else repr(d)})" for s, r, k, c, d in _CHANGES) + ") t(seq, relid, kind, change, detail)")
def schema_change_classify(spark, sf_dir):
    return schema_change.classify(_versions(spark)).select(F.col("seq").cast("int").alias("seq"), F.col("relid").cast("int").alias("relid"), "kind", "change", "detail")


@registered(LOG_SQL + ", t AS (SELECT commit_lsn, max(event_id) AS seq FROM live GROUP BY commit_lsn) SELECT commit_lsn, seq FROM t WHERE seq < 3000")
def halt_prefix(spark, sf_dir):
    log = change_log(spark, sf_dir)
    commits = assemble.drop_aborted(log, aborts(log, False)).groupBy("commit_lsn").agg(F.max("event_id").alias("seq"))
    return assemble.before_halt(commits, schema_change.classify(_versions(spark)).filter("kind = 'destructive'").select("seq"))


# Publications


@registered("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def snapshot_projection(spark, sf_dir):
    entry = publication.Entry("p", "customer", ("c_mktsegment", "c_custkey", "c_name", "c_nationkey"))
    return snapshot.as_text(publication.published(table(spark, sf_dir, "customer"), [entry]))


_FILTERS = ("c_acctbal > 0", "c_mktsegment = 'BUILDING'")


def _filtered(spark, sf_dir, entries: list[publication.Entry], every: bool = False) -> DataFrame:
    return publication.published(table(spark, sf_dir, "customer"), entries, every).select("c_custkey")


@registered("SELECT c_custkey FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING'")
def row_filter_or(spark, sf_dir):
    return _filtered(spark, sf_dir, [publication.Entry("a", "customer", None, _FILTERS[0]), publication.Entry("b", "customer", None, _FILTERS[1])])


@registered("SELECT c_custkey FROM customer")
def row_filter_or_unfiltered(spark, sf_dir):
    return _filtered(spark, sf_dir, [publication.Entry("a", "customer", None, _FILTERS[0]), publication.Entry("b", "customer")])


@registered("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def row_filter_and(spark, sf_dir):
    return _filtered(spark, sf_dir, [publication.Entry("a", "customer", None, _FILTERS[0]), publication.Entry("b", "customer", None, _FILTERS[1]), publication.Entry("c", "customer")], every=True)


@registered("SELECT c_custkey FROM customer WHERE false")
def row_filter_no_insert(spark, sf_dir):
    return _filtered(spark, sf_dir, [publication.Entry("a", "customer", None, _FILTERS[0], inserts=False)])


_CATALOG = [("p1", "customer", ["c_custkey"]), ("p2", "customer", ["c_custkey"]), ("p1", "orders", ["o_orderkey"]), ("p2", "orders", ["o_orderkey", "o_custkey"]), ("p3", "part", None), ("p2", "nation", None)]


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CATALOG, "pub string, table string, columns array<string>")


@registered("SELECT DISTINCT name AS \"table\" FROM (VALUES ('customer'), ('orders'), ('nation'), ('customer')) t(name)")
def multipub_distinct(spark, sf_dir):
    return publication.published_tables(_catalog(spark), ["p1", "p2"])


@registered("SELECT 'orders' AS \"table\", 2 AS n_lists")
def column_list_conflict(spark, sf_dir):
    return publication.column_conflicts(_catalog(spark)).select("table", F.col("n_lists").cast("int").alias("n_lists"))


# Backfill


@registered("WITH r AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders), c AS (SELECT chunk, count(*) AS n_rows, min(k) AS first_key, max(k) AS last_key FROM r GROUP BY chunk) SELECT * FROM c UNION ALL SELECT max(chunk) + 1, 0, NULL, NULL FROM c HAVING count(*) FILTER (WHERE n_rows < 1000) = 0")
def keyset_chunks(spark, sf_dir):
    own = snapshot.chunk_bounds(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000, 16)
    return own.select(F.col("chunk").cast("long").alias("chunk"), "n_rows", F.col("first.o_orderkey").alias("first_key"), F.col("last.o_orderkey").alias("last_key"))


@registered("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > ((SELECT (min(conv_id) + max(conv_id)) // 2 FROM conversations), 1) ORDER BY conv_id, turn LIMIT 500")
def keyset_page_composite(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    low, high = rows.agg(F.min("conv_id"), F.max("conv_id")).first()
    return snapshot.page(rows, ["conv_id", "turn"], 500, ((low + high) // 2, 1)).select("conv_id", "turn", "role")


@registered("SELECT n_nationkey // 5 AS chunk, count(*) AS n_rows FROM nation GROUP BY 1 UNION ALL SELECT count(*) // 5, 0 FROM nation HAVING count(*) % 5 = 0")
def chunk_exact_multiple(spark, sf_dir):
    return snapshot.chunk_bounds(table(spark, sf_dir, "nation"), ["n_nationkey"], 5, 4).select(F.col("chunk").cast("long").alias("chunk"), "n_rows")


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select("o_orderkey", (F.col("o_orderkey") + 1).alias("commit_lsn"))


@registered("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey + 1 > 2000 AND o_orderkey + 1 <= 9000)")
def drop_filter(spark, sf_dir):
    return snapshot.drop_written(table(spark, sf_dir, "orders").select("o_orderkey"), _writes(spark, sf_dir), ["o_orderkey"], 2000, 9000)


@registered("SELECT 'orders' AS \"table\", count(*) AS n_written FROM orders WHERE o_orderkey % 7 = 0 HAVING count(*) > 20")
def drop_cap_breach(spark, sf_dir):
    return snapshot.contended(_writes(spark, sf_dir).select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("pk")), True, 20)


@registered("SELECT 'lineitem' AS \"table\", count(*) AS n_written FROM lineitem WHERE l_orderkey % 100 = 0 HAVING count(*) > 0")
def keyless_contention(spark, sf_dir):
    return snapshot.contended(table(spark, sf_dir, "lineitem").filter("l_orderkey % 100 = 0").select(F.lit("lineitem").alias("table")), False, 0)


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'streamed' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 21 <> 0")
def snapshot_stream_converge(spark, sf_dir):
    """Chunk rows without what the stream wrote, then the stream: equal to the table after all changes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    stream = orders.filter("o_orderkey % 7 = 0").select(F.when(F.col("o_orderkey") % 21 == 0, "delete").otherwise("update").alias("op"), "o_orderkey", F.lit("streamed").alias("o_orderstatus"), (F.col("o_orderkey") + 1).alias("commit_lsn"), F.lit(0).cast("long").alias("ordinal"))
    kept = snapshot.drop_written(orders, stream, ["o_orderkey"]).select(F.lit("insert").alias("op"), "o_orderkey", "o_orderstatus", F.lit(0).cast("long").alias("commit_lsn"), F.lit(0).cast("long").alias("ordinal"))
    return replay(kept.unionByName(stream).withColumn("_place", order_of()), ["o_orderkey"], ["o_orderstatus"])


@registered("SELECT 'part' AS \"table\", count(*) AS n_rows FROM part UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'none', 0")
def snapshot_totals(spark, sf_dir):
    names = ["part", "nation", "region"]
    counts = [table(spark, sf_dir, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n in names]
    counts.append(table(spark, sf_dir, "region").filter("false").agg(F.count("*").alias("n_rows")).select(F.lit("none").alias("table"), "n_rows"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@registered("SELECT * FROM (VALUES ('a', 'done'), ('b', 'current'), ('d', 'pending'), ('e', 'pending')) t(name, stage)")
def progress_resume(spark, sf_dir):
    token = progress.Progress(5, ("c", "d"), "b", ("17",), ("a",)).encode()
    own = progress.Progress.decode(token).resume(["a", "b", "d", "e"])
    rows = [*((t, "done") for t in own.done), (own.current, "current"), *((t, "pending") for t in own.pending)]
    return spark.createDataFrame(rows, "name string, stage string")


# Batches, lag and decisions


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    return assemble.drop_aborted(log, aborts(log, False)).select("commit_lsn").distinct()


@registered(LOG_SQL + ", c AS (SELECT DISTINCT commit_lsn FROM live) SELECT commit_lsn, (row_number() OVER (ORDER BY commit_lsn) - 1) // 100 AS batch FROM c")
def batch_by_count(spark, sf_dir):
    return pipeline.batch_by_count(_commits(spark, sf_dir), 100).select("commit_lsn", F.col("batch").cast("long").alias("batch"))


@registered(LOG_SQL + ", c AS (SELECT DISTINCT commit_lsn FROM live), heads AS (WITH RECURSIVE h(lsn, batch) AS (SELECT min(commit_lsn), 0 FROM c UNION ALL SELECT (SELECT min(commit_lsn) FROM c WHERE commit_lsn >= h.lsn + 65536), h.batch + 1 FROM h WHERE EXISTS (SELECT 1 FROM c WHERE commit_lsn >= h.lsn + 65536)) SELECT * FROM h) SELECT c.commit_lsn, h.batch::BIGINT AS batch FROM c ASOF JOIN heads h ON c.commit_lsn >= h.lsn")
def batch_by_span(spark, sf_dir):
    return pipeline.batch_by_span(_commits(spark, sf_dir), 65_536)


@registered("WITH f AS (SELECT event_id AS seq, (event_id + 1) * 512 AS wal_end, CASE WHEN event_id % 50 = 49 THEN (event_id - 20) * 512 END AS cp FROM events), m AS (SELECT min(wal_end) AS floor_ FROM f), r AS (SELECT seq, max(wal_end) OVER w AS got, max(cp) OVER w AS stored FROM f WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT seq, got - greatest(coalesce(stored, floor_), floor_) AS lag, got - greatest(coalesce(stored, floor_), floor_) > 30000 AS sink_too_slow FROM r, m")
def inflight_lag(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), ((F.col("event_id") + 1) * 512).alias("wal_end"), F.when(F.col("event_id") % 50 == 49, (F.col("event_id") - 20) * 512).alias("checkpoint"))
    return pipeline.inflight(frames, 30_000).select("seq", "lag", "sink_too_slow")


@registered("SELECT * FROM (VALUES ('state_mirror', 900), ('append_log', 500), ('behind', 400)) t(sink, position)")
def idle_ack(spark, sf_dir):
    frames = spark.createDataFrame([(1, "begin", 400), (2, "commit", 500), (3, "k", 800), (4, "k", 900)], "seq long, kind string, wal_end long")
    rows = [("state_mirror", pipeline.idle_position(frames, "state_mirror", 500)), ("append_log", pipeline.idle_position(frames, "append_log", 500)), ("behind", pipeline.idle_position(frames, "state_mirror", 400))]
    return spark.createDataFrame(rows, "sink string, position int")


_SLOT_AXES = {"version": [120000, 150000, 160000, 170000], "wal_status": ["lost", "reserved", "extended"], "conflicting": [True, False, None], "reason": ["wal_removed", "rows_removed", "wal_level_insufficient", "idle_timeout", "", None]}
_SLOT_SQL = """SELECT version, wal_status, conflicting, reason,
  CASE wal_status WHEN 'lost' THEN 'wal_lost' ELSE
    CASE WHEN version < 160000 THEN 'ok' WHEN conflicting THEN 'conflict' WHEN version < 170000 OR reason IS NULL OR reason = '' THEN 'ok'
      WHEN reason = 'wal_removed' THEN 'wal_lost' WHEN reason = 'rows_removed' OR reason = 'wal_level_insufficient' THEN reason ELSE 'invalidated' END END AS status
FROM (SELECT unnest([120000, 150000, 160000, 170000]) AS version) a, (SELECT unnest(['lost', 'reserved', 'extended']) AS wal_status) b,
  (SELECT unnest([true, false, NULL]) AS conflicting) c, (SELECT unnest(['wal_removed', 'rows_removed', 'wal_level_insufficient', 'idle_timeout', '', NULL]) AS reason) d"""


def _axes(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of a few constants."""
    kinds = {bool: "boolean", int: "int", str: "string"}
    return spark.createDataFrame(list(itertools.product(*axes.values())), ", ".join(f"{name} {kinds[type(values[0])]}" for name, values in axes.items()))


@registered(_SLOT_SQL)
def slot_status_classify(spark, sf_dir):
    return _axes(spark, _SLOT_AXES).withColumn("status", connect.slot_status(*(F.col(n) for n in _SLOT_AXES)))


_AXES = {"slot": ["unpromoted", "invalidated", "absent", "present"], "checkpoint": ["present", "empty", "fault"], "mode": ["none", "snapshot", "incremental"], "stage": ["none", "pending", "in_flight", "complete", "fault"]}


_CONNECT_SQL = """SELECT slot, checkpoint, mode, stage, CASE slot
  WHEN 'unpromoted' THEN 'halt:slot_synced_unpromoted'
  WHEN 'invalidated' THEN 'halt:slot_invalidated'
  WHEN 'absent' THEN CASE checkpoint
    WHEN 'present' THEN 'halt:data_gap'
    WHEN 'fault' THEN CASE WHEN mode = 'snapshot' THEN 'halt:checkpoint_unreadable' ELSE 'halt:data_gap' END
    ELSE CASE mode WHEN 'none' THEN 'create_slot' WHEN 'snapshot' THEN 'create_exporting_slot'
      ELSE CASE WHEN stage IN ('in_flight', 'complete') THEN 'halt:data_gap' WHEN stage = 'fault' THEN 'halt:progress_invalid' ELSE 'create_slot_and_backfill' END END END
  ELSE CASE mode
    WHEN 'incremental' THEN CASE stage WHEN 'complete' THEN 'stream' WHEN 'in_flight' THEN 'resume_backfill' WHEN 'pending' THEN 'restart_backfill'
      WHEN 'fault' THEN 'halt:progress_invalid' ELSE CASE WHEN checkpoint = 'present' THEN 'stream' ELSE 'halt:snapshot_incomplete' END END
    WHEN 'snapshot' THEN CASE checkpoint WHEN 'fault' THEN 'halt:checkpoint_unreadable' WHEN 'empty' THEN 'halt:snapshot_incomplete' ELSE 'stream' END
    ELSE 'stream' END END AS decision
FROM (SELECT unnest(['unpromoted', 'invalidated', 'absent', 'present']) AS slot) a, (SELECT unnest(['present', 'empty', 'fault']) AS checkpoint) b,
  (SELECT unnest(['none', 'snapshot', 'incremental']) AS mode) c, (SELECT unnest(['none', 'pending', 'in_flight', 'complete', 'fault']) AS stage) d"""


@registered(_CONNECT_SQL)
def connect_decision(spark, sf_dir):
    return _axes(spark, _AXES).withColumn("decision", connect.decision(*(F.col(n) for n in _AXES)))


@registered("SELECT * FROM (VALUES (0, 'halt'), (1, 'retry'), (2, 'retry'), (3, 'halt')) t(id, decision)")
def retry_decision(spark, sf_dir):
    cases = [(True, 0), (False, 0), (False, 5), (False, 6)]
    return spark.createDataFrame([(i, connect.retry(p, n, 5)) for i, (p, n) in enumerate(cases)], "id int, decision string")


@registered("SELECT * FROM (VALUES ('sink.committed', true), ('stream.aborted', true), ('row.value', false), ('', false)) t(event, allowed)")
def metrics_allowlist(spark, sf_dir):
    own = spark.createDataFrame([(e,) for e in ("sink.committed", "stream.aborted", "row.value", "")], "event string")
    return own.select("event", metrics.allowed(F.col("event")).alias("allowed"))


@registered(
    "WITH f AS (SELECT event_id AS seq, event_id // 10 AS ten, event_id % 10 AS slot FROM events), o AS (SELECT seq, CASE WHEN slot < 3 THEN 1 WHEN slot IN (5, 7, 8) AND ten >= 20 THEN -1 ELSE 0 END AS d FROM f) "
    "SELECT seq, CAST(sum(d) OVER w AS BIGINT) AS open_streams, sum(d) OVER w > 61 AS too_many FROM o WINDOW w AS (ORDER BY seq)"
)
def too_many_streams(spark, sf_dir):
    """All events as frames of streams that end 20 tens later, some by an abort; a second start and the abort of a part change nothing."""
    own = table(spark, sf_dir, "events").selectExpr("event_id as seq", "event_id div 10 as ten", "event_id % 10 as slot")
    kind = "case when slot < 4 then 'start' when slot in (4, 5) then 'abort' when slot in (7, 8) then 'commit' else 'row' end as kind"
    xid = "case when slot < 3 then ten * 3 + slot when slot in (3, 4) then ten * 3 when slot = 5 then (ten - 20) * 3 when slot in (7, 8) then (ten - 20) * 3 + slot - 6 end as xid"
    return pipeline.open_streams(own.selectExpr("seq", kind, xid, "case when slot = 4 then -1 end as subxid"), 61)
