"""Queries that start from encoded frames: decoding, segments, transactions, relations and replay in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import registered, table
from .operators import transactions
from .operators.held import as_table
from .operators.replay import order_of, replay, split_key_changes
from .sources import binary
from .sources.frames import FRAMES

#: Positions of one transaction's frames, and bytes of log a position stands for.
SPAN, BYTES = 32, 128
_MARKS = {"insert": b"I", "update": b"U", "delete": b"D"}
_COLUMNS = [("pk", 20, True), ("cents", 20, False), ("props", 25, False)]


def _encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Eight events are a transaction. Every fifth is streamed: four rows, others' frames, four rows, an aborted part, its end."""
    for part in parts:
        out: list[tuple[int, str, bytes | None]] = []
        for event, op, pk, cents, props in zip(*(part.column(c).to_pylist() for c in ("event_id", "op", "pk", "cents", "props")), strict=True):
            xid, n = divmod(event, 8)
            streamed, base, late = xid % 5 == 0, xid * SPAN, (xid + 2) * SPAN
            at = (base + 2 + n if n < 4 else late + 21 + n) if streamed else base + 2 + n
            own = xid * 10 + n // 3 if streamed else None
            new = [str(pk + 100_000 if op == "update" and event % 97 == 0 else pk), cents, binary.UNCHANGED if op == "update" and event % 3 == 0 else props]
            old = [str(pk), None, None] if op == "delete" or (op == "update" and event % 97 == 0) else None
            out.append((at, "w", binary.encode_row(_MARKS[op], 1, None if op == "delete" else new, old, subxid=own)))
            if n:
                continue
            if streamed:
                end = late + 31
                out += [(base, "w", binary.encode_stream_start(xid)), (base + 20, "w", binary.STREAM_STOP), (late + 24, "w", binary.encode_stream_start(xid, False)), (late + 29, "w", binary.STREAM_STOP)]
                out.append((late + 30, "w", binary.encode_stream_abort(xid, xid * 10 + 1)))
                out.append((end, "w", binary.encode_stream_abort(xid, xid) if xid % 85 == 0 else binary.encode_stream_commit(xid, end * BYTES, end * BYTES + 1, xid)))
            else:
                end = base + 23
                out += [(base, "w", binary.encode_begin(end * BYTES, xid, xid)), (base + 22, "k", None), (end, "w", binary.encode_commit(end * BYTES, end * BYTES + 1, xid))]
            if not streamed and xid % 211 == 1:
                out.append((base + 1, "w", binary.encode_truncate([1, 2])))
            elif xid % 13 == 0:
                out.append((base + 1, "w", binary.encode_message(base * BYTES, "note", b"x%d" % xid, subxid=xid * 10 if streamed else None)))
        seqs, kinds, payloads = zip(*out, strict=True) if out else ((), (), ())
        columns = {"seq": pa.array(seqs, pa.int64()), "wal_end": pa.array([seq * BYTES for seq in seqs], pa.int64()), "kind": pa.array(kinds, pa.string()), "payload": pa.array(payloads, pa.binary())}
        yield pa.RecordBatch.from_pydict(columns | {"in_stream": pa.array([False] * len(out), pa.bool_())})


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that the events stand for, as frames of the first format, in no order."""
    op = F.expr("case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end")
    cents = F.when(F.col("event_id") % 11 != 0, F.floor(F.col("value") * 100).cast("bigint").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", op.alias("op"), F.col("user_id").alias("pk"), cents.alias("cents"), "props")
    announced = [(-2, binary.encode_relation(1, "public", "events", _COLUMNS)), (-1, binary.encode_relation(2, "public", "others", _COLUMNS[:1]))]
    first = spark.createDataFrame([(seq, 0, "w", bytearray(data), False) for seq, data in announced], FRAMES)
    # Events are few bytes of Parquet: by splits of files, few tasks would encode them all.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return first.unionByName(dealt.mapInArrow(_encode, FRAMES))


def assembled(spark: SparkSession, sf_dir: str) -> transactions.Assembled:
    """Frames are made once and decoded once."""
    return transactions.assemble(binary.decode(transactions.in_segments(frames(spark, sf_dir), as_table), "pgoutput"), hold=as_table)


_LOG = """WITH ev AS (SELECT event_id, event_id // 8 AS xid, event_id % 8 AS n, user_id AS id, props,
  CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value * 100) AS BIGINT) END AS cents,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op FROM events),
placed AS (SELECT *, xid % 5 = 0 AS streamed, op = 'update' AND event_id % 97 = 0 AS moved, op = 'update' AND event_id % 3 = 0 AS unsent,
  CASE WHEN xid % 5 = 0 THEN xid * 10 + n // 3 END AS subxid, xid % 5 <> 0 AND xid % 211 = 1 AS emptied,
  (CASE WHEN xid % 5 = 0 THEN (xid + 2) * 32 + 31 ELSE xid * 32 + 23 END) * 128 AS commit_lsn FROM ev),
whole AS (SELECT *, n + CASE WHEN emptied THEN 2 WHEN xid % 13 = 0 THEN 1 ELSE 0 END AS ordinal FROM placed WHERE xid % 85 <> 0),
live AS (SELECT * FROM whole WHERE NOT (streamed AND subxid % 10 = 1))"""


@registered(
    _LOG
    + """ SELECT commit_lsn, ordinal, subxid, op, CASE WHEN op <> 'delete' THEN CASE WHEN moved THEN id + 100000 ELSE id END END AS pk,
  CASE WHEN moved OR op = 'delete' THEN id END AS old_pk, CASE WHEN op <> 'delete' THEN cents END AS cents,
  CASE WHEN op <> 'delete' AND NOT unsent THEN props END AS props, CASE WHEN unsent THEN 'props' ELSE '' END AS unsent FROM live
UNION ALL SELECT DISTINCT commit_lsn, u.o, NULL::BIGINT, 'truncate', NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL, '' FROM whole, (VALUES (0), (1)) u(o) WHERE emptied"""
)
def frames_to_changes(spark, sf_dir):
    value = lambda m, c: F.try_element_at(m, F.lit(c))
    long = lambda m, c: value(m, c).cast("bigint")
    return assembled(spark, sf_dir).changes.select(
        "commit_lsn", "ordinal", "subxid", "op", long("record", "pk").alias("pk"), long("old_record", "pk").alias("old_pk"), long("record", "cents").alias("cents"),
        value("record", "props").alias("props"), F.array_join("unchanged", ",").alias("unsent"),
    )


@registered(
    _LOG
    + """, c AS (SELECT commit_lsn, count(*) AS k FROM live GROUP BY 1)
SELECT w.commit_lsn, w.xid, w.streamed, coalesce(max(c.k), 0) + CASE WHEN max(w.emptied::INT) = 1 THEN 2 ELSE 0 END AS n_changes,
  CASE WHEN max(w.emptied::INT) = 0 AND w.xid % 13 = 0 THEN 1 ELSE 0 END AS n_messages
FROM whole w LEFT JOIN c USING (commit_lsn) GROUP BY w.commit_lsn, w.xid, w.streamed"""
)
def frames_to_transactions(spark, sf_dir):
    return transactions.delivered(assembled(spark, sf_dir).transactions).select("commit_lsn", "xid", "streamed", "n_changes", "n_messages")


@registered(_LOG + " SELECT DISTINCT commit_lsn, 0 AS ordinal, CASE WHEN streamed THEN xid * 10 END AS subxid, xid * 4096 AS lsn, 'note' AS prefix, 'x' || xid AS content FROM whole WHERE xid % 13 = 0 AND NOT emptied")
def frames_to_messages(spark, sf_dir):
    return assembled(spark, sf_dir).messages.select("commit_lsn", F.col("ordinal").cast("int").alias("ordinal"), "subxid", "lsn", "prefix", F.col("content").cast("string").alias("content"))


def state_of(changes: DataFrame, key: str, values: list[str], relid: int) -> DataFrame:
    """The rows of one relation after all changes, its truncates and key changes among them."""
    own = changes.filter(F.col("relid") == relid).withColumn("_place", order_of())
    get = lambda c: F.try_element_at("record", F.lit(c))
    old = F.try_element_at("old_record", F.lit(key))
    rows = own.filter("op <> 'truncate'").select("op", "_place", F.coalesce(get(key), old).alias(key), old.alias("_old"), "unchanged", *(get(v).alias(v) for v in values))
    emptied = own.filter("op = 'truncate'").select("_place")
    return replay(split_key_changes(rows, key, "_old"), [key], values, "unchanged", truncated=emptied)


@registered(
    _LOG
    + """, t AS (SELECT max(commit_lsn) * 32 AS cut_at FROM whole WHERE emptied),
both_ AS (SELECT CASE WHEN moved THEN id + 100000 ELSE id END AS pk, op, cents, props, unsent, commit_lsn * 32 + ordinal * 2 + 1 AS o FROM live
 UNION ALL SELECT id, 'delete', cents, props, unsent, commit_lsn * 32 + ordinal * 2 FROM live WHERE moved),
ord AS (SELECT both_.* FROM both_, t WHERE cut_at IS NULL OR o > cut_at),
r AS (SELECT pk, arg_max(op, o) AS last_op, max(CASE WHEN op IN ('insert', 'delete') THEN o END) AS reset FROM ord GROUP BY pk),
seg AS (SELECT b.* FROM ord b JOIN r USING (pk) WHERE last_op <> 'delete' AND op <> 'delete' AND (reset IS NULL OR o >= reset))
SELECT pk, arg_max_null(cents, o) AS cents, arg_max_null(props, o) FILTER (WHERE NOT unsent) AS props FROM seg GROUP BY pk"""
)
def frames_to_mirror(spark, sf_dir):
    state = state_of(assembled(spark, sf_dir).changes, "pk", ["cents", "props"], 1)
    return state.select(F.col("pk").cast("bigint").alias("pk"), F.col("cents").cast("bigint").alias("cents"), "props")


@registered("SELECT 0::BIGINT AS n_halts, 0::BIGINT AS n_open")
def frames_without_faults(spark, sf_dir):
    """A well-formed log has no halt and leaves nothing open."""
    own = assembled(spark, sf_dir)
    each = own.halts.select(F.lit(1).alias("h"), F.lit(0).alias("o")).unionByName(own.open_from.select(F.lit(0).alias("h"), F.lit(1).alias("o")))
    return each.agg(F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("n_halts"), F.coalesce(F.sum("o"), F.lit(0)).cast("long").alias("n_open"))
