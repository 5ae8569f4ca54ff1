"""Decoded frames to committed transactions, as one declarative plan.

What opens, closes or aborts a transaction are a few boundary frames; a row
belongs to the one that was open before it, which is carried over stretches of
positions. Nothing is gathered by transaction: a transaction of any size is rows
of several tasks. Faults are rows too: only transactions that end before the
first one are delivered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import records
from .assemble import carry_last, relation_in_force
from .held import Hold, as_it_is

CHANGES = ("insert", "update", "delete", "truncate")
#: Versions of relations up to which they are sent to all tasks.
BROADCAST_VERSIONS = 100_000


@dataclass(frozen=True)
class Assembled:
    """changes and messages of committed transactions, the transactions, standalone messages, and what is not over.

    changes: commit_lsn, ordinal, xid, subxid, op, namespace, name, relid, columns, record, old_record, unchanged, ts_us, seq.
    messages: commit_lsn, ordinal, xid, subxid, lsn, prefix, content, seq.
    transactions: commit_lsn, xid, streamed, ts_us, n_changes, n_messages, seq; those without changes and messages too.
    standalone: lsn, prefix, content, seq. halts: seq, reason. open_from: seq of boundary frames that nothing has closed.
    """

    changes: DataFrame
    messages: DataFrame
    transactions: DataFrame
    standalone: DataFrame
    halts: DataFrame
    open_from: DataFrame


def in_segments(frames: DataFrame, hold: Hold = as_it_is) -> DataFrame:
    """frames with in_stream read off the frames themselves: a segment starts at S and ends at E."""
    mark = F.when(F.col("kind") == "w", F.substring("payload", 1, 1).cast("string"))
    marked = frames.drop("in_stream").withColumn("_mark", F.when(mark == "S", True).when(mark == "E", False))
    return carry_last(marked, "_mark", "_in", hold=hold).withColumn("in_stream", F.coalesce("_in", F.lit(False)) & F.col("_mark").isNull()).drop("_mark", "_in")


def _owner() -> Column:
    """What is open after a boundary frame: (streamed, its seq), with seq null if nothing is; null for other frames."""
    opens = F.struct((F.col("kind") == "stream_start").alias("streamed"), F.col("seq").alias("seq"))
    none = F.struct(F.lit(False).alias("streamed"), F.lit(None).cast("long").alias("seq"))
    return F.when(F.col("kind").isin("begin", "stream_start"), opens).when(F.col("kind").isin("commit", "stream_stop"), none)


def _streams(boundaries: DataFrame) -> DataFrame:
    """(from_seq, xid, first_seq, end_seq, end_kind, commit_lsn, ts_us) for each segment: of an xid, the first commit or whole abort after it ends it."""
    whole = (F.col("kind") == "stream_abort") & (F.col("xid") == F.col("subxid"))
    own = boundaries.filter(F.col("kind").isin("stream_start", "stream_commit") | whole)
    ends = F.when(F.col("kind") != "stream_start", F.struct(F.col("seq").alias("end_seq"), F.col("kind").alias("end_kind"), F.col("lsn").alias("commit_lsn"), "ts_us"))
    after = W.partitionBy("xid").orderBy("seq").rowsBetween(0, W.unboundedFollowing)
    marked = own.withColumn("_end", F.first(ends, ignorenulls=True).over(after))
    first = F.min(F.when(F.col("kind") == "stream_start", F.col("seq"))).over(W.partitionBy("xid", "_end.end_seq"))
    return marked.withColumn("first_seq", first).select("seq", "kind", "xid", "first_seq", "_end.*")


def _versions(messages: DataFrame) -> DataFrame:
    return messages.filter("kind = 'relation'").select("seq", "relid", "namespace", "name", "replica_identity", "columns")


def _numbered(items: DataFrame, spans: DataFrame) -> DataFrame:
    """items with what spans tells of their segments, and ordinal: what came before in the same transaction, each item counting `weight`.

    _run is the sum of weights up to an item in its stretch of positions. As a
    segment is not interrupted, the items of one segment and stretch need one
    number beside it, and meet by both: no window holds rows of a transaction.
    """
    first = F.col("_run") - F.col("weight")
    sums = items.groupBy("from_seq", "_bucket").agg(F.sum("weight").alias("_sum"), F.min(first).alias("_first")).join(spans, "from_seq")
    before = F.sum("_sum").over(W.partitionBy("txn").orderBy("from_seq", "_bucket").rowsBetween(W.unboundedPreceding, -1))
    carried = sums.withColumn("_before", F.coalesce(before, F.lit(0)) - F.col("_first")).drop("_sum", "_first")
    return items.join(carried, ["from_seq", "_bucket"]).withColumn("ordinal", (F.col("_before") + first).cast("long")).drop("_bucket", "_run", "_before")


def _by_relation(rows: DataFrame) -> DataFrame:
    """A row for each relation that a change is of, truncates being of several; without what only announcements have."""
    one = F.array(F.struct(F.col("relid").alias("relid"), F.lit(0).cast("long").alias("at")))
    each = F.when(F.col("kind") == "truncate", F.transform("truncated", lambda r, i: F.struct(r.alias("relid"), i.cast("long").alias("at")))).otherwise(one)
    return rows.withColumn("_rel", F.explode(each)).drop("relid", "namespace", "name", "columns", "replica_identity").withColumn("relid", F.col("_rel.relid"))


def assemble(messages: DataFrame, halting: DataFrame | None = None, hold: Hold = as_it_is) -> Assembled:
    """messages: decoded frames, as sources.frames.MESSAGES has them. halting: more halts (seq, reason), as of destructive schema changes.

    hold: what keeps messages with their owners, which all parts of the plan read.
    """
    is_message = (F.col("kind") == "message") & F.col("transactional")
    weight = F.when(F.col("kind") == "truncate", F.size("truncated")).otherwise(1)
    is_item = F.col("kind").isin(*CHANGES) | is_message
    owned = carry_last(messages.withColumn("_owner", _owner()), "_owner", "_open", before=True, hold=hold, running=F.when(is_item, weight).otherwise(0))
    messages = owned.drop("_owner", "_open", "_bucket", "_run")
    boundaries = owned.filter(F.col("kind").isin("begin", "commit", "stream_start", "stream_stop", "stream_commit", "stream_abort"))

    # Transactions and what ends them
    streams = _streams(boundaries)
    segments = streams.filter("kind = 'stream_start'").select(F.col("seq").alias("from_seq"), "xid", F.col("first_seq").alias("txn"), "end_seq", F.lit(True).alias("streamed"), F.when(F.col("end_kind") == "stream_commit", F.col("commit_lsn")).alias("commit_lsn"), "ts_us", (F.col("end_kind") == "stream_commit").alias("committed"))
    commits = boundaries.filter("kind = 'commit' and _open.seq is not null and not _open.streamed").select(F.col("_open.seq").alias("from_seq"), F.col("seq").alias("end_seq"), "lsn", F.col("ts_us").alias("commit_ts"))
    begins = boundaries.filter("kind = 'begin'").select(F.col("seq").alias("from_seq"), "xid", F.col("lsn").alias("begin_lsn")).join(commits, "from_seq", "left")
    plain = begins.select("from_seq", "xid", F.col("from_seq").alias("txn"), "end_seq", F.lit(False).alias("streamed"), F.coalesce("lsn", "begin_lsn").alias("commit_lsn"), F.col("commit_ts").alias("ts_us"), F.col("end_seq").isNotNull().alias("committed"))
    spans = plain.unionByName(segments)

    # Rows and transactional messages by transaction, numbered before anything is dropped
    each = owned.filter(is_item).withColumn("weight", weight).withColumn("from_seq", F.col("_open.seq")).drop("xid", "ts_us", "_owner", "_open")
    each = each.filter("from_seq is not null")
    items = _numbered(each, spans)

    # Sub-transactions that were aborted, with their messages
    part = boundaries.filter("kind = 'stream_abort' and xid <> subxid")
    of_xid = streams.filter("kind = 'stream_start'").select("xid", "first_seq", F.coalesce("end_seq", F.lit((1 << 63) - 1)).alias("_until")).distinct()
    part = part.select("seq", "xid", "subxid").join(of_xid, "xid").filter("seq > first_seq and seq < _until")
    gone = part.select(F.col("first_seq").alias("txn"), "subxid").distinct()

    # Relations in force
    versions = _versions(messages)
    rows = _by_relation(items.filter(F.col("kind").isin(*CHANGES)))
    rows = rows.withColumn("ordinal", F.col("ordinal") + F.col("_rel.at")).drop("_rel")
    known = relation_in_force(rows, versions, BROADCAST_VERSIONS)

    # Faults, each at the frame that shows it
    unowned = owned.filter(F.col("_open.seq").isNull() & (F.col("kind").isin(*CHANGES, "commit") | is_message)).select("seq", F.lit("config_invalid").alias("reason"))
    unknown = streams.filter("kind <> 'stream_start' and first_seq is null").select("seq", F.lit("config_invalid").alias("reason"))
    stray = boundaries.filter("kind = 'stream_abort' and xid <> subxid").select("seq").join(part.select("seq").distinct(), "seq", "left_anti").select("seq", F.lit("config_invalid").alias("reason"))
    named = relation_in_force(_by_relation(each.filter(F.col("kind").isin(*CHANGES))).select("seq", "relid"), versions, BROADCAST_VERSIONS)
    unnamed = named.filter(F.col("columns").isNull()).select("seq", F.lit("config_invalid").alias("reason"))
    errors = messages.filter("kind = 'ERROR'").select("seq", F.coalesce("reason", F.lit("decode_failure")).alias("reason"))
    halts = errors.unionByName(unowned).unionByName(unknown).unionByName(stray).unionByName(unnamed)
    halts = halts if halting is None else halts.unionByName(halting)
    first = halts.agg(F.min("seq").alias("_halt"))
    until = lambda df, at: df.join(F.broadcast(first), how="cross").filter(F.col("_halt").isNull() | (F.col(at) < F.col("_halt"))).drop("_halt")  # noqa: E731  one row

    names = F.transform("columns", lambda c: c["name"])
    if "new_values" in messages.columns:  # a format that names its values
        new, old = F.col("new_values"), F.col("old_values")
        same = F.forall(F.map_entries(old), lambda e: F.try_element_at(new, e["key"]).eqNullSafe(e["value"]))
        record, old_record = new, F.when((F.col("replica_identity") == "all_columns") | new.isNull() | ~same, old)
        unsent = F.when(F.col("kind") == "update", F.array_except(names, F.map_keys(new)))
    else:
        record, unsent = records.record(F.col("columns"), F.col("new_tuple")), records.unchanged(F.col("columns"), F.col("new_tuple"))
        old_record = records.old_record(F.col("columns"), F.col("old_tuple"), F.col("old_kind"))
    live = until(known.filter("committed"), "end_seq").join(gone, ["txn", "subxid"], "left_anti")
    changes = live.select(
        "commit_lsn", "ordinal", "xid", "subxid", F.col("kind").alias("op"), "namespace", "name", "relid", "columns",
        record.alias("record"), old_record.alias("old_record"), F.coalesce(unsent, F.array().cast("array<string>")).alias("unchanged"),
        "ts_us", "seq",
    )
    told = until(items.filter(is_message & F.col("committed")), "end_seq").join(gone, ["txn", "subxid"], "left_anti").select("commit_lsn", "ordinal", "xid", "subxid", "lsn", "prefix", "content", "seq")
    counts = changes.select("commit_lsn", F.lit(1).alias("c"), F.lit(0).alias("m")).unionByName(told.select("commit_lsn", F.lit(0).alias("c"), F.lit(1).alias("m"))).groupBy("commit_lsn").agg(F.sum("c").alias("n_changes"), F.sum("m").alias("n_messages"))
    ended = until(spans.filter("committed"), "end_seq").groupBy("txn").agg(F.first("commit_lsn").alias("commit_lsn"), F.first("xid").alias("xid"), F.first("streamed").alias("streamed"), F.first("ts_us").alias("ts_us"), F.max("end_seq").alias("seq"))
    transactions = ended.join(counts, "commit_lsn", "left").select("commit_lsn", "xid", "streamed", "ts_us", F.coalesce("n_changes", F.lit(0)).alias("n_changes"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "seq")
    standalone = until(messages.filter("kind = 'message' and not transactional"), "seq").select("lsn", "prefix", "content", "seq")
    return Assembled(changes, told, transactions, standalone, halts, spans.filter("end_seq is null").select(F.col("from_seq").alias("seq")))


def delivered(transactions: DataFrame) -> DataFrame:
    """Transactions that a sink is called for: the empty ones are passed over."""
    return transactions.filter("n_changes > 0 or n_messages > 0")


def open_tail(frames: DataFrame, messages: DataFrame, assembled: Assembled) -> DataFrame:
    """The frames that a later batch needs again: those of open transactions, and the relations that are in force then.

    Frames of segments that something has closed go, so that what is kept is bounded by what is open.
    """
    owned = carry_last(messages.select("seq", "kind", "xid", "subxid", _owner().alias("_owner")), "_owner", "_open", before=True)
    from_seq = F.when(F.col("kind").isin("begin", "stream_start"), F.col("seq")).otherwise(F.col("_open.seq"))
    mine = owned.withColumn("_from", from_seq).join(assembled.open_from.withColumnRenamed("seq", "_from"), "_from", "left_semi").filter("kind <> 'relation'").select("seq")
    open_xids = messages.join(assembled.open_from, "seq", "left_semi").select("xid").distinct()
    parts = messages.filter("kind = 'stream_abort' and xid <> subxid").join(open_xids, "xid", "left_semi").select("seq")
    versions = _versions(messages).withColumn("_until", F.lead("seq").over(W.partitionBy("relid").orderBy("seq")))
    oldest = assembled.open_from.agg(F.min("seq").alias("_oldest"))
    held = versions.join(F.broadcast(oldest), how="cross").filter("_until is null or _until > _oldest").select("seq")
    return frames.join(mine.unionByName(parts).unionByName(held).distinct(), "seq", "left_semi")
