"""What a server's catalog tells, as DataFrame queries over a few small frames.

classes: oid, namespace, table, identity (default, nothing, all_columns, index).
attributes: oid, attnum, name, type, type_modifier, dropped, generated.
indexes: oid, is_primary, is_identity, key (array of attnum in key order).
publications: publication, inserts. members: publication, oid, attnums (null: all), row_filter.
slots: slot, wal_status, conflicting, reason, synced, active, confirmed_flush.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _live(attributes: DataFrame) -> DataFrame:
    return attributes.filter("not dropped and attnum > 0")


def _ordered(name: str, by: str) -> Column:
    """Names in the order of a number, of the rows of a group."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by, name))), lambda x: x[name])


def _keys(indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """oid, keys: the names of an index' columns in key order."""
    each = indexes.select("oid", F.posexplode("key").alias("place", "attnum"))
    return each.join(attributes.select("oid", "attnum", "name"), ["oid", "attnum"]).groupBy("oid").agg(_ordered("name", "place").alias("keys"))


def key_columns(classes: DataFrame, attributes: DataFrame, indexes: DataFrame, members: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """namespace, table, keys: primary keys of published tables, or of the tables (namespace, table) that are listed."""
    own = classes if members is None else classes.join(members.select("oid").distinct(), "oid", "left_semi")
    own = own if tables is None else own.join(tables, ["namespace", "table"], "left_semi")
    return own.join(_keys(indexes.filter("is_primary"), attributes), "oid").select("namespace", "table", "keys")


def census(classes: DataFrame, attributes: DataFrame, server_version: int, tables: DataFrame | None = None) -> DataFrame:
    """namespace, table, columns: all live columns in table order; generated ones count from version 18 of the server."""
    own = classes if tables is None else classes.join(tables, ["namespace", "table"], "left_semi")
    live = _live(attributes) if server_version >= 180000 else _live(attributes).filter("not generated")
    return own.join(live.groupBy("oid").agg(_ordered("name", "attnum").alias("columns")), "oid").select("namespace", "table", "columns")


def projections(classes: DataFrame, attributes: DataFrame, publications: DataFrame, members: DataFrame, names: Sequence[str], every: bool = False) -> DataFrame:
    """namespace, table, publication, columns, row_filter: what each named publication shows of each table.

    columns is null where a list names no live column, which is not the same as
    no list. row_filter joins those of all that publish inserts: by OR, with null
    if one has none; with `every`, by AND of those there are; FALSE if none does.
    """
    own = members.filter(F.col("publication").isin(*names)).join(publications, "publication")
    listed = own.select("publication", "oid", F.explode("attnums").alias("attnum")).join(_live(attributes), ["oid", "attnum"]).groupBy("publication", "oid").agg(_ordered("name", "attnum").alias("listed"))
    whole = _live(attributes).filter("not generated").groupBy("oid").agg(_ordered("name", "attnum").alias("whole"))
    in_order = F.array_sort(F.collect_set(F.when(F.col("inserts"), F.col("row_filter"))))
    joined = F.array_join(F.transform(in_order, lambda f: F.concat(F.lit("("), f, F.lit(")"))), " AND " if every else " OR ")
    open_ = F.size(in_order) == 0 if every else F.bool_or(F.col("inserts") & F.col("row_filter").isNull())
    filters = own.groupBy("oid").agg(F.when(~F.bool_or("inserts"), "FALSE").when(~open_, joined).alias("row_filter"))
    shown = own.select("publication", "oid", "attnums").join(listed, ["publication", "oid"], "left").join(whole, "oid", "left").join(filters, "oid").join(classes, "oid")
    return shown.select("namespace", "table", "publication", F.when(F.col("attnums").isNull(), F.col("whole")).otherwise(F.col("listed")).alias("columns"), "row_filter")


def column_lists(shown: DataFrame) -> DataFrame:
    """namespace, table, n_lists, reason: what stops a snapshot. A table that shows no column comes before one that shows several lists."""
    lists = F.count_distinct(F.array_join("columns", ",")) 
    found = shown.groupBy("namespace", "table").agg(lists.alias("n_lists"), F.bool_or(F.col("columns").isNull()).alias("_none"))
    reason = F.when(F.col("_none"), "snapshot_no_publishable_columns").when(F.col("n_lists") > 1, "snapshot_column_list_conflict")
    return found.select("namespace", "table", "n_lists", reason.alias("reason"))


def table_info(classes: DataFrame, attributes: DataFrame, indexes: DataFrame, tables: DataFrame) -> DataFrame:
    """namespace, table, attnum, name, type, type_modifier, identity, is_key: one row for each live column of the tables that are found.

    Key columns are those of the identity: all, the identity index', or the primary key's.
    """
    chosen = indexes.join(classes.select("oid", "identity"), "oid").filter("(identity = 'index' and is_identity) or (identity = 'default' and is_primary)")
    keyed = chosen.select("oid", F.explode("key").alias("attnum"), F.lit(True).alias("_key")).distinct()
    own = classes.join(tables, ["namespace", "table"], "left_semi").join(_live(attributes), "oid").join(keyed, ["oid", "attnum"], "left")
    is_key = (F.col("identity") == "all_columns") | F.coalesce("_key", F.lit(False))
    return own.select("oid", "namespace", "table", "attnum", "name", "type", "type_modifier", "identity", is_key.alias("is_key"))


def relations(info: DataFrame) -> DataFrame:
    """namespace, table, identity, columns: the flat rows of table_info, a row for each table."""
    each = F.struct("attnum", "name", "type", "type_modifier", "is_key")
    own = info.groupBy("namespace", "table", "identity").agg(F.array_sort(F.collect_list(each)).alias("_c"))
    return own.select("namespace", "table", "identity", F.transform("_c", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["type_modifier"].alias("type_modifier"), c["is_key"].alias("is_key"))).alias("columns"))


def keyless(relations_: DataFrame) -> DataFrame:
    """Tables without a full identity and without a key column."""
    return relations_.filter((F.col("identity") != "all_columns") & ~F.exists("columns", lambda c: c["is_key"])).select("namespace", "table")


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Wanted tables (namespace, table) that were not found: decoder_table_missing."""
    return wanted.join(found, ["namespace", "table"], "left_anti")


def unequal(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Tables that one side has and the other has not; the gate is passed when there is none."""
    tables = lambda df: df.select("namespace", "table").distinct()
    return tables(wanted).exceptAll(tables(found)).withColumn("side", F.lit("wanted")).unionByName(tables(found).exceptAll(tables(wanted)).withColumn("side", F.lit("found")))


def slot(slots: DataFrame, name: str) -> DataFrame:
    return slots.filter(F.col("slot") == name).limit(1)


def checkpoint_shape(df: DataFrame) -> None:
    """Fails unless the position column is a long."""
    if dict(df.dtypes).get("commit_lsn") != "bigint":
        raise ValueError("checkpoint_shape")


def watermark(frames: DataFrame) -> DataFrame:
    """The position of the log at the time of a read."""
    return frames.agg(F.max("wal_end").alias("watermark"))


def as_changes(chunk: DataFrame, namespace: str, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows of a chunk as changes: op snapshot, no position, ordinal 0, values as text by name; the native key stays beside them for bounds."""
    values = F.create_map(*(x for c in chunk.columns for x in (F.lit(c), F.col(c).cast("string"))))
    return chunk.select(F.lit("snapshot").alias("op"), F.lit(namespace).alias("namespace"), F.lit(table).alias("name"), values.alias("record"), F.lit(None).cast("long").alias("commit_lsn"), F.lit(0).cast("long").alias("ordinal"), F.struct(*keys).alias("raw_key"))


def columns_of(columns: Column) -> Column:
    """What a change tells of its columns: name, type, modifier and whether it is a key."""
    return F.transform(columns, lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["type_modifier"].alias("type_modifier"), c["is_key"].cast("int").alias("flags")))
