"""The JSON wire format, decoded by SQL expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lsn import parse_lsn

_VALUE = "array<struct<name:string,type:string,typeoid:int,value:variant>>"
DOCUMENT = f"action string, xid long, timestamp string, lsn string, nextlsn string, schema string, table string, columns {_VALUE}, identity {_VALUE}, transactional boolean, prefix string, content string"
ACTIONS = {"B": "begin", "C": "commit", "I": "insert", "U": "update", "D": "delete", "T": "truncate", "M": "message"}


def _text(value: Column, kind: Column) -> Column:
    """A value as the other formats send it: booleans t and f, bytea with its prefix."""
    shape = F.schema_of_variant(value)
    whole = F.variant_get(value, "$", "string")
    return (
        F.when(shape == "BOOLEAN", F.when(whole == "true", "t").otherwise("f"))
        .when(shape == "STRING", F.when((kind == "bytea") & ~whole.startswith("\\x"), F.concat(F.lit("\\x"), whole)).otherwise(whole))
        .otherwise(F.lit(None).cast("string"))
    )


def _refused(columns: Column) -> Column:
    """Whether a value has a shape that texts never have: a JSON number, an array or an object."""
    return F.coalesce(F.exists(columns, lambda c: c["value"].isNotNull() & ~F.schema_of_variant(c["value"]).isin("BOOLEAN", "STRING", "VOID")), F.lit(False))


def _values(columns: Column) -> Column:
    return F.map_from_entries(F.transform(columns, lambda c: F.struct(c["name"], _text(c["value"], c["type"]))))


def decode(frames: DataFrame) -> DataFrame:
    """seq, kind, xid, lsn, end_lsn, namespace, name, record, old_values, names, message fields; reason where a frame is refused."""
    doc = F.from_json(F.col("payload").cast("string"), DOCUMENT)
    d = frames.filter("kind = 'w'").select("seq", doc.alias("d"))
    kinds = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    kind = F.coalesce(F.try_element_at(kinds, F.col("d.action")), F.lit("ERROR"))
    lsn = parse_lsn(F.col("d.lsn"))
    odd = _refused(F.col("d.columns")) | _refused(F.col("d.identity"))
    reason = F.when(F.col("d.action").isNull() | odd, "decode_failure").when(kind == "ERROR", "unsupported_message").when((kind == "commit") & lsn.isNull(), "decoder_lsn_missing")
    return d.select(
        "seq",
        F.when(reason.isNotNull(), "ERROR").otherwise(kind).alias("kind"),
        F.col("d.xid").alias("xid"),
        lsn.alias("lsn"),
        parse_lsn(F.col("d.nextlsn")).alias("end_lsn"),
        F.col("d.schema").alias("namespace"),
        F.col("d.table").alias("name"),
        _values(F.col("d.columns")).alias("record"),
        _values(F.col("d.identity")).alias("old_values"),
        F.transform("d.columns", lambda c: c["name"]).alias("names"),
        F.transform("d.columns", lambda c: c["type"]).alias("types"),
        F.coalesce("d.transactional", F.lit(False)).alias("transactional"),
        F.col("d.prefix").alias("prefix"),
        F.col("d.content").cast("binary").alias("content"),
        reason.alias("reason"),
    )


#: Positions within which one window looks for announcements.
STRETCH = 1 << 16


def inferred_relations(messages: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """seq, relid, namespace, name, replica_identity, columns: a relation is announced where an insert first has other columns than the one before.

    This format has no relation frames. catalog: relid-free rows (namespace, name,
    identity, keys array<string>) that seed identity and keys. A table's relid is a
    hash of its name. Windows run inside stretches of positions, and the last
    shape of each is carried over.
    """
    rows = messages.filter("kind = 'insert'").select("seq", "namespace", "name", F.xxhash64("namespace", "name").alias("relid"), F.arrays_zip(F.col("names").alias("name"), F.col("types").alias("type")).alias("shape"))
    dealt = rows.withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    inside = F.lag("shape").over(W.partitionBy("relid", "stretch").orderBy("seq"))
    lasts = dealt.groupBy("relid", "stretch").agg(F.max_by("shape", "seq").alias("last"))
    carried = lasts.select("relid", "stretch", F.lag("last").over(W.partitionBy("relid").orderBy("stretch")).alias("carried"))
    before = F.coalesce("inside", "carried")
    new = dealt.withColumn("inside", inside).join(carried, ["relid", "stretch"]).filter(before.isNull() | (before != F.col("shape")))
    if catalog is None:
        new = new.withColumn("identity", F.lit("default")).withColumn("keys", F.array().cast("array<string>"))
    else:
        new = new.join(catalog.select("namespace", "name", "identity", "keys"), ["namespace", "name"], "left")
    full = F.col("identity") == "all_columns"
    columns = F.transform("shape", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), F.lit(-1).alias("type_modifier"), (full | F.coalesce(F.array_contains("keys", c["name"]), F.lit(False))).alias("is_key")))
    return new.select("seq", "relid", "namespace", "name", F.coalesce("identity", F.lit("default")).alias("replica_identity"), columns.alias("columns"))


def as_messages(decoded: DataFrame, relations: DataFrame) -> DataFrame:
    """Decoded frames and inferred relations as one log that transactions.assemble takes; a relation comes before its row."""
    rows = decoded.select(
        (F.col("seq") * 2 + 1).alias("seq"), "kind", "xid", F.lit(None).cast("long").alias("subxid"), "lsn", "end_lsn", F.lit(None).cast("long").alias("ts_us"),
        F.xxhash64("namespace", "name").alias("relid"), "namespace", "name", F.lit(None).cast("string").alias("replica_identity"), F.col("record").alias("new_values"), "old_values",
        F.when(F.col("kind") == "truncate", F.array(F.xxhash64("namespace", "name"))).alias("truncated"), "transactional", "prefix", "content", "reason",
    )
    announced = relations.select((F.col("seq") * 2).alias("seq"), F.lit("relation").alias("kind"), "relid", "namespace", "name", "replica_identity", "columns")
    return rows.unionByName(announced, allowMissingColumns=True)


def drift(relations: DataFrame, catalog_columns: DataFrame) -> DataFrame:
    """namespace, name, missing, added: tables whose last announced columns differ from those of the catalog (namespace, name, columns array<string>). What the catalog doesn't list is no drift."""
    last = relations.groupBy("namespace", "name").agg(F.max_by(F.transform("columns", lambda c: c["name"]), "seq").alias("own"))
    both = last.join(catalog_columns.select("namespace", "name", F.col("columns").alias("now")), ["namespace", "name"])
    return both.select("namespace", "name", F.array_except("own", "now").alias("missing"), F.array_except("now", "own").alias("added")).filter("size(missing) > 0 or size(added) > 0")


def sentinels(message: DataFrame, relation_names: Column, fixed_width: Column) -> DataFrame:
    """unchanged: columns that an update did not send. An insert, or a fixed-width column, that lacks one tells that it was dropped."""
    missing = F.array_except(relation_names, F.col("names"))
    gone = F.when(F.col("kind") == "insert", missing).when(F.col("kind") == "update", F.array_intersect(missing, fixed_width)).otherwise(F.array().cast("array<string>"))
    return message.withColumn("dropped", gone).withColumn("unchanged", F.when(F.col("kind") == "update", F.array_except(missing, "dropped")).otherwise(F.array().cast("array<string>")))


def real_old(record: Column, old_values: Column, identity: Column) -> Column:
    """The old image: the whole one under a full identity, none where it equals the new row, else the key."""
    same = F.forall(F.map_entries(old_values), lambda e: F.try_element_at(record, e["key"]).eqNullSafe(e["value"]))
    return F.when(identity == "all_columns", old_values).when(~same, old_values)


def encode_inserts(df: DataFrame, schema: str, table: str, types: dict[str, str], xid: Column, seq: Column) -> DataFrame:
    """Frames of inserts of the rows of df, for replays and tests."""
    columns = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.col(c).cast("string").alias("value")) for c, t in types.items()))
    doc = F.to_json(F.struct(F.lit("I").alias("action"), xid.alias("xid"), F.lit(schema).alias("schema"), F.lit(table).alias("table"), columns.alias("columns")))
    return df.select(seq.alias("seq"), seq.alias("wal_end"), F.lit("w").alias("kind"), doc.cast("binary").alias("payload"), F.lit(False).alias("in_stream"))
