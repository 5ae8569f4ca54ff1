"""Queries over a server's catalog, snapshot windows and what is held of open transactions; the tables stand in for a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import registered, table
from .plans import catalog
from .streaming import backfill, metrics


def _catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nations are tables, suppliers their columns, regions publications."""
    identity = F.expr("element_at(array('default', 'index', 'all_columns', 'nothing'), cast(n_nationkey % 4 + 1 as int))")
    classes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("oid"), F.lit("public").alias("namespace"), F.col("n_name").alias("table"), identity.alias("identity"))
    attributes = table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_nationkey as bigint) as oid", "cast(s_suppkey + 1 as bigint) as attnum", "s_name as name", "case when s_suppkey % 2 = 0 then 'int8' else 'text' end as type",
        "-1 as type_modifier", "s_suppkey % 7 = 3 as dropped", "s_suppkey % 11 = 5 as generated",
    )
    keys = attributes.filter("attnum % 5 < 2").groupBy("oid").agg(F.sort_array(F.collect_list("attnum"), asc=False).alias("key"))
    indexes = keys.select("oid", F.lit(True).alias("is_primary"), F.lit(False).alias("is_identity"), "key")
    other = attributes.filter("attnum % 3 = 0").groupBy("oid").agg(F.sort_array(F.collect_list("attnum")).alias("key"))
    indexes = indexes.unionByName(other.select("oid", F.lit(False).alias("is_primary"), F.lit(True).alias("is_identity"), "key"))
    publications = table(spark, sf_dir, "region").selectExpr("r_name as publication", "r_regionkey % 2 = 0 as inserts")
    pairs = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), (F.col("n_nationkey") + F.col("r_regionkey")) % 2 == 0)
    listed = attributes.filter("attnum % 4 > 0").groupBy("oid").agg(F.sort_array(F.collect_list("attnum")).alias("attnums"))
    members = pairs.selectExpr("r_name as publication", "cast(n_nationkey as bigint) as oid", "n_nationkey % 6 = 1 and r_regionkey > 1 as part", "case when (n_nationkey + r_regionkey) % 3 > 0 then concat('x > ', r_regionkey) end as row_filter").join(listed, "oid", "left")
    members = members.select("publication", "oid", F.when(F.col("part"), F.col("attnums")).alias("attnums"), "row_filter")
    return {"classes": classes, "attributes": attributes, "indexes": indexes, "publications": publications, "members": members}


_CATALOG = """WITH a AS (SELECT s_nationkey AS oid, s_suppkey + 1 AS attnum, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'int8' ELSE 'text' END AS type,
  s_suppkey % 7 = 3 AS dropped, s_suppkey % 11 = 5 AS gen FROM supplier),
m AS (SELECT r_name AS publication, r_regionkey % 2 = 0 AS inserts, n_nationkey AS oid, n_name AS "table", n_nationkey % 6 = 1 AND r_regionkey > 1 AND EXISTS (FROM a WHERE a.oid = n_nationkey AND attnum % 4 > 0) AS part,
  CASE WHEN (n_nationkey + r_regionkey) % 3 > 0 THEN 'x > ' || r_regionkey END AS row_filter FROM region JOIN nation ON (n_nationkey + r_regionkey) % 2 = 0)"""
_NAMES = ["AFRICA", "AMERICA", "ASIA"]
_NAMED = "publication IN ('AFRICA', 'AMERICA', 'ASIA')"


@registered(_CATALOG + """ SELECT n_name AS "table", string_agg(name, ',' ORDER BY attnum DESC) AS keys FROM nation JOIN a ON oid = n_nationkey AND attnum % 5 < 2 WHERE n_nationkey IN (SELECT oid FROM m) GROUP BY n_name""")
def catalog_key_columns(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return catalog.key_columns(c["classes"], c["attributes"], c["indexes"], c["members"]).select("table", F.array_join("keys", ",").alias("keys"))


@registered(_CATALOG + """ SELECT n_name AS "table", string_agg(name, ',' ORDER BY attnum) FILTER (NOT gen) AS before_18, string_agg(name, ',' ORDER BY attnum) AS since_18 FROM nation JOIN a ON oid = n_nationkey WHERE NOT dropped GROUP BY n_name HAVING bool_or(NOT gen)""")
def catalog_census(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    old, new = (catalog.census(c["classes"], c["attributes"], v).select("table", F.array_join("columns", ",").alias(name)) for v, name in ((150000, "before_18"), (180000, "since_18")))
    return old.join(new, "table")


def _projection_sql(joined: str, some: str) -> str:
    return (
        _CATALOG
        + f""", f AS (SELECT oid, CASE WHEN NOT bool_or(inserts) THEN 'FALSE' WHEN {some} THEN (SELECT string_agg('(' || y || ')', ' {joined} ' ORDER BY y) FROM unnest(list_distinct(list(row_filter) FILTER (inserts))) u(y) WHERE y IS NOT NULL) END AS row_filter FROM m WHERE {_NAMED} GROUP BY oid)
SELECT m."table", m.publication, (SELECT string_agg(name, ',' ORDER BY attnum) FROM a WHERE a.oid = m.oid AND NOT dropped AND CASE WHEN part THEN attnum % 4 > 0 ELSE NOT gen END) AS columns, f.row_filter FROM m JOIN f USING (oid) WHERE {_NAMED}"""
    )


@registered(_projection_sql("OR", "bool_and(NOT inserts OR row_filter IS NOT NULL)"))
def catalog_publication_projection(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    shown = catalog.projections(c["classes"], c["attributes"], c["publications"], c["members"], _NAMES)
    return shown.select("table", "publication", F.array_join("columns", ",").alias("columns"), "row_filter")


@registered(_projection_sql("AND", "bool_or(inserts AND row_filter IS NOT NULL)"))
def catalog_set_projection(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    shown = catalog.projections(c["classes"], c["attributes"], c["publications"], c["members"], _NAMES, every=True)
    return shown.select("table", "publication", F.array_join("columns", ",").alias("columns"), "row_filter")


@registered(
    _CATALOG
    + """, s AS (SELECT m."table", (SELECT string_agg(name, ',' ORDER BY attnum) FROM a WHERE a.oid = m.oid AND NOT dropped AND CASE WHEN part THEN attnum % 4 > 0 ELSE NOT gen END) AS columns FROM m)
SELECT "table", count(DISTINCT columns) AS n_lists, CASE WHEN bool_or(columns IS NULL) THEN 'snapshot_no_publishable_columns' WHEN count(DISTINCT columns) > 1 THEN 'snapshot_column_list_conflict' END AS reason FROM s GROUP BY "table\""""
)
def catalog_column_lists(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    every = [r["publication"] for r in c["publications"].collect()]
    return catalog.column_lists(catalog.projections(c["classes"], c["attributes"], c["publications"], c["members"], every)).drop("namespace")


_INFO = (
    _CATALOG
    + """, i AS (SELECT n_name AS "table", attnum, name, type, CASE n_nationkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'index' WHEN 2 THEN 'all_columns' ELSE 'nothing' END AS identity,
  CASE n_nationkey % 4 WHEN 0 THEN attnum % 5 < 2 WHEN 1 THEN attnum % 3 = 0 WHEN 2 THEN true ELSE false END AS is_key FROM nation JOIN a ON oid = n_nationkey WHERE NOT dropped)"""
)


@registered(_INFO + """ SELECT "table", attnum, name, type, identity, is_key FROM i""")
def catalog_table_info(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return catalog.table_info(c["classes"], c["attributes"], c["indexes"], c["classes"].select("namespace", "table")).select("table", "attnum", "name", "type", "identity", "is_key")


@registered(_INFO + """ SELECT "table", identity, string_agg(name || CASE WHEN is_key THEN '!' ELSE '' END, ',' ORDER BY attnum) AS columns, identity <> 'all_columns' AND NOT bool_or(is_key) AS keyless FROM i GROUP BY "table", identity""")
def catalog_relations(spark, sf_dir):
    """Grouped relations, and which of them have no key."""
    c = _catalog(spark, sf_dir)
    own = catalog.relations(catalog.table_info(c["classes"], c["attributes"], c["indexes"], c["classes"].select("namespace", "table"))).cache()
    bare = catalog.keyless(own).select("table", F.lit(True).alias("keyless"))
    shown = F.array_join(F.transform("columns", lambda x: F.concat(x["name"], F.when(x["is_key"], "!").otherwise(""))), ",")
    return own.join(bare, "table", "left").select("table", "identity", shown.alias("columns"), F.coalesce("keyless", F.lit(False)).alias("keyless"))


@registered(_CATALOG + """, w AS (SELECT n_name AS "table" FROM nation WHERE n_nationkey % 3 = 0), f AS (SELECT DISTINCT "table" FROM m WHERE publication = 'AFRICA') SELECT *, 'wanted' AS side FROM (FROM w EXCEPT FROM f) UNION ALL SELECT *, 'found' FROM (FROM f EXCEPT FROM w)""")
def catalog_table_gate(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    found = c["classes"].join(c["members"].filter("publication = 'AFRICA'"), "oid", "left_semi")
    return catalog.unequal(c["classes"].filter("oid % 3 = 0"), found).select("table", "side")


@registered(_CATALOG + """ SELECT n_name AS "table" FROM nation WHERE n_nationkey NOT IN (SELECT oid FROM a WHERE attnum % 5 < 2)""")
def catalog_missing_tables(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return catalog.missing(c["classes"], catalog.key_columns(c["classes"], c["attributes"], c["indexes"])).select("table")


@registered("SELECT count(*) AS n_rows, sum(c_custkey) AS keys, sum(length(c_name)) AS text_length, count(DISTINCT c_custkey) AS n_keys FROM customer")
def snapshot_rows_as_changes(spark, sf_dir):
    """Rows of a table as changes: values as text, the native key beside them."""
    own = catalog.as_changes(table(spark, sf_dir, "customer"), "public", "customer", ["c_custkey"]).filter("op = 'snapshot' and commit_lsn is null and ordinal = 0")
    text = lambda name: F.try_element_at("record", F.lit(name))
    return own.agg(F.count("*").alias("n_rows"), F.sum(text("c_custkey").cast("long")).alias("keys"), F.sum(F.length(text("c_name"))).alias("text_length"), F.count_distinct("raw_key.c_custkey").alias("n_keys"))


@registered("SELECT event_id AS seq, max((event_id * 7919) % 1000003) OVER (ORDER BY event_id) AS frontier FROM events")
def snapshot_frontier(spark, sf_dir):
    return backfill.frontier(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), ((F.col("event_id") * 7919) % 1000003).alias("lsn"))).select("seq", "frontier")


@registered("WITH c AS (SELECT event_id // 100 AS chunk, max((event_id * 7919) % 1000003) AS high FROM events GROUP BY 1) SELECT chunk, high FROM c WHERE high <= 999000")
def snapshot_closed_chunks(spark, sf_dir):
    chunks = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 100").alias("chunk")).agg(F.max((F.col("event_id") * 7919) % 1000003).alias("high"))
    return backfill.closed(chunks, 999_000)


_WRITES = """WITH w AS (SELECT event_type AS "table", CASE WHEN event_id % 1009 = 7 THEN NULL ELSE user_id END AS k, event_id % 5 = 0 AS moved FROM events),
k AS (SELECT "table", k FROM w WHERE k IS NOT NULL UNION SELECT "table", k + 100000 FROM w WHERE moved AND k IS NOT NULL),
n AS (SELECT "table", count(*) AS n_keys FROM k GROUP BY 1), t AS (SELECT "table", bool_or(k IS NULL) AS taint FROM w GROUP BY 1)"""


@registered(_WRITES + """ SELECT 'public.' || "table" AS "table", n_keys, CASE WHEN taint THEN 'untrackable' ELSE 'drop_cap' END AS reason FROM n JOIN t USING ("table") WHERE taint OR n_keys > 50""")
def snapshot_contention(spark, sf_dir):
    """Events as writes: some move a key, some have no key image."""
    pk = F.col("user_id").cast("string")
    moved, bare = F.col("event_id") % 5 == 0, F.col("event_id") % 1009 == 7
    of = lambda v: F.create_map(F.lit("pk"), v)
    own = table(spark, sf_dir, "events").select(
        F.when(bare, "delete").when(moved, "update").otherwise("insert").alias("op"), F.lit("public").alias("namespace"), F.col("event_type").alias("name"),
        F.when(~bare, of(F.when(moved, (F.col("user_id") + 100_000).cast("string")).otherwise(pk))).alias("record"), F.when(moved & ~bare, of(pk)).alias("old_record"),
    )
    return backfill.contention(backfill.written_keys(own, ["pk"]), True, 50)


@registered("WITH s AS (SELECT user_id AS xid, sum(length(props)) AS n_bytes FROM events GROUP BY 1), o AS (SELECT *, sum(n_bytes) OVER () - coalesce(sum(n_bytes) OVER (ORDER BY n_bytes DESC, xid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM s) SELECT xid, n_bytes, rest > 20000 AS spilled, sum(CASE WHEN rest > 20000 THEN n_bytes ELSE 0 END) OVER () > 100000 AS exhausted FROM o")
def held_and_spilled(spark, sf_dir):
    """Which buffers of open transactions go to disk, the largest first, and whether that is more than may."""
    return metrics.held_bytes(table(spark, sf_dir, "events").select(F.col("user_id").alias("xid"), F.length("props").alias("n_bytes")), 100_000, 20_000)


@registered("SELECT role AS prefix, count(DISTINCT (conv_id + 1) * 64 + turn) AS n FROM conversations GROUP BY role")
def standalone_messages(spark, sf_dir):
    """Standalone messages that came twice count once, by position."""
    from .streaming.sinks import once

    own = table(spark, sf_dir, "conversations").select(((F.col("conv_id") + 1) * 64 + F.col("turn")).alias("lsn"), F.col("role").alias("prefix"), F.col("text").cast("binary").alias("content"))
    return once(own.unionByName(own.filter("lsn % 3 = 0"))).groupBy("prefix").agg(F.count("*").alias("n"))
