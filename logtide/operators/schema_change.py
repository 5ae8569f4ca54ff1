"""Relation announcements against the ones before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify(relations: DataFrame) -> DataFrame:
    """seq, relid, kind, change, detail for each version that changes something.

    relations: seq, relid, identity, columns array<struct<name,type,type_modifier,is_key>>.
    What is checked first wins: identity, dropped columns, types, keys, added columns.
    """
    previous = W.partitionBy("relid").orderBy("seq")
    both = relations.withColumn("old", F.lag(F.struct("identity", "columns")).over(previous)).filter("old is not null")
    names = lambda c: F.transform(c, lambda x: x["name"])
    keys = lambda c: F.array_sort(F.transform(F.filter(c, lambda x: x["is_key"]), lambda x: x["name"]))
    dropped = F.array_except(names(F.col("old.columns")), names(F.col("columns")))
    added = F.array_except(names(F.col("columns")), names(F.col("old.columns")))
    retyped = F.filter("columns", lambda c: F.exists("old.columns", lambda o: (o["name"] == c["name"]) & ((o["type"] != c["type"]) | (o["type_modifier"] != c["type_modifier"]))))
    change = (
        F.when(F.col("identity") != F.col("old.identity"), "replica_identity_changed")
        .when(F.size(dropped) > 0, "column_dropped")
        .when(F.size(retyped) > 0, "type_changed")
        .when(keys(F.col("columns")) != keys(F.col("old.columns")), "replica_identity_changed")
        .when(F.size(added) > 0, "column_added")
    )
    detail = F.when(F.col("change") == "column_dropped", F.array_join(dropped, ",")).when(F.col("change") == "type_changed", F.array_join(names(retyped), ",")).when(F.col("change") == "column_added", F.array_join(added, ","))
    kind = F.when(F.col("change") == "column_added", "additive").otherwise("destructive")
    return both.withColumn("change", change).filter("change is not null").select("seq", "relid", kind.alias("kind"), "change", detail.alias("detail"))
