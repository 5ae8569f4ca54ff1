"""Tuples to records: values, nulls and columns that were not sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(columns: Column, values: Column) -> Column:
    return F.arrays_zip(F.transform(columns, lambda c: c["name"]).alias("n"), values.alias("t"))


def record(columns: Column, values: Column) -> Column:
    """Name to text. A null is in the map; a column that was not sent is not."""
    sent = F.filter(_pairs(columns, values), lambda p: p["t"]["state"] != "u")
    return F.map_from_entries(F.transform(sent, lambda p: F.struct(p["n"], p["t"]["text"])))


def unchanged(columns: Column, values: Column) -> Column:
    return F.transform(F.filter(_pairs(columns, values), lambda p: p["t"]["state"] == "u"), lambda p: p["n"])


def keys_of(columns: Column) -> Column:
    return F.transform(F.filter(columns, lambda c: c["is_key"]), lambda c: c["name"])


def old_record(columns: Column, values: Column, old_kind: Column) -> Column:
    """The old image: the whole row, or its key columns; the whole row if the relation has no keys."""
    whole, keys = record(columns, values), keys_of(columns)
    return F.when(old_kind == "O", whole).when(old_kind == "K", F.when(F.size(keys) == 0, whole).otherwise(F.map_filter(whole, lambda k, _: F.array_contains(keys, k))))


def ordered_pairs(values: Column) -> Column:
    """A map as text in key order, to compare what several decoders deliver."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL")))), ",")
