"""What publications and replication sets let through."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    """A table's place in one publication or set."""

    publication: str
    table: str
    columns: tuple[str, ...] | None = None
    row_filter: str | None = None
    inserts: bool = True


def row_filter_any(entries: Iterable[Entry]) -> str | None:
    """Publications: a row passes if one that publishes inserts lets it; one without filter lets all. None: no filter."""
    own = [e.row_filter for e in entries if e.inserts]
    if not own:
        return "false"
    return None if None in own else " OR ".join(f"({f})" for f in sorted(set(own)))


def row_filter_all(entries: Iterable[Entry]) -> str | None:
    """Sets: all filters hold together, also beside a set without one."""
    own = [e.inserts and e.row_filter for e in entries if e.inserts]
    if not own:
        return "false"
    return " AND ".join(f"({f})" for f in sorted({f for f in own if f})) or None


def published(df: DataFrame, entries: Sequence[Entry], every: bool = False) -> DataFrame:
    """Rows and columns of df that its entries publish, columns in table order."""
    lists = {e.columns for e in entries}
    if len(lists) > 1:
        raise ValueError("snapshot_column_list_conflict")
    chosen = next(iter(lists), None)
    if chosen is not None and not chosen:
        raise ValueError("snapshot_no_publishable_columns")
    predicate = (row_filter_all if every else row_filter_any)(entries)
    out = df if predicate is None else df.filter(predicate)
    return out if chosen is None else out.select(*(c for c in df.columns if c in chosen))


def published_tables(catalog: DataFrame, names: Sequence[str]) -> DataFrame:
    """Tables of all named publications, once each; fails if a name does not exist."""
    found = catalog.filter(F.col("pub").isin(*names))
    missing = set(names) - {r["pub"] for r in found.select("pub").distinct().collect()}
    if missing:
        raise ValueError("publication_missing")
    return found.select("table").distinct()


def column_conflicts(catalog: DataFrame) -> DataFrame:
    """Tables with more than one column list."""
    return catalog.groupBy("table").agg(F.count_distinct(F.coalesce(F.array_join(F.array_sort("columns"), ","), F.lit("*"))).alias("n_lists")).filter("n_lists > 1")


def without_generated(columns: DataFrame, server_version: int) -> DataFrame:
    """Before version 18 of the server generated columns are not published."""
    return columns if server_version >= 180000 else columns.filter("not generated")
