"""A change log to the state that it leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_of(commit_lsn: str = "commit_lsn", ordinal: str = "ordinal") -> Column:
    """A change's place in the log, with room for the two halves of a key change."""
    return F.struct(F.col(commit_lsn).cast("long").alias("lsn"), F.col(ordinal).cast("long").alias("n"), F.lit(1).alias("half"))


def split_key_changes(changes: DataFrame, key: str, old_key: str, place: str = "_place") -> DataFrame:
    """An update whose old key differs becomes a delete of the old key right before it."""
    moved = F.col(old_key).isNotNull() & (F.col(old_key) != F.col(key)) & (F.col("op") == "update")
    halves = changes.withColumn("_gone", F.explode(F.when(moved, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    gone = lambda then, c: F.when(F.col("_gone"), then).otherwise(F.col(c)).alias(c)
    own = {key: gone(F.col(old_key), key), "op": gone(F.lit("delete"), "op"), place: gone(F.col(place).withField("half", F.lit(0)), place)}
    return halves.select(*(own.get(c, F.col(c)) for c in changes.columns))


def replay(changes: DataFrame, keys: Sequence[str], values: Sequence[str], unchanged: str | None = None, place: str = "_place", truncated: DataFrame | None = None, gone: str | None = None) -> DataFrame:
    """Keys and values of the rows that are there after all changes, last write first.

    changes: op (insert, update, delete), keys, values and place. `unchanged`
    names an array of columns that an update did not send. A delete or insert
    starts a row anew, so a value that was sent before the last of them is gone.
    One aggregation with partial sums: no window, and a hot key is one row a task
    after the partial step. truncated: places at which the table was emptied.
    gone: a name under which deleted keys are returned too, as a flag.
    """
    if truncated is not None:
        changes = changes.join(F.broadcast(truncated.select(F.max(place).alias("_emptied"))), how="cross").filter(F.col("_emptied").isNull() | (F.col(place) > F.col("_emptied")))
    where = F.col(place)
    resets = F.when(F.col("op").isin("insert", "delete"), where)
    sent = lambda c: F.col("op") != "delete" if unchanged is None else (F.col("op") != "delete") & ~F.coalesce(F.array_contains(unchanged, c), F.lit(False))
    last = changes.groupBy(*keys).agg(
        F.max_by("op", where).alias("_op"),
        F.max(resets).alias("_reset"),
        *(F.max_by(F.struct(F.col(v).alias("v"), where.alias("p")), F.when(sent(v), where)).alias(v) for v in values),
    )
    held = lambda v: F.when(F.col("_reset").isNull() | (F.col(f"{v}.p") >= F.col("_reset")), F.col(f"{v}.v"))
    deleted = F.col("_op") == "delete"
    own = [*keys, *(held(v).alias(v) for v in values)]
    return last.select(*own, deleted.alias(gone)) if gone else last.filter(~deleted).select(*own)


def merge_mirror(mirror: DataFrame, changes: DataFrame, keys: Sequence[str], values: Sequence[str], unchanged: str | None = None, place: str = "_place") -> DataFrame:
    """The mirror after more changes: its rows take part as inserts before all of them."""
    start = changes.select(place).schema[place].dataType.simpleString()
    base = mirror.withColumn("op", F.lit("insert")).withColumn(place, F.struct(F.lit(-1).cast("long").alias("lsn"), F.lit(-1).cast("long").alias("n"), F.lit(1).alias("half")).cast(start))
    if unchanged is not None:
        base = base.withColumn(unchanged, F.array().cast("array<string>"))
    columns = ["op", place, *keys, *values, *([unchanged] if unchanged else [])]
    return replay(changes.select(*columns).unionByName(base.select(*columns)), keys, values, unchanged, place)
