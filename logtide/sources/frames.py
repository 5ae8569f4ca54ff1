"""Schemas of the log, and a file-replay source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAMES = "seq long, wal_end long, kind string, payload binary, in_stream boolean"
COLUMNS = "array<struct<name:string,type:string,type_modifier:int,is_key:boolean>>"
TUPLE = "array<struct<state:string,text:string>>"
MESSAGES = (
    "seq long, kind string, xid long, subxid long, lsn long, end_lsn long, ts_us long, first_segment boolean, relid long, "
    f"namespace string, name string, replica_identity string, columns {COLUMNS}, new_tuple {TUPLE}, old_tuple {TUPLE}, old_kind string, "
    "truncated array<long>, options array<string>, transactional boolean, prefix string, content binary, reason string"
)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Replays a folder of frame files; a file is one delivery. Admission is bounded by files_per_trigger."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
