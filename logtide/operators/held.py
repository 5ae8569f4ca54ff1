"""What is made once and read several times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

Hold = Callable[[DataFrame], DataFrame]


def as_it_is(df: DataFrame) -> DataFrame:
    return df


def as_table(df: DataFrame) -> DataFrame:
    """df as Parquet in the checkpoint folder of the session; on the executors' disks where a cluster names none."""
    context = df.sparkSession.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            return df.persist(StorageLevel.DISK_ONLY)
        folder = tempfile.mkdtemp(prefix="held-")
    path = f"{folder}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
