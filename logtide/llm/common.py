"""What the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, as_table: bool = False) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the one the session names in spark.checkpoint.dir. Only where
    none is named, as in tests, is a temporary one set. as_table writes Parquet,
    which is smaller for texts. Shuffle files of what came before are let go.
    """
    spark = df.sparkSession
    folder = _folder(spark)
    if as_table:
        path = f"{folder}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = spark.read.parquet(path)
    else:
        out = df.checkpoint()
    del df  # where the caller holds no other reference, its shuffle files can go now
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of the tables of cut() that df reads; what needs them must be made by then."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if not folder.rpartition("/")[2].startswith("table-"):
            raise ValueError(f"{folder} is no table of cut()")
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def whole_text(name: str = "text") -> Column:
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs: other columns, whatever their names, can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))


def runs(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters."""
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


_one: dict = {}


def _let_go() -> None:
    """Forgets the tables of this worker and gives their memory back to the machine: freed memory that allocators keep counts against the executor."""
    _one.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def only(make: Callable, *args):
    """make(*args), remembered until this worker asks for something else: operators that share workers don't pile up their tables."""
    if (make, args) not in _one:
        _let_go()
        _one[make, args] = make(*args)
    return _one[make, args]


def release() -> None:
    """Lets go of what this worker remembers for an operator before."""
    if _one:
        _let_go()
