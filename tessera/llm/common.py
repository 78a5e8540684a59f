"""Helpers that the training-data operators share: tables, the shared folder, cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none (tests on one machine) a temporary folder is set;
    on a cluster that would be local to one machine, so there it is an error."""
    for at in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir"), lambda: spark.sparkContext.getCheckpointDir()):
        if found := at():
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


#: The tables of the scopes that are open in a thread, innermost last.
_scopes = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those that are kept for the caller."""
    stack: list[list[str]] = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: the lineage ends there, and a
    lost executor costs a read of the table instead of the work before it. keep: past the innermost scope."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    scopes = _scopes.__dict__.setdefault("stack", [])[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are over, after a step that moved much; else they
    stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id written as decimal text, modulo n."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; after a task, its Python worker, which Spark keeps for later tasks, gives
    back the memory that it no longer uses."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied
