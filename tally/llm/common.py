"""What the operators share: the shared folder, written intermediate tables, data splits."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python. Whole texts are passed, so batches are kept short.
BATCH_ROWS = 256
#: Bytes of an Arrow batch, where the session knows that setting.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only on one machine (tests), and only where the session names none, a temporary folder is set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tally-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tally-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Freed memory goes back to the system; allocators keep much of it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a task that leaves no memory behind: Python workers live on, beside the next tasks of their executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # also what broadcasts of earlier tasks took
        yield from run(batches)
        give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def free_name(columns: list[str], name: str) -> str:
    """``name``, or with a number behind it if ``columns`` has it already."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def joined(rows: DataFrame, one: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has a row a key and, in ``size``, how many rows the key has.

    Keys of more than a ten-thousandth of ``total`` rows (and of more than 100) are broadcast, of which there are
    10,000 at most; so no task gets more of one key, and the rows of a frequent key stay where they are.
    """
    limit = max(100, total // 10_000)
    often = one.filter(F.col(size) > limit)
    hot = rows.join(F.broadcast(often), key)
    cold = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(one.filter(F.col(size) <= limit), key)
    return hot.unionByName(cold)
