"""Reading of the given tables and small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listtide.session import scratch_dir

#: Rows with this remainder are held out of every training: crc32 of the id as text, modulo 3.
FOLDS, HELD_OUT = 3, 1

BATCH_ROWS, _BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: later reads do not compute them again and survive lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python in batches of at most BATCH_ROWS texts, so that a batch of long ones stays small in memory."""
    rows = int(spark.conf.get(_BATCH_SETTING))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def held_out(doc_id: Column) -> Column:
    """Is the row outside every training set? A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def share_of(key: Column, share: float) -> Column:
    """A repeatable choice of about `share` of all rows by their key."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Run) -> Run:
    """`run` for mapInArrow, after which the worker gives freed memory back: workers live on from task to task and from stage to stage."""
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return through
