"""Session-level helpers: shared scratch space, size checks, settings."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = "listtide.rows_per_task"
DEFAULT_ROWS_PER_TASK = 2_000_000

_local_scratch: str | None = None


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory in the folder the cluster shares through `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a folder of its own."""
    global _local_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _local_scratch
    return f"{root.rstrip('/')}/listtide/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared scratch folder (survives executor loss)."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_setting = threading.Lock()


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings while the body runs. A streaming query takes them along when it is started, so only its start belongs inside."""
    with _setting:
        before = {k: spark.conf.get(k, None) for k in values}
        for k, v in values.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def broadcast_limit(spark: SparkSession) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    digits = raw.rstrip("bkmg")
    return int(digits) * units.get(raw[len(digits):], 1)


def fits_broadcast(df: DataFrame) -> bool:
    """Does the optimizer's own size estimate keep `df` under the session's broadcast limit?"""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= broadcast_limit(df.sparkSession)


#: Bytes of files that go into one task where a few bytes a row make much work.
SHARE = 2 << 20


def spread(df: DataFrame, share: int | None = None) -> DataFrame:
    """Rows dealt out over all cores ahead of regex-heavy column work, only when the input has fewer partitions
    than cores (small files); an input with enough partitions is left as it is. With `share` there are also so many partitions that none
    stands for more than about `share` bytes of the files, so that the longest task does not grow with the input; meant for short rows, as
    these are shuffled. For plain scans: the partitions of a plan with a shuffle are only known by running it."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    if share:
        size = sum(file_sizes(df))
        parts = max(parts, -(-size // share))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def file_sizes(df: DataFrame) -> list[int]:
    """Bytes of the files that a plain scan reads."""
    conf, path = df.sparkSession._jsc.hadoopConfiguration(), df.sparkSession._jvm.org.apache.hadoop.fs.Path
    return [p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, df.inputFiles())]
