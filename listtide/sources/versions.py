"""Versioned tables: a snapshot counts once its directory is committed; the newest N are kept."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the stored rows and a batch become the rows that are stored next.
Fold = Callable[[DataFrame | None, DataFrame], DataFrame]

KEEP = 10  # fixed value: snapshots kept


@contextmanager
def held(batch: DataFrame) -> Iterator[None]:
    """A micro-batch is asked several times (is it empty, which buckets, the rows); kept meanwhile, so that its state and joins run once."""
    batch.persist()
    try:
        yield
    finally:
        batch.unpersist()


class VersionedTable:
    """`root/v=000001`, `root/v=000002`, ... A version without `_SUCCESS` never counts, so a write is all or nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, committed: bool) -> list[int]:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        out = []
        for st in self._fs.listStatus(root):
            m = re.fullmatch(r"v=(\d+)", st.getPath().getName())
            if m and (not committed or self._fs.exists(self._path(f"{self.root}/{m[0]}/_SUCCESS"))):
                out.append(int(m[1]))
        return sorted(out)

    def versions(self) -> list[int]:
        return self._numbers(committed=True)

    def directory(self, version: int) -> str:
        return f"{self.root}/v={version:06d}"

    def write(self, df: DataFrame, keep: int = KEEP) -> int:
        """Write the next version (never a path the plan reads) and drop versions beyond the newest `keep`."""
        version = max(self._numbers(committed=False), default=0) + 1
        df.write.mode("error").parquet(self.directory(version))
        for old in self.versions()[:-keep]:
            self._fs.delete(self._path(self.directory(old)), True)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        number = version if version is not None else max(self.versions(), default=None)
        if number is None:
            raise ValueError(f"no committed version below {self.root}")
        return self.spark.read.parquet(self.directory(number))

    def update(self, batch: DataFrame, fold: Fold) -> int:
        """The next version by `fold` of the stored rows (None before the first version) and `batch`."""
        return self.write(fold(self.read() if self.versions() else None, batch))


class BucketedTable(VersionedTable):
    """A versioned table in buckets of its key: an update rewrites the buckets that the batch has keys of.

    `root/data/w=000007/bucket=12/` holds rows, `root/v=000007` lists for every bucket where its rows are, so a version carries
    untouched buckets by reference. A directory is dropped when no kept version refers to it. The number of buckets is fixed when
    the table is first written."""

    def __init__(self, spark: SparkSession, root: str, key: str = "uuid", buckets: int = 64):
        super().__init__(spark, root)
        self.key = key
        self.buckets = self._listing().first()["buckets"] if self.versions() else buckets

    def _listing(self, version: int | None = None) -> DataFrame:
        return super().read(version)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def places(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> directory below root; buckets without rows are not there."""
        return {r["bucket"]: r["place"] for r in self._listing(version).where("place IS NOT NULL").collect()}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        listing = self._listing(version)
        schema = listing.first()["schema"]
        some = [f"{self.root}/{p}" for b, p in sorted(self.places(version).items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*some) if some else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, keep: int = KEEP) -> int:
        """All rows anew."""
        return self._commit(df, {}, keep)

    def update(self, batch: DataFrame, fold: Fold, keep: int = KEEP) -> int:
        """`fold` sees the stored rows of the touched buckets only and must not invent other keys than those and the batch's."""
        if not self.versions():
            return self.write(fold(None, batch), keep)
        touched = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())
        if not touched:
            return self.versions()[-1]
        carried = {b: p for b, p in self.places().items() if b not in touched}
        return self._commit(fold(self.read(only=touched), batch), carried, keep)

    def _commit(self, df: DataFrame, carried: dict[int, str], keep: int) -> int:
        version = max(self._numbers(committed=False), default=0) + 1
        data = f"data/w={version:06d}"
        self._fs.delete(self._path(f"{self.root}/{data}"), True)  # what a failed write of this number left
        df.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{data}")
        new = {int(m[1]): f"{data}/{m[0]}" for st in self._fs.listStatus(self._path(f"{self.root}/{data}"))
               if (m := re.fullmatch(r"_bucket=(\d+)", st.getPath().getName()))}
        places = sorted({**carried, **new}.items()) or [(0, None)]
        listing = self.spark.createDataFrame([(b, p, self.buckets, _ddl(df)) for b, p in places], "bucket int, place string, buckets int, schema string")
        listing.coalesce(1).write.mode("error").parquet(self.directory(version))  # at most one row a bucket
        self._drop_old(keep)
        return version

    def _drop_old(self, keep: int) -> None:
        known = self.versions()
        for old in known[:-keep]:
            self._fs.delete(self._path(self.directory(old)), True)
        used = {p.split("/")[1] for v in known[-keep:] for p in self.places(v).values()}
        newest = f"w={known[-1]:06d}"
        for st in self._fs.listStatus(self._path(f"{self.root}/data")):
            name = st.getPath().getName()
            if name not in used and name < newest:
                self._fs.delete(st.getPath(), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
