"""Structured Streaming ingest: each micro-batch is merged into the next table version, idempotently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.actions import compact
from ..operators.merge import FILL, OVERWRITE, REPLACE, Policy, drop_dismissed, merge
from ..session import settings
from ..sources.feeds import ad_listings, changelog_entries, read_changelog, stream_changelog
from ..sources.versions import VersionedTable, held


def merge_changelog_batch(table: VersionedTable, entries: DataFrame, tombstones: DataFrame | None = None) -> int:
    """Latest state per key of the batch over the stored state. A re-sent or re-ordered batch changes nothing:
    a stored row only gives way to a later feed position."""
    pos = F.struct("seq", "idx")
    cols = ["seq", "idx", "status", "title", "business_name", "municipal", "stamp"]
    rows = entries.where(~F.col("malformed")).select("uuid", *cols)
    if tombstones is not None:
        rows = drop_dismissed(rows, tombstones)

    def newest(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        every = batch if stored is None else batch.unionByName(stored.select("uuid", *cols))
        return every.groupBy("uuid").agg(F.max_by(F.struct(*cols), pos).alias("_r")).select("uuid", "_r.*")

    return table.update(rows, newest)


def run_changelog(spark: SparkSession, landing: str, checkpoint: str, table: VersionedTable,
                  tombstones: DataFrame | None = None, files_per_trigger: int = 100, from_tip: bool = False,
                  on_batch: Callable[[int, DataFrame], None] | None = None) -> None:
    """Process every landed page not yet read, then stop; the checkpoint names the next unread page.

    With `from_tip` the first run notes the newest landed page and passes nothing on; that run and later ones take only
    entries behind it, and pages without a position (they cannot be parsed) of files that had none when the tip was noted."""
    tip = _tip(spark, landing, checkpoint) if from_tip else None
    def each(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            if batch.isEmpty():
                return
            merge_changelog_batch(table, batch, tombstones)
            if on_batch:
                on_batch(batch_id, batch)

    pages = stream_changelog(spark, landing, files_per_trigger)
    if tip is not None:
        before = spark.read.parquet(_broken_path(checkpoint)).withColumn("_before", F.lit(True))
        pages = pages.withColumn("_file", F.col("_metadata.file_path")).join(before, "_file", "left").where(
            (F.col("seq") > tip) | (F.col("seq").isNull() & F.col("_before").isNull())).drop("_file", "_before")
    query = (changelog_entries(pages).writeStream
             .option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start())
    query.awaitTermination()


def _tip(spark: SparkSession, landing: str, checkpoint: str) -> int:
    """The newest page when the feed was first looked at; kept beside the checkpoint."""
    path = f"{checkpoint.rstrip('/')}-tip"
    try:
        return spark.read.parquet(path).first()[0]
    except AnalysisException:
        # Not a filter on seq: the reader would take it over and drop pages that cannot be parsed.
        read_changelog(spark, landing).groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.max(F.col("seq").isNull()).alias("broken")).where(
            "broken").select("_file").write.mode("overwrite").parquet(_broken_path(checkpoint))
        read_changelog(spark, landing).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("tip")).write.parquet(path)
        return spark.read.parquet(path).first()[0]


def _broken_path(checkpoint: str) -> str:
    """Where the files with broken pages of that moment are kept."""
    return f"{checkpoint.rstrip('/')}-tip-broken"


# A join of streams keeps every entry and ad that may still meet one: on disk, one store a partition, under a fixed share of memory
# whatever their number. A checkpoint that was begun otherwise goes on as it began.
_STATE = "spark.sql.streaming.stateStore"
JOIN_STATE = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.allowFAllocate": "false",  # many small stores: no room is taken ahead
    f"{_STATE}.maintenanceInterval": "10s",  # files of a run that has ended go soon
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def feed_listings(entries: DataFrame, details: DataFrame, wait: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """A stream of feed entries (with an event time `ts`) joined with the stream of their ads: a row for each entry and ad that lands
    within `wait` after it, or the entry alone once no ad can come any more. `delay` is how late either side may land."""
    ads = ad_listings(details, "ts").withColumnRenamed("ts", "_ad_ts").withWatermark("_ad_ts", delay)
    ads = ads.select(F.col("uuid").alias("_ad"), "_ad_ts", *[F.col(c).alias(f"_{c}") for c in ads.columns if c not in ("uuid", "_ad_ts")])
    own = entries.withWatermark("ts", delay)
    met = (F.col("uuid") == F.col("_ad")) & F.col("_ad_ts").between(F.col("ts"), F.col("ts") + F.expr(f"INTERVAL {wait}"))
    both = own.join(ads, met, "leftOuter")
    first = ("title", "business_name", "municipal")
    rest = [c for c in ads.columns if c not in ("_ad", "_ad_ts", "_status", *(f"_{c}" for c in first))]
    return both.select(
        "uuid", F.struct("seq", "idx").alias("pos"), "status", F.col("_ad").isNotNull().alias("with_ad"),
        *[F.coalesce(f"_{c}", c).alias(c) for c in first], *[F.col(c).alias(c[1:]) for c in rest])


def run_feed(entries: DataFrame, details: DataFrame, checkpoint: str, table: VersionedTable, wait: str = "2 hours", delay: str = "1 hour",
             on_batch: Callable[[int, DataFrame], None] | None = None) -> None:
    """Merge all joined rows that can be had by now into `table`: of several entries of a key the last position counts, and an entry
    without its ad changes status and title only. `on_batch` gets every batch, for counts of entries whose ad never came."""
    policy = {**{c: FILL for c in OVERWRITE}, "status": REPLACE, "title": REPLACE}

    def fold(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        if stored is None:
            stored = new.limit(0).drop("pos", "with_ad")
        return merge(stored, new.drop("with_ad"), policy, order="pos").drop("_outcome")

    def each(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            if batch.isEmpty():
                return
            table.update(batch, fold)
            if on_batch:
                on_batch(batch_id, batch)

    joined = feed_listings(entries, details, wait, delay)
    with settings(joined.sparkSession, JOIN_STATE):
        query = joined.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()


def fresh_entries(entries: DataFrame, delay: str = "7 days", ts: str = "ts") -> DataFrame:
    """Streaming partial progress: an entry re-sent with the same stamp inside the watermark is dropped; state is
    one row per (key, stamp) and expires with the watermark."""
    return entries.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["uuid", "stamp"])


def run_actions(spark: SparkSession, actions: DataFrame, checkpoint: str, log: VersionedTable) -> None:
    """A stream of user actions kept as a compacted log, whose fold gives the user columns. The order in which
    batches arrive does not matter: per key and field the latest (ts, seq) wins."""
    def each(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            if not batch.isEmpty():
                log.update(batch, lambda stored, new: compact(new if stored is None else stored.unionByName(new)))

    query = (actions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_source(spark: SparkSession, stream: DataFrame, checkpoint: str, table: VersionedTable,
               policy: dict[str, Policy], tombstones: DataFrame) -> None:
    """A stream of listing rows merged under a source's policy; tombstoned keys never come back."""
    def each(batch: DataFrame, batch_id: int) -> None:
        live = drop_dismissed(batch, tombstones)
        with held(live):
            table.update(live, lambda stored, new: merge(stored, new, policy).drop("_outcome"))

    query = (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
             .trigger(availableNow=True).start())
    query.awaitTermination()
