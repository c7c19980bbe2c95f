"""Positions in a total order without ordering everything: pages found by repeated histograms, running sums by ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, rows_per_task

#: Split points of one histogram.
SPLITS = 48


@dataclass(frozen=True)
class SortKey:
    """A column of the order; nulls come last."""

    name: str
    descending: bool = False

    def order(self) -> Column:
        return F.desc_nulls_last(self.name) if self.descending else F.asc_nulls_last(self.name)

    def before(self, value: object) -> Column:
        c = F.col(self.name)
        if value is None:
            return c.isNotNull()
        return F.coalesce(c > F.lit(value) if self.descending else c < F.lit(value), F.lit(False))

    def same(self, value: object) -> Column:
        return F.col(self.name).isNull() if value is None else F.coalesce(F.col(self.name) == F.lit(value), F.lit(False))


def before(keys: Sequence[SortKey], point: Sequence[object]) -> Column:
    """Does the row stand before `point` in the order of `keys`?"""
    out = F.lit(False)
    for key, value in zip(reversed(keys), reversed(point), strict=True):
        out = key.before(value) | (key.same(value) & out)
    return out


def _within(keys: Sequence[SortKey], low: Sequence[object] | None, high: Sequence[object] | None) -> Column:
    """From `low` on and before `high`. What that says of the first column alone is stated too, as a scan can use it."""
    first, out = keys[0], F.lit(True)
    if low is not None:
        out = out & ~first.before(low[0]) & ~before(keys, low)
    if high is not None:
        out = out & (first.before(high[0]) | first.same(high[0])) & before(keys, high)
    return out


def narrowed(rows: DataFrame, keys: Sequence[SortKey], start: int, size: int, n: int, most: int) -> tuple[DataFrame, int]:
    """A part of `rows` (n rows) that holds the places start to start + size of the order, and the start within it.

    Each round takes split points from SPLITS rows (chosen by a hash of their keys), counts the rows between them, and keeps the
    stretches that the page lies in, until they hold at most `most` rows. Only points and counts reach the driver. Rows that agree
    in all keys cannot be told apart, so a run of them longer than `most` stays whole."""
    names = [k.name for k in keys]
    while n > most:
        some = rows.select(*names).orderBy(F.xxhash64(*names), *names).limit(SPLITS).orderBy(*[k.order() for k in keys])
        points = [tuple(r) for r in some.distinct().orderBy(*[k.order() for k in keys]).collect()]
        place = sum((F.when(before(keys, p), 0).otherwise(1) for p in points), F.lit(0))
        counts = {r[0]: r[1] for r in rows.groupBy(place.alias("place")).agg(F.count(F.lit(1))).collect()}
        passed, low, high, held = 0, None, None, 0
        for k in range(len(points) + 1):
            here = counts.get(k, 0)
            if low is None and passed + here > start:
                low, skipped = k, passed
            if low is not None and high is None:
                held += here
                if passed + here >= start + size:
                    high = k
            passed += here
        if low is None:
            return rows.limit(0), 0
        high = len(points) if high is None else high
        if held == n:
            break
        rows = rows.where(_within(keys, points[low - 1] if low else None, points[high] if high < len(points) else None))
        start, n = start - skipped, held
    return rows, start


def running_sum(table: DataFrame, key: str, value: str, below: str, total: str) -> DataFrame:
    """`table` (one row per `key`) with the sum of `value` over all smaller keys and over all keys.

    Two passes: rows are dealt into ranges of keys, each range adds up its own rows, and the sums of the ranges before it (one number
    for each range) are added. No task holds more than its range."""
    table = materialize(table.where(F.col(key).isNotNull()), "running")
    parts = -(-table.count() // rows_per_task(table.sparkSession)) or 1
    ranged = table.repartitionByRange(parts, key) if parts > 1 else table.coalesce(1)
    dealt = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = {r[0]: r[1] or 0 for r in dealt.groupBy("_range").agg(F.sum(value)).collect()}
    # A literal list with one number for each range.
    starts = [sum(sums.get(j, 0) for j in range(k)) for k in range(parts)]
    own = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_range"))
    return dealt.withColumn(below, F.coalesce(F.sum(value).over(own), F.lit(0)) + offset).withColumn(
        total, F.lit(sum(sums.values())).cast("long")).drop("_range")
