"""Joins and groupings that hold when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fits_broadcast, materialize, rows_per_task


#: Most rows of a written side that is broadcast.
SMALL_ROWS = 100_000


def lookup(big: DataFrame, dim: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join `big` with `dim` (unique on `keys`), exact for every key frequency.

    A `dim` the optimizer proves small joins as it is and Spark broadcasts it. A derived `dim` of unknown size is
    written to the shared scratch folder first, after which its size is known. When it is large, keys with more than
    `listtide.rows_per_task` rows are counted first (map-side combined; at most rows / rows_per_task keys
    qualify, so that list is bounded and is broadcast), their rows are salted by a hash of `spread_by`, and
    the matching `dim` rows are repeated once per salt. Rows with a NULL key are spread as well."""
    keys = list(keys)
    if not fits_broadcast(dim):
        dim = materialize(dim, "lookup")
        small = fits_broadcast(dim) and dim.count() <= SMALL_ROWS  # a file's size says little about well compressed rows
    else:
        small = True
    if small:
        return big.join(dim, keys, how)
    per_task = rows_per_task(big.sparkSession)
    hot = (
        big.where(_all_set(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > per_task)
        .select(*keys, F.ceil(F.col("_n") / per_task).cast("int").alias("_salts"))
    )
    spread = F.xxhash64(*spread_by)
    left = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(~_all_set(keys), spread)  # no partner possible: any value deals these rows out
        .when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts").cast("long")))
        .otherwise(F.lit(0).cast("long")),
    ).drop("_salts")
    right = dim.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)).cast("long") - 1)),
    ).drop("_salts")
    return by_key(left, right, keys + ["_salt"], how).drop("_salt")


def by_key(left: DataFrame, right: DataFrame, keys: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Equi-join of two sides that both grow with the table, by sorted keys. The size of a well compressed table of a few columns is
    guessed far too low, and such a side would go through the driver to every executor."""
    return left.join(right.hint("merge"), keys, how)


def _all_set(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def in_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], present: bool = True) -> DataFrame:
    """Rows of `left` whose key occurs (or does not occur) in `right`; NULL-safe, unlike NOT IN.

    `right` is made distinct first, so a key repeated a billion times shuffles once per map task."""
    keys = list(keys)
    return left.join(right.select(*keys).distinct(), keys, "left_semi" if present else "left_anti")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Per key the row smallest in `order` (a total order), as a partial aggregate: no window, no big group."""
    pick = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in columns])


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    pick = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in columns])


_TOP_SALTS = 64


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread_by: str, rank: str = "rank") -> DataFrame:
    """The first `k` rows per key in `order` (a total order), numbered in `rank`. First per key and salt, then per
    key: however large one key and however many map tasks, no task sorts more than its share of the first step or
    64 k rows of the second. Each window sends at most k rows per group and task (group limit)."""
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    part = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(_TOP_SALTS))).withColumn(
        rank, F.row_number().over(first)).where(F.col(rank) <= k)
    return part.drop("_salt").withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)
