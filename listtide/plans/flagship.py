"""The first slice end to end: documents -> keys -> copy groups -> keepers -> ranked first page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups
from ..operators.listing import ListingQuery, matching
from .catalog.base import SOURCE_ORDER
from .catalog.joins import keyed_documents


def visible_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the verdict of the group passes joined back by id."""
    rows = keyed_documents(spark, sf)
    settled = groups.settle(rows.select("k", "source", *groups.PAYLOAD), ["k"], SOURCE_ORDER).select(
        "uuid", F.col("user_status").alias("_us"), F.col("excluded").alias("_ex"))
    out = rows.join(settled, "uuid", "left").withColumns({
        "user_status": F.coalesce("_us", "user_status"), "excluded": F.coalesce("_ex", "excluded"),
        "flagged_at": F.lit(None).cast("timestamp"), "business_name": F.lit(None).cast("string"),
        "published": F.lit(None).cast("string")})
    return out.drop("_us", "_ex")


def ranked_documents(spark: SparkSession, sf: str, n: int = 50) -> DataFrame:
    q = ListingQuery()
    return matching(visible_documents(spark, sf), q).orderBy(*q.ordering()).limit(n).select(
        "uuid", "source", "language", "user_status", "score")
