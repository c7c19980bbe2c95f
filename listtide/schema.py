"""The unified listing row, its side tables and its enumerations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workflow states in display order, and the groups other operators refer to.
USER_STATUSES = ("new", "interesting", "applied", "interview", "offer", "rejected", "ignored", "archived")
BACKLOG_STATUSES = ("new", "interesting")
TRASH_STATUS = "archived"

CATEGORY = T.ArrayType(T.StructType([
    T.StructField("level1", T.StringType()), T.StructField("level2", T.StringType()),
]))
BREAKDOWN = T.MapType(T.StringType(), T.StructType([
    T.StructField("points", T.IntegerType()), T.StructField("matched", T.ArrayType(T.StringType())),
]))

_TEXT = (
    "uuid status title business_name municipal county description employer_name employer_orgnr "
    "application_url application_due link published expires updated engagement_type extent sector "
    "raw_json user_status source language exclusion_reason salary_text description_borrowed_from notes"
).split()
_TIMES = "first_seen_at last_synced_at description_fetch_attempted_at flagged_at applied_at".split()

LISTING = T.StructType(
    [T.StructField(c, T.StringType(), c != "uuid") for c in _TEXT]
    + [T.StructField("occupation_categories", CATEGORY)]
    + [T.StructField(c, T.TimestampType()) for c in _TIMES]
    + [T.StructField("application_due_sort", T.DateType())]
    + [T.StructField(c, T.IntegerType()) for c in ("score", "score_it", "extent_percent", "salary_min")]
    + [T.StructField(c, T.BooleanType()) for c in ("excluded", "manually_added")]
    + [T.StructField(c, BREAKDOWN) for c in ("score_breakdown", "score_it_breakdown")]
)

TOMBSTONE = T.StructType([
    T.StructField("uuid", T.StringType()), T.StructField("dismissed_at", T.TimestampType()),
])
ACTION = T.StructType([
    T.StructField("uuid", T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])
ATTEMPT = T.StructType([
    T.StructField("uuid", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("outcome", T.StringType()),
])
RUN = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("watermark", T.TimestampType()),
    T.StructField("source", T.StringType()), T.StructField("stats", T.MapType(T.StringType(), T.LongType())),
    T.StructField("warning", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("stage_errors", T.ArrayType(T.StructType([
        T.StructField("stage", T.StringType()), T.StructField("error", T.StringType()),
    ]))),
])

# Columns a new row gets when its source says nothing about them.
DEFAULTS: dict[str, object] = {"user_status": "new", "excluded": False, "manually_added": False}


def align(df: DataFrame, schema: T.StructType = LISTING, defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """Bring `df` to `schema`: missing columns appear as their default, NULL defaults are filled."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        col: Column = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            col = F.coalesce(col, F.lit(defaults[f.name]).cast(f.dataType))
        out.append(col.alias(f.name))
    return df.select(*out)


def add_marker(df: DataFrame, name: str, backfill: Column) -> DataFrame:
    """One-time backfill: the rule applies only when the marker column does not exist yet."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.coalesce(backfill, F.lit(False)))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources in one schema; a column one source lacks is NULL there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def check_status(value: str) -> str:
    if value not in USER_STATUSES:
        raise ValueError(f"unknown user status: {value!r}")
    return value
