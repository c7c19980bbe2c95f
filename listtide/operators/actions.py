"""The append-only user action log folded into user columns, and failed attempts per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import USER_STATUSES
from .merge import KEY
from .skew import by_key, lookup


def latest_values(actions: DataFrame) -> DataFrame:
    """Last value per (uuid, field); `seq` breaks ties of the timestamp."""
    return actions.groupBy("uuid", "field").agg(
        F.max_by(F.struct("value", "ts"), F.struct("ts", "seq")).alias("_v"),
    ).select("uuid", "field", F.col("_v")["value"].alias("value"), F.col("_v")["ts"].alias("ts"))


def compact(actions: DataFrame) -> DataFrame:
    """The shortest log with the same fold: per field the last valid action, and the last 'applied' besides. Logs
    can be compacted in parts and in any order."""
    valid = (F.col("field") != "status") | F.col("value").isin(*USER_STATUSES)
    applied = (F.col("field") == "status") & (F.col("value") == "applied")
    last = F.max_by(F.struct("value", "ts", "seq"), F.struct("ts", "seq"))
    return actions.where(valid).groupBy("uuid", "field", applied.alias("_applied")).agg(last.alias("_v")).select(
        "uuid", "field", "_v.*")


def fold(actions: DataFrame) -> DataFrame:
    """One row per uuid: last status, the time of the last 'applied', flag time, note, profile. Unknown
    status names are ignored; one partial aggregate, so a key with very many actions is combined map-side."""
    order = F.struct("ts", "seq")

    def last(field: str, value: Column, ok: Column | None = None) -> Column:
        mine = F.col("field") == field
        return F.max_by(F.struct(value.alias("v")), F.when(mine & ok if ok is not None else mine, order))["v"]

    valid = F.col("value").isin(*USER_STATUSES)
    return actions.groupBy("uuid").agg(
        last("status", F.col("value"), valid).alias("user_status"),
        F.max(F.when((F.col("field") == "status") & (F.col("value") == "applied"), F.col("ts"))).alias("applied_at"),
        F.max(F.when(F.col("field") == "flag", order)).isNotNull().alias("has_flag"),
        last("flag", F.when(F.col("value") == "1", F.col("ts"))).alias("flagged_at"),
        F.max(F.when(F.col("field") == "note", order)).isNotNull().alias("has_note"),
        last("note", F.nullif(F.col("value"), F.lit(""))).alias("notes"),
        last("profile", F.col("value")).alias("profile"),
    )


def apply_actions(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """User columns after the log: fields no action touched keep their value."""
    f = fold(actions).select(KEY, *[F.col(c).alias(f"_a_{c}") for c in (
        "user_status", "applied_at", "has_flag", "flagged_at", "has_note", "notes")])
    new = {
        "user_status": F.coalesce("_a_user_status", "user_status"),
        "applied_at": F.coalesce("_a_applied_at", "applied_at"),
        "flagged_at": F.when(F.col("_a_has_flag"), F.col("_a_flagged_at")).otherwise(F.col("flagged_at")),
        "notes": F.when(F.col("_a_has_note"), F.col("_a_notes")).otherwise(F.col("notes")),
    }
    return by_key(rows, f, KEY, "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


MAX_FAILED_ATTEMPTS = 3


def failed_attempts(attempts: DataFrame, limit: int = MAX_FAILED_ATTEMPTS) -> DataFrame:
    """Failures per uuid since its last success, and whether to give up. `outcome` is 'ok' or 'failed'."""
    last_ok = attempts.where(F.col("outcome") == "ok").groupBy("uuid").agg(F.max("ts").alias("_ok"))
    joined = lookup(attempts, last_ok, ["uuid"], ["ts"])
    open_failure = (F.col("outcome") == "failed") & (F.col("_ok").isNull() | (F.col("ts") > F.col("_ok")))
    n = joined.groupBy("uuid").agg(F.count_if(open_failure).alias("failures"))
    return n.withColumn("give_up", F.col("failures") >= limit)
