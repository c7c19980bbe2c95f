"""Retention and status transitions. Every rule is a predicate; removal splits rows into kept and dropped."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import plus_months
from ..schema import TRASH_STATUS

# Age limit of digest rows and months of silence after an application.
DIGEST_MAX_AGE_DAYS = 60
SILENCE_MONTHS = 2


def untouched() -> Column:
    """The user never reacted: still new, no flag, no note."""
    return (F.col("user_status") == "new") & F.col("flagged_at").isNull() & (F.coalesce("notes", F.lit("")) == "")


def never_shown_by_user() -> Column:
    return untouched() & ~F.coalesce("manually_added", F.lit(False))


def inactive_untouched() -> Column:
    return (F.col("status") == "INACTIVE") & untouched()


def past_due_untouched(as_of: Column) -> Column:
    return untouched() & (F.col("application_due_sort") < as_of.cast("date"))


def stale_digest(as_of: Column, sources: Sequence[str], max_age_days: int = DIGEST_MAX_AGE_DAYS) -> Column:
    cutoff = as_of.cast("timestamp") - F.make_dt_interval(days=F.lit(max_age_days))
    return F.col("source").isin(*sources) & never_shown_by_user() & (F.col("first_seen_at") < cutoff)


def trashed() -> Column:
    return F.col("user_status") == TRASH_STATUS


def keep(rows: DataFrame, rule: Column) -> DataFrame:
    """Rows the removal rule does not hit (unknown counts as not hit)."""
    return rows.where(~F.coalesce(rule, F.lit(False)))


def removed(rows: DataFrame, rule: Column) -> DataFrame:
    return rows.where(rule)


def silence_anchor() -> Column:
    """The later of application and due date; the due date alone when the application date is unknown."""
    applied = F.to_date("applied_at")
    return F.when(applied.isNotNull(), F.greatest(applied, F.col("application_due_sort"))).otherwise(
        F.col("application_due_sort"))


def silence_date(months: int = SILENCE_MONTHS) -> Column:
    """The day an application left without an answer counts as ignored; NULL when no date is known."""
    return plus_months(silence_anchor(), months)


def ignore_silent(rows: DataFrame, as_of: Column | dt.date, months: int = SILENCE_MONTHS) -> DataFrame:
    day = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("date")
    hit = (F.col("user_status") == "applied") & (silence_date(months) <= day)
    return rows.withColumn("user_status", F.when(F.coalesce(hit, F.lit(False)), F.lit("ignored")).otherwise(F.col("user_status")))
