"""Table jobs that hold the column functions: derived fields at refresh, presentation fields at reading."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, figures, text
from ..operators.pack import RulePack
from ..operators.scoring import plain_text


def derive_fields(df: DataFrame, pack: RulePack) -> DataFrame:
    """Plain text, language where missing, share of full time and pay, sortable due date."""
    out = plain_text(df)
    mention = figures.pay_mention(F.col("_plain"), pack.figures)
    out = out.withColumn("_mention", mention)
    out = out.withColumn("salary_text", figures.pay_text(F.col("_mention"), words=pack.figures))
    has_text = F.coalesce("description", F.lit("")) != ""
    return out.withColumns({
        "language": F.coalesce("language", F.when(has_text, text.detect_language(F.col("_plain")))),
        "extent_percent": figures.extent_percent(F.col("extent"), F.col("title"), F.col("_plain"), pack.figures),
        "salary_min": figures.pay_min(F.col("salary_text")),
        "application_due_sort": F.coalesce("application_due_sort", dates.normalize_due_date(F.col("application_due"))),
    }).drop("_mention")


def present(df: DataFrame, as_of: Column, previous_run: Column, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Display columns of a result page."""
    return df.withColumns({
        "due_shown": text.value_label(dates.format_due(F.col("application_due")), labels or {}),
        "days_left": dates.days_until(F.date_format("application_due_sort", "yyyy-MM-dd"), as_of),
        "href": text.safe_url(F.coalesce("application_url", "link")),
        "band": figures.score_band(F.col("score")),
        "is_new": figures.is_new(F.col("first_seen_at"), previous_run),
    })
