"""Ranking regression: percentiles from a score histogram, before/after comparison, drop-outs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import running_sum
from .skew import top_per_key

TOP_PERCENTILE = 95
TOP_ROWS = 30


def percentiles(rows: DataFrame, score: str, visible: Column, out: str = "percentile") -> DataFrame:
    """Share (in percent) of visible rows scoring strictly lower, from running sums over the histogram of scores."""
    scored = rows.where(F.col(score).isNotNull())
    hist = scored.groupBy(F.col(score).alias("_s")).agg(F.count_if(visible).alias("_n"))
    below = running_sum(hist, "_s", "_n", "_below", "_all").withColumnRenamed("_s", score)
    share = F.lit(100.0) * F.col("_below") / F.greatest(F.col("_all"), F.lit(1))
    # Written once: the planner then sees its true, tiny size and broadcasts it instead of shuffling by score.
    table = materialize(below.select(score, share.alias(out)), "histogram")
    return rows.join(table, score, "left")


def compare(before: DataFrame, after: DataFrame, score: str) -> DataFrame:
    """Rows known on both sides with old and new score and percentile (`visible` is a boolean column)."""
    b = percentiles(before, score, F.col("visible"), "p_before").select("uuid", F.col(score).alias("before"), "p_before")
    a = percentiles(after, score, F.col("visible"), "p_after").withColumnRenamed(score, "after")
    return a.join(b, "uuid")


def drop_outs(before: DataFrame, after: DataFrame, score: str, control: Sequence[str],
              expected: Sequence[str] = (), top: float = TOP_PERCENTILE) -> DataFrame:
    """Control rows that were in the top and no longer are, except titles named as expected."""
    both = compare(before, after, score).where(F.col("user_status").isin(*control))
    ok = F.lit(False)
    for term in expected:
        ok = ok | F.lower("title").contains(term)
    return both.where((F.col("p_before") >= top) & (F.col("p_after") < top) & ~ok).select(
        "uuid", "title", "before", "p_before", "after", "p_after")


def top_rows(rows: DataFrame, profile: str, score: str, n: int = TOP_ROWS) -> DataFrame:
    """Best `n` per profile value."""
    return top_per_key(rows, [profile], [F.desc_nulls_last(score), F.asc("uuid")], n, "uuid")
