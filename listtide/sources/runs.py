"""The runs table: one row per run and source, plus one for the run's own stage errors."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RUN


def run_rows(spark: SparkSession, run_id: int, watermark: dt.datetime, stats: Mapping[str, Mapping[str, int]],
             warnings: Mapping[str, str] | None = None, errors: Mapping[str, str] | None = None,
             stage_errors: Sequence[tuple[str, str]] = (), totals: Mapping[str, int] | None = None) -> DataFrame:
    """Summary of one run (a handful of rows, built on the driver): one row a source, and one with the run's own counts and errors."""
    warnings, errors = warnings or {}, errors or {}
    names = sorted({*stats, *warnings, *errors})
    rows = [(run_id, watermark, s, dict(stats.get(s, {})), warnings.get(s), errors.get(s), None) for s in names]
    rows.append((run_id, watermark, None, dict(totals or {}), None, None, [(a, b) for a, b in stage_errors]))
    return spark.createDataFrame(rows, RUN)


def previous_watermark(runs: DataFrame) -> DataFrame:
    """One row: the UTC watermark of the newest run, the reference point of 'new since'."""
    return runs.agg(F.max("watermark").alias("watermark"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
