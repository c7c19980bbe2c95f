"""Sources as interchangeable specifications, run in isolation from each other."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import DIGEST_MAX_AGE_DAYS
from ..operators.merge import PARTIAL, Policy
from ..session import materialize
from .feeds import within_lookback

Reader = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class SourceSpec:
    """One feed: how it is read, how its rows merge, and what its rows may be used for.

    With `lookback_days` only rows whose column `received` lies in that window before the run are read; it must not be longer than
    retired keys are remembered."""

    name: str
    reader: Reader
    policy: Mapping[str, Policy] = field(default_factory=lambda: PARTIAL)
    lends_text: bool = False
    thin: bool = False
    snapshot: bool = False
    digest: bool = False
    lookback_days: int | None = None
    received: str = "mail_date"


@dataclass(frozen=True)
class SourceResult:
    spec: SourceSpec
    rows: DataFrame | None
    error: str | None


def _read(spark: SparkSession, spec: SourceSpec, as_of: dt.datetime | None) -> DataFrame:
    rows = spec.reader(spark)
    if "_order" not in rows.columns:  # the order in which the feed gives its rows, noted before anything moves them
        rows = rows.withColumn("_order", F.monotonically_increasing_id())
    if spec.lookback_days is None:
        return rows
    if as_of is None:
        raise ValueError(f"source {spec.name} looks back: read_all needs the time of the run")
    return within_lookback(rows, F.lit(as_of).cast("timestamp"), spec.lookback_days, DIGEST_MAX_AGE_DAYS, spec.received).drop(spec.received)


def read_all(spark: SparkSession, specs: Sequence[SourceSpec], as_of: dt.datetime | None = None) -> list[SourceResult]:
    """Read every source into the shared folder; one that fails, also while its files are read, is recorded and the
    others go on."""
    out = []
    for spec in specs:
        try:
            out.append(SourceResult(spec, materialize(_read(spark, spec, as_of), "source"), None))
        except Exception as e:  # the failure of one source is data for the run summary
            out.append(SourceResult(spec, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return out
