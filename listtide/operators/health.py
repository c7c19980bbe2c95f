"""Feed health: rules over the runs table and the freshness of each source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_days

# Days without a run, share of rows closed at once.
STALE_RUN_DAYS = 3
MASS_SHARE = 0.3


@dataclass(frozen=True)
class HealthConfig:
    """Per-source settings; thresholds are (warn, bad) in days."""

    order: Sequence[str]
    freshness: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    data_loss: Sequence[str] = ()
    changelog: str | None = None
    snapshot: str | None = None


def freshness(rows: DataFrame, as_of: DataFrame) -> DataFrame:
    """source, age_days: from the newest row of each source to the last run (`as_of`: one row, watermark)."""
    newest = rows.groupBy("source").agg(F.max("first_seen_at").alias("newest"))
    return newest.select("source", age_days(as_of.select("watermark").scalar(), F.col("newest")).alias("age_days"))


def thresholds(spark, config: HealthConfig) -> DataFrame:
    rows = [(s, float(w), float(b)) for s, (w, b) in config.freshness.items()]
    return spark.createDataFrame(rows, "source string, warn_at double, bad_at double")


def freshness_levels(fresh: DataFrame, limits: DataFrame) -> DataFrame:
    """Level per source with a threshold: bad, warn or ok."""
    a = F.col("age_days")
    return fresh.join(limits, "source").withColumn(
        "level", F.when(a >= F.col("bad_at"), "bad").when(a >= F.col("warn_at"), "warn").otherwise("ok"))


def last_runs(runs: DataFrame) -> DataFrame:
    """The rows of the newest run."""
    return runs.where(F.col("run_id") == runs.agg(F.max("run_id")).scalar())


def _stat(name: str) -> Column:
    return F.try_element_at(F.col("stats"), F.lit(name))


def evaluate(runs: DataFrame, rows: DataFrame, now: Column, config: HealthConfig) -> DataFrame:
    """Problems worst first: (source, level, rule, detail). Rows of `runs` with a NULL source carry the run's own
    stage errors; every other row is one source's statistics."""
    cur = last_runs(runs)
    mark = cur.agg(F.max("watermark").alias("watermark"))
    seq = F.array_position(F.array(*[F.lit(s) for s in config.order]), F.col("source"))
    per_source = cur.where(F.col("source").isNotNull()).withColumn("_seq", seq.cast("int"))

    def issue(df: DataFrame, when: Column, level: Column | str, rule: str, detail: Column, no: int) -> DataFrame:
        lv = level if isinstance(level, Column) else F.lit(level)
        return df.where(when).select("source", lv.alias("level"), F.lit(rule).alias("rule"),
                                     detail.cast("string").alias("detail"), F.col("_seq"), F.lit(no).alias("_no"))

    run = mark.withColumn("source", F.lit("run")).withColumn("_seq", F.lit(0))
    days = age_days(now, F.col("watermark"))
    stale = issue(run, days >= STALE_RUN_DAYS, "warn", "H1", F.round(days, 0).cast("int"), 1)

    stages = cur.select(F.explode("stage_errors").alias("e")).select(
        F.lit("run").alias("source"), F.lit(0).alias("_seq"), "e")
    failed = issue(stages, F.lit(True), "bad", "H2", F.concat_ws(": ", F.col("e")["stage"], F.col("e")["error"]), 2)

    errors = issue(per_source, F.col("error").isNotNull(), "bad", "H3", F.col("error"), 3)
    alive = per_source.where(F.col("error").isNull())
    loses = F.col("source").isin(*config.data_loss)
    warned = issue(alive, F.col("warning").isNotNull(), F.when(loses, "bad").otherwise("warn"), "H4", F.col("warning"), 4)

    feed = alive.where(F.col("source") == F.lit(config.changelog))
    degraded = F.coalesce(_stat("degraded"), F.lit(0)) > 0
    held = F.coalesce(_stat("detail_errors"), F.lit(0)) > 0
    upstream = issue(feed, degraded | held, "warn", "H5",
                     F.when(degraded, "degraded").otherwise(F.concat_ws(" ", F.lit("held"), _stat("detail_errors"))), 5)

    snap = alive.where((F.col("source") == F.lit(config.snapshot)) & _stat("fetched").isNotNull())
    got, gone = _stat("fetched"), F.coalesce(_stat("marked_inactive"), F.lit(0))
    share = gone / F.nullif(got + gone, F.lit(0))
    shrunk = issue(snap, (got == 0) | (share > MASS_SHARE), F.when(got == 0, "bad").otherwise("warn"), "H6",
                   F.concat_ws("/", gone, got + gone), 6)

    silent = F.coalesce(loses & (_stat("messages") == 0), F.lit(False))
    quiet = issue(alive, silent, "bad", "H7", F.lit("no messages"), 7)

    old = freshness_levels(freshness(rows, mark), thresholds(rows.sparkSession, config))
    aged = alive.where(~silent).join(old.select("source", "age_days", F.col("level").alias("_lv")), "source")
    stopped = issue(aged, F.col("_lv") != "ok", F.col("_lv"), "H8", F.round("age_days", 0).cast("int"), 8)

    out = stale
    for part in (failed, errors, warned, upstream, shrunk, quiet, stopped):
        out = out.unionByName(part)
    return out.orderBy(F.col("level") != "bad", "_seq", "_no", "detail").drop("_seq", "_no")


def deactivation_share(runs: DataFrame) -> DataFrame:
    """Per run and source: fetched, closed, share and level."""
    got, gone = _stat("fetched"), F.coalesce(_stat("marked_inactive"), F.lit(0))
    share = gone / F.nullif(got + gone, F.lit(0))
    return runs.where(got.isNotNull()).select(
        "run_id", "source", got.alias("fetched"), gone.alias("closed"), share.alias("share"),
        F.when(got == 0, "bad").when(share > MASS_SHARE, "warn").otherwise("ok").alias("level"))
