"""The end-to-end job: landed sources + previous version -> next version, and the counters of the run.

Order: merge, deactivate, borrow, derive, block, score, group passes, retention, transitions. Text columns
take part in no group shuffle: groups run on (key, id, source, status, flags, scores)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.figures import extent_percent
from ..functions.identity import identity_hash
from ..functions.text import detect_language, strip_html
from ..operators import actions as A
from ..operators import blocks, groups, lending, lifecycle, merge, scoring
from ..operators.listing import count_new_high_score
from ..operators.pack import RulePack
from ..operators.skew import by_key
from ..schema import DEFAULTS, LISTING, USER_STATUSES, align
from ..session import materialize
from ..sources.registry import SourceResult
from ..sources.runs import run_rows
from .derive import derive_fields


@dataclass
class RefreshResult:
    listings: DataFrame
    tombstones: DataFrame
    outcomes: DataFrame          # source, outcome, n
    stage_errors: list[tuple[str, str]]
    run: DataFrame               # the run's rows for the runs table


@dataclass(frozen=True)
class Landed:
    """What else landed for a run, besides the sources' rows.

    snapshots   source -> one row (complete): may rows absent from the snapshot be deactivated?
    parses      digest source -> one row (messages, cards, parsed): may untouched rows that no digest mentions be dropped?
    details     (uuid, text) of the detail pages that were asked for; every key counts as tried
    edits       manual edits (uuid and edited columns)
    readded     (uuid) added again by hand: their tombstones go before the sources are merged"""

    snapshots: Mapping[str, DataFrame] = field(default_factory=dict)
    parses: Mapping[str, DataFrame] = field(default_factory=dict)
    details: DataFrame | None = None
    edits: DataFrame | None = None
    readded: DataFrame | None = None


_LOG = "array<struct<source:string,outcome:string>>"


def logged(rows: DataFrame, source: str, outcome: Column) -> DataFrame:
    """`outcome` (null: nothing happened) noted in the row's own log, so that counting it needs no second evaluation of the merge."""
    note = F.array(F.struct(F.lit(source).alias("source"), outcome.alias("outcome"))).cast(_LOG)
    old = F.coalesce("_log", F.array().cast(_LOG))
    return rows.withColumn("_log", F.when(outcome.isNotNull(), F.concat(old, note)).otherwise(old))


def merge_sources(stored: DataFrame, tombstones: DataFrame, results: Sequence[SourceResult], as_of: dt.datetime,
                  ) -> DataFrame:
    """All sources folded into the stored rows, with what happened to each row in `_log`."""
    rows = stored.withColumn("_log", F.lit(None).cast(_LOG))
    stamp = F.lit(as_of).cast("timestamp")
    for r in results:
        if r.rows is None:
            continue
        incoming = r.rows.withColumn("source", F.lit(r.spec.name)) if "source" not in r.rows.columns else r.rows
        live = merge.drop_dismissed(incoming, tombstones)
        if r.spec.snapshot:
            live = merge.keep_enriched(live, rows.where(F.col("source") == r.spec.name))
        live = live.withColumn("last_synced_at", stamp).withColumn("first_seen_at", stamp)
        order = "_order" if "_order" in live.columns else None
        merged = merge.merge(rows, live, r.spec.policy, defaults=DEFAULTS, order=order)
        rows = logged(merged, r.spec.name, F.nullif(F.col("_outcome"), F.lit("kept"))).drop("_outcome")
    return rows


def absent(rows: DataFrame, results: Sequence[SourceResult], landed: Landed) -> DataFrame:
    """Rows that a trustworthy snapshot or a complete parse of all digests of the window no longer mentions."""
    for r in results:
        name = r.spec.name
        if r.rows is None:
            continue
        if r.spec.snapshot and name in landed.snapshots:
            rows = merge.deactivate_missing(rows, r.rows, landed.snapshots[name], name)
            rows = logged(rows, name, F.when(F.col("_deactivated"), F.lit("deactivated"))).drop("_deactivated")
        if r.spec.digest and name in landed.parses:
            rows = merge.retire_absent(rows, r.rows, landed.parses[name], name, lifecycle.never_shown_by_user())
    return rows


def enriched(rows: DataFrame, landed: Landed, as_of: dt.datetime) -> DataFrame:
    """Detail texts, then manual edits, which have the last word; the language of a changed text is told anew."""
    language = detect_language(F.col("description"))
    if landed.details is not None:
        extent = extent_percent(F.col("extent"), F.col("title"), F.col("description"))
        rows = merge.apply_full_texts(rows, landed.details, F.lit(as_of).cast("timestamp"), language, extent)
    if landed.edits is not None:
        rows = merge.apply_edits(rows, landed.edits, language)
    return rows


def act(rows: DataFrame, user_actions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The action log on the rows and on all copies of the rows acted on: a status, a reset to `new` included, reaches the
    whole group, so that no copy brings the old one back. A row that becomes `applied` through a copy is dated."""
    own = A.apply_actions(rows, user_actions)
    keyed = rows.select("uuid", "status", "source", identity_hash(F.col("business_name"), F.col("title"), F.col("municipal")).alias("_gkey"))
    valid = (F.col("field") == "status") & F.col("value").isin(*USER_STATUSES)
    log = user_actions.where(valid).select("uuid", F.col("value").alias("status"), F.struct("ts", "seq").alias("seq"))
    spread = groups.spread_actions(keyed, ["_gkey"], log).select("uuid", F.col("user_status").alias("_spread"))
    out = by_key(own, spread, "uuid", "left").withColumn("user_status", F.coalesce("_spread", "user_status"))
    return dated(out, as_of).select(*rows.columns)


def dated(rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    """`applied` rows without a date get the one of the run."""
    missing = (F.col("user_status") == "applied") & F.col("applied_at").isNull()
    return rows.withColumn("applied_at", F.when(missing, F.lit(as_of).cast("timestamp")).otherwise(F.col("applied_at")))


def rescore(rows: DataFrame, pack: RulePack, thin: Sequence[str], lenders: Sequence[str], as_of: dt.datetime) -> DataFrame:
    """Borrow, derive, block and score the active rows, then settle the copy groups."""
    active = F.col("status") == "ACTIVE"
    keyed = rows.where(active).withColumn("_gkey", identity_hash(F.col("business_name"), F.col("title"), F.col("municipal")))
    was_duplicate = rows.where(active & F.col("excluded") & F.col("exclusion_reason").startswith(groups.DUPLICATE_PREFIX)).select("uuid")
    lent = lending.borrow(keyed, ["_gkey"], thin, lenders, strip_html(F.col("description")))
    lent = lent.withColumn("language", F.when(F.col("_borrowed"), F.lit(None)).otherwise(F.col("language")))
    derived = derive_fields(lent.drop("_borrowed"), pack)
    blocked = blocks.with_blocks(derived, pack)
    scored = scoring.with_scores(scoring.with_facts(blocked, pack), pack).select(*rows.columns, "_gkey")
    # The group passes read the narrow columns and the text columns follow by id: cut the plan once here.
    scored = materialize(scored, "scored")

    narrow = scored.select("_gkey", "source", *groups.PAYLOAD)
    order = list(lenders) + [s for s in thin if s not in lenders]
    settled = groups.settle(narrow, ["_gkey"], order).select(
        "uuid", F.col("user_status").alias("_us"), F.col("excluded").alias("_ex"), F.col("exclusion_reason").alias("_er"), F.lit(None).cast("boolean").alias("_orphan"))
    orphans = groups.orphaned_duplicates(narrow, ["_gkey"], was_duplicate).withColumn("_orphan", F.lit(True))
    # A settled row has a copy on another source, an orphan has none: both verdicts come in one join.
    after = by_key(scored, settled.unionByName(orphans, allowMissingColumns=True), "uuid", "left")
    after = after.withColumn("user_status", F.coalesce("_us", "user_status")).withColumn(
        "exclusion_reason", F.when(F.col("_ex").isNotNull(), F.col("_er")).otherwise(F.col("exclusion_reason")),
    ).withColumn("excluded", F.coalesce("_ex", "excluded")).drop("_us", "_ex", "_er")
    hide = F.col("_orphan").isNotNull() & ~F.col("excluded")
    after = after.withColumn("exclusion_reason", F.when(hide, groups.ORPHAN_REASON).otherwise(F.col("exclusion_reason")))
    after = after.withColumn("excluded", F.col("excluded") | hide)
    return dated(after, as_of).select(*rows.columns).unionByName(rows.where(~active))


def retire(rows: DataFrame, tombstones: DataFrame, as_of: dt.datetime, digests: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Retention in order, with tombstones for retired and trashed keys, then the silence transition."""
    now = F.lit(as_of).cast("timestamp")
    kept = lifecycle.keep(rows, lifecycle.inactive_untouched())
    kept = lifecycle.keep(kept, lifecycle.past_due_untouched(now))
    gone = kept.where(F.coalesce(lifecycle.trashed(), F.lit(False)) | F.coalesce(lifecycle.stale_digest(now, digests), F.lit(False)))
    stones = merge.add_tombstones(tombstones, gone, as_of)
    kept = lifecycle.keep(lifecycle.keep(kept, lifecycle.trashed()), lifecycle.stale_digest(now, digests))
    return lifecycle.ignore_silent(kept, F.lit(as_of)), stones


def refresh(spark: SparkSession, stored: DataFrame | None, tombstones: DataFrame, results: Sequence[SourceResult],
            user_actions: DataFrame | None, pack: RulePack, as_of: dt.datetime, snapshots: Mapping[str, DataFrame] | None = None,
            run_id: int = 1, landed: Landed = Landed(), since: dt.datetime | None = None, min_score: int = 55) -> RefreshResult:
    """One run. `snapshots` adds to those of `landed`. `since` is the watermark of the previous one: rows first seen after it that score `min_score` are counted as new
    and high. Every source is read and merged once."""
    specs = [r.spec for r in results]
    thin = [s.name for s in specs if s.thin]
    lenders = [s.name for s in specs if s.lends_text]
    digests = [s.name for s in specs if s.digest]
    errors: list[tuple[str, str]] = []
    base = stored if stored is not None else spark.createDataFrame([], LISTING)
    landed = replace(landed, snapshots={**landed.snapshots, **(snapshots or {})})
    if landed.readded is not None:
        tombstones = merge.revive(tombstones, landed.readded)
    rows = absent(merge_sources(align(base), tombstones, results, as_of), results, landed)
    rows = enriched(rows, landed, as_of)
    log = F.coalesce("_log", F.array().cast(_LOG)).alias("_log")
    if user_actions is not None:
        rows = act(rows, user_actions, as_of)
    merged = materialize(rows.select(*[c for c in rows.columns if c != "_log"], log), "merged")
    outcomes = materialize(merged.select(F.explode("_log").alias("e")).groupBy("e.source", "e.outcome").agg(F.count(F.lit(1)).alias("n")), "outcomes")
    rows = align(merged.drop("_log"))

    def stage(name: str, fn, fallback):
        try:
            return fn()
        except Exception as e:  # a failing stage is recorded, the run goes on with the rows before it
            errors.append((name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
            return fallback

    rows = stage("rescore", lambda: materialize(rescore(rows, pack, thin, lenders, as_of), "rescored"), rows)
    def retired() -> tuple[DataFrame, DataFrame]:
        kept, stones = retire(rows, tombstones, as_of, digests)
        return materialize(align(kept), "retired"), materialize(stones, "tombstones")  # inside the stage, so that its failures stay here

    rows, stones = stage("retire", retired, (rows, tombstones))
    stats: dict[str, dict[str, int]] = {}
    for r in outcomes.collect():  # a few counts per source
        stats.setdefault(r["source"], {})[r["outcome"]] = r["n"]
    totals = {} if since is None else {"new_high_score": count_new_high_score(rows, F.lit(since).cast("timestamp"), min_score).first()["n"]}
    run = run_rows(spark, run_id, as_of, stats, errors={r.spec.name: r.error for r in results if r.error}, stage_errors=errors, totals=totals)
    return RefreshResult(align(rows), stones, outcomes, errors, run)
