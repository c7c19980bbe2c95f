"""Keyed merges: previous snapshot + changes -> next snapshot, with the column policies held as data."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import by_key, in_keys

KEY = "uuid"


@dataclass(frozen=True)
class Policy:
    """How one column of an existing row reacts to an incoming row.

    replace   take the incoming value, NULL included
    fill      take it unless NULL
    fill_text take it unless NULL or ''
    follow    take it only when column `arg` comes with a non-empty text
    greatest  the larger of both
    with_text take it only when column `arg` comes with a value
    keep      never touched (new rows take the incoming value)"""

    kind: str
    arg: str | None = None

    def apply(self, old: Column, new: Column, arg: Column | None) -> Column:
        if self.kind == "replace":
            return new
        if self.kind == "fill":
            return F.coalesce(new, old)
        if self.kind == "fill_text":
            return F.coalesce(F.nullif(new, F.lit("")), old)
        if self.kind == "follow":
            return F.when(F.nullif(arg, F.lit("")).isNull(), old).otherwise(new)
        if self.kind == "greatest":
            return F.greatest(old, new)
        if self.kind == "with_text":
            return F.when(arg.isNull(), old).otherwise(new)
        if self.kind == "keep":
            return old
        raise ValueError(f"unknown merge policy {self.kind!r}")


REPLACE, FILL, FILL_TEXT, KEEP, GREATEST = (Policy(k) for k in ("replace", "fill", "fill_text", "keep", "greatest"))

# A feed that always sends the whole row.
OVERWRITE: dict[str, Policy] = {c: REPLACE for c in (
    "status title business_name municipal county description employer_name employer_orgnr application_url "
    "application_due application_due_sort link published expires updated engagement_type extent sector "
    "occupation_categories raw_json language last_synced_at").split()}

# Sources that know only part of a row: NULL or '' means "this source does not say".
PARTIAL: dict[str, Policy] = {
    **{c: REPLACE for c in ("status", "title", "application_url", "link", "last_synced_at")},
    **{c: FILL for c in ("business_name", "municipal", "county", "description", "employer_name", "sector")},
    **{c: FILL_TEXT for c in ("application_due", "engagement_type", "extent")},
    "application_due_sort": Policy("follow", "application_due"),
    "manually_added": GREATEST,
    "language": Policy("with_text", "description"),
}

STATUS_ONLY: dict[str, Policy] = {"status": REPLACE, "last_synced_at": REPLACE}

EDITABLE = ("title", "business_name", "employer_name", "municipal", "county", "link", "application_url",
            "application_due", "application_due_sort")


def last_entries(incoming: DataFrame, key: str = KEY, order: str | None = None) -> DataFrame:
    """One row per key: the last one by column `order`, or in the order of the rows where the feed has none."""
    rest = [c for c in incoming.columns if c != key]
    seq = F.col(order) if order else F.monotonically_increasing_id()
    placed = incoming.withColumn("_seq", seq)
    return placed.groupBy(key).agg(F.max_by(F.struct(*rest), "_seq").alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])


def merge(stored: DataFrame, incoming: DataFrame, policies: Mapping[str, Policy], key: str = KEY,
          insert: bool = True, defaults: Mapping[str, object] | None = None, order: str | None = None) -> DataFrame:
    """Full outer join on the unique key; every column of `stored` by its policy, others kept.

    Of several incoming rows with one key the last counts (`last_entries`). A stored language is cleared where the text
    changes and the feed brings no language. Adds `_outcome`: new, merged or kept. With `insert=False` unseen keys are
    dropped."""
    defaults = defaults or {}
    incoming = last_entries(incoming, key, order)
    new_cols = set(incoming.columns)
    right = incoming.select(F.col(key), F.lit(True).alias("_in"), *[
        F.col(c).alias(f"_in_{c}") for c in incoming.columns if c != key])
    left = stored.withColumn("_st", F.lit(True))
    joined = left.join(right, key, "full" if insert else "left")
    have_old, have_new = F.col("_st").isNotNull(), F.col("_in").isNotNull()
    out = [F.col(key)]
    for c in stored.columns:
        if c == key:
            continue
        old = F.col(c)
        if c not in new_cols:
            value = old
            if c in defaults:
                value = F.when(have_old, old).otherwise(F.lit(defaults[c]))
            if c == "language" and "description" in new_cols and "description" in stored.columns:
                text = policies.get("description", KEEP).apply(F.col("description"), F.col("_in_description"), None)
                value = F.when(have_old & have_new & ~text.eqNullSafe(F.col("description")), F.lit(None)).otherwise(value)
        else:
            new, policy = F.col(f"_in_{c}"), policies.get(c, KEEP)
            arg = F.col(f"_in_{policy.arg}") if policy.arg else None
            fresh = F.coalesce(new, F.lit(defaults[c])) if c in defaults else new
            value = F.when(have_old & have_new, policy.apply(old, new, arg)).when(have_old, old).otherwise(fresh)
        out.append(value.cast(stored.schema[c].dataType).alias(c))
    outcome = F.when(have_old & have_new, "merged").when(have_new, "new").otherwise("kept")
    return joined.select(*out, outcome.alias("_outcome"))


def drop_dismissed(incoming: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Incoming rows without those whose key carries a tombstone."""
    return in_keys(incoming, tombstones, [KEY], present=False)


def revive(tombstones: DataFrame, readded: DataFrame) -> DataFrame:
    """An explicit re-add removes the tombstone."""
    return in_keys(tombstones, readded, [KEY], present=False)


def add_tombstones(tombstones: DataFrame, dropped: DataFrame, as_of: dt.datetime | Column) -> DataFrame:
    """Tombstones for deleted keys; one per key, the earliest stays."""
    stamp = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    fresh = dropped.select(KEY, stamp.alias("dismissed_at"))
    return tombstones.select(KEY, "dismissed_at").unionByName(fresh).groupBy(KEY).agg(
        F.min("dismissed_at").alias("dismissed_at"))


def change_kind(incoming: DataFrame, stored: DataFrame, tombstones: DataFrame, payload: str = "raw_json") -> DataFrame:
    """Incoming keys with `outcome`: new, updated, unchanged, or skipped for a tombstoned key never stored."""
    old = stored.select(KEY, F.col(payload).alias("_old"), F.lit(True).alias("_known"))
    dead = tombstones.select(KEY).distinct().withColumn("_dead", F.lit(True))
    return (
        incoming.select(KEY, F.col(payload).alias("_new")).join(old, KEY, "left").join(dead, KEY, "left")
        .select(KEY, F.when(F.col("_known").isNull() & F.col("_dead").isNotNull(), "skipped")
                .when(F.col("_known").isNull(), "new")
                .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
                .otherwise("updated").alias("outcome"))
    )


def reuse_language(incoming: DataFrame, stored: DataFrame, detect: Column) -> DataFrame:
    """Language of each incoming row: the stored one while the text is the same, else `detect` anew."""
    old = stored.select(KEY, F.col("description").alias("_text"), F.col("language").alias("_lang"))
    same = F.col("description").isNotNull() & F.col("description").eqNullSafe(F.col("_text"))
    return incoming.join(old, KEY, "left").withColumn(
        "language", F.coalesce(F.when(same, F.col("_lang")), F.when(F.col("description").isNotNull(), detect))
    ).drop("_text", "_lang")


FULL_TEXT_CHARS = 300


def keep_enriched(incoming: DataFrame, stored: DataFrame, min_chars: int = FULL_TEXT_CHARS) -> DataFrame:
    """A stored text long enough to be the full one replaces the incoming summary."""
    old = stored.where(F.length("description") >= min_chars).select(KEY, F.col("description").alias("_full"))
    return by_key(incoming, old, KEY, "left").withColumn(
        "description", F.coalesce(F.col("_full"), F.col("description"))).drop("_full")


def apply_edits(stored: DataFrame, edits: DataFrame, detect: Column) -> DataFrame:
    """Manual edits write exactly what was entered (NULL clears); a changed text becomes the user's own:
    language by `detect` (over column `description`), borrow link cleared. Unknown keys are ignored."""
    cols = [c for c in EDITABLE if c in edits.columns and c in stored.columns]
    right = edits.select(KEY, F.lit(True).alias("_ed"), *[F.col(c).alias(f"_ed_{c}") for c in [*cols, "description"]])
    hit = F.col("_ed").isNotNull()
    changed = hit & ~F.col("_ed_description").eqNullSafe(F.nullif(F.trim("description"), F.lit("")))
    out = by_key(stored, right, KEY, "left").withColumn("_changed", changed)
    for c in cols:
        out = out.withColumn(c, F.when(hit, F.col(f"_ed_{c}")).otherwise(F.col(c)))
    out = out.withColumn("description", F.when(F.col("_changed"), F.col("_ed_description")).otherwise(F.col("description")))
    out = out.withColumn("language", F.when(F.col("_changed"), detect).otherwise(F.col("language")))
    out = out.withColumn("description_borrowed_from",
                         F.when(~F.col("_changed"), F.col("description_borrowed_from")))
    return out.select(*stored.columns)


def apply_full_texts(stored: DataFrame, details: DataFrame, attempted_at: Column, detect: Column,
                     extent: Column) -> DataFrame:
    """Landed detail texts replace summaries, language and share of full time follow the new text. Every key
    in `details` counts as attempted, also those that came back without a text; `attempted_at` never falls."""
    right = details.select(KEY, F.lit(True).alias("_tried"), F.nullif(F.col("text"), F.lit("")).alias("_text"))
    out = by_key(stored, right, KEY, "left")
    got = F.col("_text").isNotNull()
    out = out.withColumn("description_fetch_attempted_at", F.when(
        F.col("_tried").isNotNull(), F.greatest("description_fetch_attempted_at", attempted_at)
    ).otherwise(F.col("description_fetch_attempted_at")))
    out = out.withColumn("description", F.coalesce("_text", "description"))
    out = out.withColumn("language", F.when(got, detect).otherwise(F.col("language")))
    out = out.withColumn("extent_percent", F.when(got, F.coalesce(extent, F.col("extent_percent")))
                         .otherwise(F.col("extent_percent")))
    return out.select(*stored.columns)


def rows_needing_text(stored: DataFrame, source: str, as_of: Column, max_chars: int = FULL_TEXT_CHARS,
                      retry_after_hours: int = 24) -> DataFrame:
    """Active rows of a source still holding a short text and not tried within the cooldown."""
    tried = F.col("description_fetch_attempted_at")
    return stored.where(
        (F.col("source") == source) & (F.col("status") == "ACTIVE")
        & (F.col("description").isNull() | (F.length("description") < max_chars))
        & (tried.isNull() | (tried < as_of - F.make_dt_interval(hours=F.lit(retry_after_hours))))
    ).select(KEY)


# Guards of the snapshot difference.
SURVIVOR_RATIO = 0.5
GUARD_MIN_ACTIVE = 10


def deactivate_missing(stored: DataFrame, snapshot_keys: DataFrame, completeness: DataFrame, source: str) -> DataFrame:
    """Active rows of `source` absent from a trustworthy snapshot become INACTIVE.

    `completeness` is one row (complete boolean). Trust also needs a non-empty snapshot and, from ten active
    rows on, at least half of them surviving. Adds `_deactivated`."""
    seen = snapshot_keys.select(KEY).distinct().withColumn("_seen", F.lit(True))
    marked = by_key(stored, seen, KEY, "left")
    mine = (F.col("source") == source) & (F.col("status") == "ACTIVE")
    trusted = survivor_guard(marked.where(mine), seen, completeness).select("trusted").scalar()
    gone = mine & F.col("_seen").isNull() & trusted
    return (
        marked.withColumn("_deactivated", F.coalesce(gone, F.lit(False)))
        .withColumn("status", F.when(F.col("_deactivated"), F.lit("INACTIVE")).otherwise(F.col("status")))
        .drop("_seen")
    )


def survivor_guard(active_marked: DataFrame, seen: DataFrame, completeness: DataFrame) -> DataFrame:
    """One row: n_active, n_survivors, n_snapshot, complete, trusted."""
    counts = active_marked.agg(F.count(F.lit(1)).alias("n_active"), F.count("_seen").alias("n_survivors"))
    size = seen.agg(F.count(F.lit(1))).scalar()
    complete = completeness.agg(F.coalesce(F.bool_and("complete"), F.lit(False))).scalar()
    trusted = (
        F.col("complete") & (F.col("n_snapshot") > 0)
        & ((F.col("n_active") < GUARD_MIN_ACTIVE) | (F.col("n_survivors") >= SURVIVOR_RATIO * F.col("n_active")))
    )
    return counts.select("*", size.alias("n_snapshot"), complete.alias("complete")).withColumn("trusted", trusted)


def retire_absent(stored: DataFrame, seen_keys: DataFrame, parse: DataFrame, source: str, untouched: Column) -> DataFrame:
    """Untouched rows of `source` that this run's complete parse no longer mentions are dropped.

    `parse` is one row (messages, cards, parsed): complete means some messages, some cards, all parsed."""
    ok = parse.agg(F.coalesce(F.bool_and(
        (F.col("messages") > 0) & (F.col("cards") > 0) & (F.col("parsed") == F.col("cards"))), F.lit(False))).scalar()
    marked = by_key(stored, seen_keys.select(KEY).distinct().withColumn("_seen", F.lit(True)), KEY, "left")
    drop = ok & (F.col("source") == source) & untouched & F.col("_seen").isNull()
    return marked.where(~F.coalesce(drop, F.lit(False))).drop("_seen")
