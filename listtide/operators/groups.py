"""Cross-source copies of one posting: groups, status fill, block copy, keeper pick, orphan keep.

Hot keys: rows are first combined map-side to one row per (key, source); a group that survives the
unambiguity test holds each source at most once, so the arrays below are bounded by the number of sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import check_status
from .skew import by_key, in_keys, lookup

# Which copied status wins, most decided first.
STATUS_FILL_ORDER = ("offer", "interview", "applied", "rejected", "ignored", "interesting", "archived")
UNKNOWN_RANK = 99

DUPLICATE_PREFIX = "duplicate"
ORPHAN_REASON = "duplicate of a closed listing: its copy on another source is inactive"


def duplicate_reason(source: Column) -> Column:
    return F.concat(F.lit(DUPLICATE_PREFIX + ": the same listing is shown from source "), source)


def per_source(rows: DataFrame, key: Sequence[str], source: str, payload: Sequence[str]) -> DataFrame:
    """(key, source) -> number of rows and one payload (the row's own when the number is 1)."""
    return rows.groupBy(*key, source).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*payload)).alias("_row"))


def group_stats(rows: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    """Per key: the smallest uuid, n rows, n_sources, unambiguous (two or more sources, none of them twice)."""
    by_source = rows.groupBy(*key, source).agg(F.count(F.lit(1)).alias("_n"), F.min("uuid").alias("_u"))
    return by_source.groupBy(*key).agg(
        F.min("_u").alias("first_uuid"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_sources"),
        F.max("_n").alias("_most"),
    ).withColumn("unambiguous", (F.col("n_sources") >= 2) & (F.col("_most") == 1)).drop("_most")


def copy_groups(rows: DataFrame, key: Sequence[str], source: str, payload: Sequence[str],
                more: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per unambiguous group: key and `members` (array of struct(source, *payload)); `more` names further aggregates over
    `per_source` rows."""
    member = F.struct(F.col(source).alias("source"), *[F.col("_row")[c].alias(c) for c in payload])
    return (
        per_source(rows, key, source, payload).groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_s"), F.max("_n").alias("_most"),
             F.collect_list(F.when(F.col("_n") == 1, member)).alias("members"), *[c.alias(n) for n, c in (more or {}).items()])
        .where((F.col("_s") >= 2) & (F.col("_most") == 1)).drop("_s", "_most")
    )


def _rank(c: Column, order: Sequence[str] | Mapping[str, int], unknown: int = UNKNOWN_RANK) -> Column:
    ranks = order if isinstance(order, Mapping) else {v: i for i, v in enumerate(order)}
    if not ranks:
        return F.lit(unknown)
    pairs = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(unknown))


def fill_status(members: Column) -> Column:
    """Members still 'new' take the status of the best-ranked member that is not."""
    donors = F.transform(
        F.filter(members, lambda m: m["user_status"] != "new"),
        lambda m: F.struct(_rank(m["user_status"], STATUS_FILL_ORDER).alias("rank"), m["uuid"].alias("uuid"),
                           m["user_status"].alias("status")))
    best = F.array_min(donors)
    return F.transform(members, lambda m: m.withField("user_status", F.when(
        m["user_status"] == "new", F.coalesce(best["status"], m["user_status"])).otherwise(m["user_status"])))


def copy_blocks(members: Column) -> Column:
    """Members not excluded take the reason of the smallest-id member that is excluded with a reason."""
    donors = F.transform(
        F.filter(members, lambda m: m["excluded"] & (F.coalesce(m["exclusion_reason"], F.lit("")) != "")),
        lambda m: F.struct(m["uuid"].alias("uuid"), m["exclusion_reason"].alias("reason")))
    reason = F.array_min(donors)["reason"]
    return F.transform(members, lambda m: m.withField(
        "exclusion_reason", F.when(m["excluded"], m["exclusion_reason"]).otherwise(reason),
    ).withField("excluded", m["excluded"] | reason.isNotNull()))


def hide_duplicates(members: Column, source_order: Sequence[str] | Mapping[str, int]) -> Column:
    """Among members not excluded the best of both scores stays (then source order, then id), others are
    excluded with a reason naming the keeper's source."""
    live = F.filter(members, lambda m: ~m["excluded"])
    ranked = F.transform(live, lambda m: F.struct(
        (-F.coalesce(F.greatest(m["score"], m["score_it"]), F.lit(-1))).alias("a"), _rank(m["source"], source_order).alias("b"),
        m["uuid"].alias("uuid"), m["source"].alias("source")))
    keeper = F.array_min(ranked)

    def mark(m: Column) -> Column:
        dup = ~m["excluded"] & (m["uuid"] != keeper["uuid"])
        return m.withField("exclusion_reason", F.when(dup, duplicate_reason(keeper["source"])).otherwise(
            m["exclusion_reason"])).withField("excluded", m["excluded"] | dup)
    return F.transform(members, mark)


PAYLOAD = ("uuid", "user_status", "excluded", "exclusion_reason", "score", "score_it")


def members(groups: DataFrame, column: Column | str = "members") -> DataFrame:
    """Groups back to rows."""
    keys = [c for c in groups.columns if c != "members"]
    return groups.select(*keys, F.inline(column if isinstance(column, Column) else F.col(column)))


def settle(rows: DataFrame, key: Sequence[str], source_order: Sequence[str] | Mapping[str, int]) -> DataFrame:
    """All three passes over every unambiguous group in the order status, blocks, duplicates; one row per member
    (source, uuid, user_status, excluded, exclusion_reason, score, score_it)."""
    # What a group decides as a whole is aggregated beside its members; each member is then a plain row.
    row, one = F.col("_row"), F.col("_n") == 1
    donor = F.struct(_rank(row["user_status"], STATUS_FILL_ORDER).alias("rank"), row["uuid"].alias("uuid"), row["user_status"].alias("status"))
    block = F.struct(row["uuid"].alias("uuid"), row["exclusion_reason"].alias("reason"))
    best = F.struct((-F.coalesce(F.greatest(row["score"], row["score_it"]), F.lit(-1))).alias("a"), _rank(F.col("source"), source_order).alias("b"),
                    row["uuid"].alias("uuid"), F.col("source").alias("source"))
    g = copy_groups(rows, key, "source", PAYLOAD, {
        "_status": F.min(F.when(one & (row["user_status"] != "new"), donor))["status"],
        "_reason": F.min(F.when(one & row["excluded"] & (F.coalesce(row["exclusion_reason"], F.lit("")) != ""), block))["reason"],
        "_keeper": F.min(F.when(one & ~row["excluded"], best))})
    m = members(g).drop(*key)
    # A block reaches every member, so a group with one has no row left to keep.
    blocked = F.col("excluded") | F.col("_reason").isNotNull()
    dup = ~blocked & (F.col("uuid") != F.col("_keeper")["uuid"])
    reason = F.when(F.col("excluded"), F.col("exclusion_reason")).otherwise(F.col("_reason"))
    status = F.when(F.col("user_status") == "new", F.coalesce("_status", "user_status")).otherwise(F.col("user_status"))
    return m.select("source", "uuid", status.alias("user_status"), (blocked | dup).alias("excluded"),
                    F.when(dup, duplicate_reason(F.col("_keeper")["source"])).otherwise(reason).alias("exclusion_reason"), "score", "score_it")


def orphaned_duplicates(rows: DataFrame, key: Sequence[str], previously: DataFrame) -> DataFrame:
    """Keys of rows that were duplicates before, are not excluded now and have no other source left."""
    lone = group_stats(rows, key, "source").where(F.col("n_sources") == 1)
    was = in_keys(rows.where(~F.col("excluded")), previously, ["uuid"])
    return by_key(was, lone.select(*key), list(key), "left_semi").select("uuid")


def spread_actions(rows: DataFrame, key: Sequence[str], actions: DataFrame) -> DataFrame:
    """User actions (uuid, status, seq) reach all copies in the group, overwriting; in ambiguous groups only
    the row itself. One row per affected uuid: (uuid, user_status), later actions win."""
    acts = actions.groupBy("uuid").agg(F.max_by("status", "seq").alias("_set"), F.max("seq").alias("_seq"))
    acted = by_key(rows.select("uuid", "status", F.col("source").alias("_own"), *key), acts, "uuid")
    own = acted.select("uuid", "_set", "_seq")
    active = rows.where(F.col("status") == "ACTIVE")
    member = F.struct(F.col("source").alias("source"), F.col("_row")["uuid"].alias("uuid"))
    sets = per_source(active, key, "source", ("uuid",)).groupBy(*key).agg(
        F.max("_n").alias("_most"), F.collect_list(F.when(F.col("_n") == 1, member)).alias("members"),
    ).where(F.col("_most") == 1).drop("_most")
    # An acted-on row that is itself inactive joins the active set as one more member.
    in_set = F.exists("members", lambda m: m["source"] == F.col("_own"))
    clear = F.when(F.col("status") == "ACTIVE", F.size("members") >= 2).otherwise(~in_set)
    twins = lookup(acted, sets, key, ["uuid"], "inner").where(clear).select(
        F.explode("members").alias("m"), "_set", "_seq").select(F.col("m")["uuid"].alias("uuid"), "_set", "_seq")
    return own.unionByName(twins).groupBy("uuid").agg(F.max_by("_set", "_seq").alias("user_status"))


def set_status_with_copies(rows: DataFrame, key: Sequence[str], uuid: str, status: str) -> DataFrame:
    """One user action as a frame of affected rows; its count is the number of rows set."""
    check_status(status)
    spark = rows.sparkSession
    act = spark.range(1).select(F.lit(uuid).alias("uuid"), F.lit(status).alias("status"), F.lit(1).cast("long").alias("seq"))
    return spread_actions(rows, key, act)
