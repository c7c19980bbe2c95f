"""Balanced label propagation: documents to shards of equal counts with few links cut.

Documents of equal text are linked. They start on shards by a hash; in each round every group that is not together asks for the shard
that holds most of its members now (of those with room, if any has), and each shard takes groups as far as its room and what leaves it
allow. The room binds in every round for rows with links; rows without links give way. A group above a shard's room asks in salted
parts, for what room whole groups leave. The rounds keep one row per part, never single links. At the end each shard keeps its even count, and only the surplus moves,
in runs, into the gaps of other shards: rows without links first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import table, written

SHARDS = 24
ROUNDS = 3
#: Room of a shard above the mean during the rounds.
SLACK = 1.05
#: Steps in which a shard takes its askers.
LUCKS = 256
#: Rows of one ordered run: what a task sorts at a time.
RUN_ROWS = 100_000
#: A group above this share of all rows is salted; there are fewer than 1 / HOT_SHARE such groups.
HOT_SHARE = 1 / 2000


def links(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, group, tie, shard): groups are equal texts, all null texts being one; rows begin on a hashed shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64("text", F.octet_length(text)).alias("group"),
                       F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("tie"))  # rows without an id part as well
    return rows.withColumn("shard", start_shard(shards))


def start_shard(shards: int) -> Column:
    """Where a row begins: by its id (and its text and place, for rows without one)."""
    return F.pmod(F.xxhash64("doc_id", "group", "tie", F.lit(3)), F.lit(shards)).cast("int")


def admitted(flow: np.ndarray, now: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each shard below which luck its askers are taken, so that no shard ends above its room (or above what it holds already).

    `flow` counts rows by (shard they are on, shard they ask for, luck). Taking fewer for one shard lets fewer leave the others, so
    limits are only ever lowered until all hold."""
    taken = np.concatenate([np.zeros_like(flow[:, :, :1]), flow.cumsum(axis=2)], axis=2)
    arriving, shards = taken.sum(axis=0), np.arange(len(now))
    limit = np.full(len(now), flow.shape[2])
    while True:
        leaving = taken[:, shards, limit].sum(axis=1)
        free = np.maximum(room, now) - now + leaving
        lower = np.minimum(limit, [np.searchsorted(arriving[t], free[t], "right") - 1 for t in shards])
        if (lower == limit).all():
            return limit
        limit = lower


def held_by(units: DataFrame, shards: int) -> np.ndarray:
    """Rows of `units` on each shard."""
    now = np.zeros(shards)
    for shard, n in units.select(F.explode("holds").alias("h")).groupBy("h.shard").agg(F.sum("h.n")).collect():  # one row per shard
        now[shard] = n
    return now


def propagate(linked: DataFrame, room: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """(group, part, holds) after the rounds; `linked` has group, part and the shard where each row begins, `room` is that of each shard.

    A part of a group is one row, `holds` being an array of (shard, n) of where its members are: one entry once they are together."""
    at = linked.groupBy("group", "part", "shard").agg(F.count("*").alias("n"))
    units = written(at.groupBy("group", "part").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("holds")), "shard_units")
    shards = len(room)
    for k in range(rounds):
        now = held_by(units, shards)
        has_room = F.array(*[F.lit(bool(x)) for x in now < room])
        # Most members now, and where shards are full, most members in one that is not.
        wish = F.array_max(F.transform("holds", lambda h: F.struct(F.get(has_room, h["shard"]).alias("open"), h["n"].alias("n"), F.xxhash64("group", "part", h["shard"]).alias("tie"), h["shard"].alias("shard"))))
        luck = F.pmod(F.xxhash64("group", "part", F.lit(k)), F.lit(LUCKS)).cast("int")
        asks = units.withColumn("target", F.when(F.size("holds") > 1, wish["shard"])).withColumn("luck", luck)
        flow = np.zeros((shards, shards, LUCKS))
        moves = asks.where("target IS NOT NULL").select("target", "luck", F.explode("holds").alias("h")).where("h.shard <> target")
        for shard, target, at_luck, n in moves.groupBy("h.shard", "target", "luck").agg(F.sum("h.n")).collect():  # shards * shards * LUCKS at most
            flow[shard, target, at_luck] = n
        limit = F.array(*[F.lit(int(x)) for x in admitted(flow, now, room)])
        together = F.array(F.struct(F.col("target").alias("shard"), F.aggregate("holds", F.lit(0).cast("long"), lambda n, h: n + h["n"]).alias("n")))
        units = written(asks.select("group", "part", F.when(F.col("luck") < F.get(limit, F.col("target")), together).otherwise(F.col("holds")).alias("holds")), "shard_units")
    return units


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) of every row of `docs` (doc_id, text).

    Counts of shards differ by one at most and slots run from 0 without gaps. Null ids, repeated ids and equal rows are rows like
    any other; a null text counts as empty in size and checksum. No rows give no rows."""
    rows = written(links(docs, shards), "shard_rows")
    total = rows.count()
    room = SLACK * total / shards
    sizes = written(rows.groupBy("group").agg(F.count("*").alias("members")).where("members > 1"), "shard_sizes")
    # Fewer than 1 / HOT_SHARE groups are hot; those above a shard's room ask in parts of half of it.
    hot = sizes.where(F.col("members") > max(total * HOT_SHARE, 2)).select(
        "group", F.ceil(F.col("members") / F.lit(max(total * HOT_SHARE, 1.0))).alias("salts"),
        F.when(F.col("members") > room, F.ceil(F.col("members") / F.lit(max(room / 2, 1.0)))).otherwise(1).alias("parts"))
    dealt = lambda n, seed: F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32", "tie", F.lit(seed)), n), F.lit(0))
    rows = written(rows.join(F.broadcast(hot), "group", "left").select(
        *rows.columns, F.col("salts").isNotNull().alias("hot"), dealt(F.col("parts"), 11).alias("part"), dealt(F.col("salts"), 5).alias("salt"),
        (F.coalesce("parts", F.lit(1)) > 1).alias("split")), "shard_parts")
    linked = rows.join(sizes.select("group"), "group", "left_semi")
    units = propagate(linked.where("NOT split"), np.full(shards, room), rounds)
    if hot.where("parts > 1").count():  # parts ask for what room whole groups leave
        units = units.unionByName(propagate(linked.where("split"), np.maximum(room - held_by(units, shards), 0), rounds))
    placed = rows.join(units, ["group", "part"], "left")
    # In a shard whole groups come first, then parts of split ones, then rows without links: the last ones leave where there are too many.
    kind = F.when(F.col("holds").isNull(), 2).when(F.col("split"), 1).otherwise(0)
    near = F.when(F.size("holds") == 1, F.col("holds")[0]["shard"]).otherwise(F.col("shard"))
    runs = max(16, -(-total // (shards * RUN_ROWS)))
    run = F.pmod(F.xxhash64("group", F.lit(7)), F.lit(runs))
    keyed = written(placed.select("doc_id", "size", "text_crc32", "group", near.alias("near"), kind.alias("kind"), run.alias("run"),
                                  F.when(F.col("hot"), F.col("group")).alias("own"), "salt"), "shard_keys")
    key = ["near", "kind", "run", "own", "salt"]
    counts = keyed.groupBy(*key).agg(F.count("*").alias("n"))
    inside = W.partitionBy("near").orderBy(*key[1:]).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).select(*key, "before")
    own = W.partitionBy(*key).orderBy("group", "doc_id", "text_crc32")
    same = (F.col("k.near") == F.col("o.near")) & (F.col("k.kind") == F.col("o.kind")) & (F.col("k.run") == F.col("o.run")) & F.col("k.own").eqNullSafe(F.col("o.own")) & (F.col("k.salt") == F.col("o.salt"))
    ranked = keyed.withColumn("row", F.row_number().over(own)).alias("k").join(offsets.alias("o"), same).select(
        "k.doc_id", "k.size", "k.text_crc32", "k.group", "k.near", (F.col("before") + F.col("row") - 1).alias("rank"))
    held = {r[0]: r[1] for r in keyed.groupBy("near").count().collect()}  # one row per shard
    return evened(ranked, [held.get(s, 0) for s in range(shards)])


def evened(ranked: DataFrame, held: list[int]) -> DataFrame:
    """`ranked` with shard and slot in place of near and rank (from 0 in each shard); `held` are the rows of each shard.

    Rows up to the even count stay. The surplus, shard by shard, fills the gaps of the others in runs."""
    shards, total = len(held), sum(held)
    even = [-(-total * (s + 1) // shards) - -(-total * s // shards) for s in range(shards)]
    over, gap = [max(h - e, 0) for h, e in zip(held, even, strict=True)], [max(e - h, 0) for h, e in zip(held, even, strict=True)]
    each = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    surplus = F.get(each(sum(over[:s]) for s in range(shards)), F.col("near")) + F.col("rank") - F.get(each(even), F.col("near"))
    begin = [sum(gap[:s]) for s in range(shards)]
    into = F.array_max(F.filter(F.array(*[F.struct(F.lit(b).cast("long").alias("begin"), F.lit(s).alias("shard")) for s, b in enumerate(begin) if gap[s]]
                                        or [F.struct(F.lit(0).cast("long").alias("begin"), F.lit(0).alias("shard"))]), lambda g: g["begin"] <= F.col("surplus")))
    stays = F.col("rank") < F.get(each(even), F.col("near"))
    found = ranked.withColumn("surplus", surplus).withColumn("into", F.when(~stays, into))
    return found.select("doc_id", "size", "text_crc32", "group", F.coalesce(F.col("into.shard"), F.col("near")).alias("shard"),
                        F.when(stays, F.col("rank")).otherwise(F.get(each(held), F.col("into.shard")) + F.col("surplus") - F.col("into.begin")).alias("slot"))


def cut_links(assigned: DataFrame) -> DataFrame:
    """One row: links (a group of n has n - 1) and how many of them join different shards; `assigned` has group and shard."""
    per = assigned.groupBy("group", "shard").agg(F.count("*").alias("n")).groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    return per.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("parts") - 1).alias("cut"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to 24 shards by the law of rows."""
    out = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
