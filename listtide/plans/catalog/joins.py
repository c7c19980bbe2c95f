"""J, W and the grouping part of A over documents, parts, customers, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.identity import identity_hash, place_key
from ...functions.text import strip_html
from ...operators import actions as A
from ...operators import groups, health, lending, merge, places, regress
from ...operators import listing as L
from ...session import materialize
from ...sources.feeds import first_seen, latest_entries
from .base import (AS_OF_EVENTS, DOCS, GROUPS, ORDERS, RANK_SQL, SOURCE_ORDER, document_listings, flag,
                   name_key_sql, order_listings, query, table, ts)


def keyed_documents(spark, sf):
    none = F.lit(None).cast("string")
    return document_listings(spark, sf).withColumn("k", identity_hash(none, F.col("description"), none))


def narrow_documents(spark, sf):
    """Key and narrow columns written once: plans that read them several times do not normalise the texts again."""
    cols = ["uuid", "status", "source", "user_status", "excluded", "exclusion_reason", "score", "score_it", "k"]
    return materialize(keyed_documents(spark, sf).select(*cols), "keyed")


# ---- borrowed descriptions ---------------------------------------------------------------------------------

# Parts as listings: every fourth part is thin; brand and type are the key, the name is the text.
_PARTS = """WITH p AS (SELECT concat('part-', lpad(cast(p_partkey AS string), 8, '0')) AS uuid,
CASE WHEN p_partkey % 4 = 0 THEN 'thin' WHEN p_partkey % 4 = 1 THEN 'full1' ELSE 'full2' END AS source, p_brand, p_type,
CASE WHEN p_partkey % 4 <> 0 THEN repeat(concat(p_name, ' '), cast(15 + p_size % 20 AS int)) END AS description FROM part),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY source, length(description) DESC, uuid) AS rn
FROM p WHERE source <> 'thin' AND length(trim(description)) >= 200),
best AS (SELECT p_brand, p_type, uuid AS lender, description AS text FROM c WHERE rn = 1) """


def part_listings(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('part-', lpad(cast(p_partkey AS string), 8, '0')) AS uuid",
        "CASE WHEN p_partkey % 4 = 0 THEN 'thin' WHEN p_partkey % 4 = 1 THEN 'full1' ELSE 'full2' END AS source",
        "p_brand", "p_type", "p_name AS title",
        "CASE WHEN p_partkey % 4 <> 0 THEN repeat(concat(p_name, ' '), cast(15 + p_size % 20 AS int)) END AS description",
        "cast(NULL AS string) AS description_borrowed_from")


def lent_parts(spark, sf):
    return lending.borrow(part_listings(spark, sf), ["p_brand", "p_type"], ["thin"], ["full1", "full2"],
                          F.trim(strip_html(F.col("description"))))


@query("j1_lend_by_key", _PARTS + """SELECT p.uuid, b.lender, CASE WHEN p.source = 'thin' THEN b.text ELSE p.description END AS description
FROM p LEFT JOIN best b ON p.source = 'thin' AND p.p_brand = b.p_brand AND p.p_type = b.p_type""")
def j1(spark, sf):
    return lent_parts(spark, sf).select("uuid", F.col("description_borrowed_from").alias("lender"), "description")


@query("w2_best_lender", _PARTS + "SELECT p_brand, p_type, lender FROM best")
def w2(spark, sf):
    return lending.best_lenders(part_listings(spark, sf), ["p_brand", "p_type"], ["full1", "full2"],
                                F.trim(strip_html(F.col("description"))))


@query("j9_detail_with_lender", _PARTS + """SELECT p.uuid, b.lender, q.source AS lender_source FROM p
LEFT JOIN best b ON p.source = 'thin' AND p.p_brand = b.p_brand AND p.p_type = b.p_type LEFT JOIN p q ON q.uuid = b.lender""")
def j9(spark, sf):
    return lending.with_lender(lent_parts(spark, sf)).select(
        "uuid", F.col("description_borrowed_from").alias("lender"), "lender_source")


# ---- tombstones, absence, snapshot difference --------------------------------------------------------------

@query("j2_skip_tombstones", DOCS + "SELECT uuid, source FROM l WHERE user_status <> 'archived'")
def j2(spark, sf):
    rows = document_listings(spark, sf)
    stones = rows.where(F.col("user_status") == "archived").select("uuid", ts(AS_OF_EVENTS).alias("dismissed_at"))
    return merge.drop_dismissed(rows, stones).select("uuid", "source")


@query("j2_readd_clears_tombstone", DOCS + "SELECT uuid FROM l WHERE user_status = 'archived' AND language <> 'en'")
def j2b(spark, sf):
    rows = document_listings(spark, sf)
    stones = rows.where(F.col("user_status") == "archived").select("uuid")
    return merge.revive(stones, rows.where(F.col("language") == "en"))


_SEEN = "(SELECT DISTINCT concat('ord-', lpad(cast(l_orderkey AS string), 9, '0')) AS uuid FROM lineitem WHERE l_linestatus = 'O')"


@query("j3_retire_absent", ORDERS + f"""SELECT uuid FROM l WHERE NOT (source = 'src4' AND user_status = 'new' AND flagged_at IS NULL
AND coalesce(notes, '') = '' AND NOT manually_added AND uuid NOT IN (SELECT uuid FROM {_SEEN} s))""")
def j3(spark, sf):
    from ...operators.lifecycle import never_shown_by_user
    li = table(spark, sf, "lineitem").where(F.col("l_linestatus") == "O")
    seen = li.select(F.concat(F.lit("ord-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("uuid"))
    parse = li.agg(F.count(F.lit(1)).alias("messages"), F.count(F.lit(1)).alias("cards"), F.count(F.lit(1)).alias("parsed"))
    return merge.retire_absent(order_listings(spark, sf), seen, parse, "src4", never_shown_by_user()).select("uuid")


@query("j4_snapshot_diff", ORDERS + f""", s AS (SELECT l.*, sn.uuid AS seen FROM l LEFT JOIN {_SEEN} sn ON l.uuid = sn.uuid),
g AS (SELECT count(*) AS a, count(seen) AS b FROM s WHERE source = 'src5' AND status = 'ACTIVE')
SELECT uuid, CASE WHEN source = 'src5' AND status = 'ACTIVE' AND seen IS NULL AND (a < 10 OR b >= 0.5 * a) THEN 'INACTIVE' ELSE status END AS status FROM s, g""")
def j4(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_linestatus") == "O")
    seen = li.select(F.concat(F.lit("ord-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("uuid"))
    complete = li.agg((F.count(F.lit(1)) > 0).alias("complete"))
    return merge.deactivate_missing(order_listings(spark, sf), seen, complete, "src5").select("uuid", "status")


@query("a11_survivor_guard", ORDERS + f""", s AS (SELECT l.*, sn.uuid AS seen FROM l LEFT JOIN {_SEEN} sn ON l.uuid = sn.uuid)
SELECT count(*) AS n_active, count(seen) AS n_survivors, CASE WHEN count(*) < 10 OR count(seen) >= 0.5 * count(*) THEN 1 ELSE 0 END AS trusted
FROM s WHERE source = 'src5' AND status = 'ACTIVE'""")
def a11(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_linestatus") == "O")
    seen = li.select(F.concat(F.lit("ord-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("uuid")).distinct().withColumn("_seen", F.lit(True))
    mine = order_listings(spark, sf).where((F.col("source") == "src5") & (F.col("status") == "ACTIVE")).join(seen, "uuid", "left")
    guard = merge.survivor_guard(mine, seen, li.agg((F.count(F.lit(1)) > 0).alias("complete")))
    return guard.select("n_active", "n_survivors", flag("trusted").alias("trusted"))


# ---- change detection --------------------------------------------------------------------------------------

# Yesterday's customers: two thirds of today's, some with another balance; others carry a tombstone.
_CUST = """WITH o AS (SELECT concat('c', cast(c_custkey AS string)) AS uuid, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal
FROM customer WHERE c_mktsegment <> 'MACHINERY'), t AS (SELECT concat('c', cast(c_custkey AS string)) AS uuid FROM customer WHERE c_nationkey = 3),
n AS (SELECT concat('c', cast(c_custkey AS string)) AS uuid, c_acctbal AS bal FROM customer),
k AS (SELECT n.uuid, CASE WHEN o.uuid IS NULL AND t.uuid IS NOT NULL THEN 'skipped' WHEN o.uuid IS NULL THEN 'new'
WHEN o.bal = n.bal THEN 'unchanged' ELSE 'updated' END AS outcome FROM n LEFT JOIN o ON n.uuid = o.uuid LEFT JOIN t ON n.uuid = t.uuid) """


def customer_changes(spark, sf):
    c = table(spark, sf, "customer").withColumn("uuid", F.concat(F.lit("c"), F.col("c_custkey")))
    old = c.where(F.col("c_mktsegment") != "MACHINERY").select("uuid", F.to_json(F.struct(
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("bal"))).alias("raw_json"))
    new = c.select("uuid", F.to_json(F.struct(F.col("c_acctbal").alias("bal"))).alias("raw_json"))
    return merge.change_kind(new, old, c.where(F.col("c_nationkey") == 3).select("uuid"))


@query("j5a_change_kind", _CUST + "SELECT uuid, outcome FROM k")
def j5a(spark, sf):
    return customer_changes(spark, sf)


@query("a10_ingest_counters", _CUST + "SELECT outcome, count(*) AS n FROM k GROUP BY outcome")
def a10(spark, sf):
    from ...sources.runs import outcome_counts
    return outcome_counts(customer_changes(spark, sf))


@query("j5b_reuse_language", """SELECT concat('d', cast(doc_id AS string)) AS uuid, CASE WHEN source IN ('src1', 'src2') THEN lang ELSE 'fresh' END AS language FROM documents""")
def j5b(spark, sf):
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("uuid"), F.col("text").alias("description"), "source",
        F.col("lang").alias("language"))
    same = F.col("source").isin("src1", "src2")
    new = d.select("uuid", F.when(same, F.col("description")).otherwise(F.concat("description", F.lit("!"))).alias("description"))
    return merge.reuse_language(new, d, F.lit("fresh")).select("uuid", "language")


@query("j5c_keep_enriched", """SELECT concat('d', cast(doc_id AS string)) AS uuid, CASE WHEN length(text) >= 300 THEN text ELSE 'summary' END AS description FROM documents""")
def j5c(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("uuid"), F.col("text").alias("description"))
    return merge.keep_enriched(d.select("uuid", F.lit("summary").alias("description")), d)


# ---- places ------------------------------------------------------------------------------------------------

_PLACES = "SELECT upper(n_name) AS place, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"


def nation_places(spark, sf):
    r = table(spark, sf, "region").withColumnRenamed("r_name", "name")
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"))).alias("municipality"))
    return places.region_map(r.join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("name", "municipality"))


def customer_places(spark, sf):
    """Customers with a place name that is spelled with blanks and case, and unknown for one segment."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("uuid"), "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Nowhere")).otherwise(
            F.concat(F.lit(" "), F.initcap("n_name"), F.lit(" "))).alias("municipal"), "n_name", "c_mktsegment")


@query("s8_region_map", f"SELECT place, region FROM ({_PLACES}) p")
def s8(spark, sf):
    return nation_places(spark, sf)


@query("j6a_place_region", f"""SELECT concat('c', cast(c_custkey AS string)) AS uuid, CASE WHEN c_mktsegment <> 'BUILDING' THEN r_name END AS county
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j6a(spark, sf):
    return places.resolve_region(customer_places(spark, sf), nation_places(spark, sf)).select("uuid", "county")


@query("j6b_free_location", """SELECT concat('c', cast(c_custkey AS string)) AS uuid,
CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN n_name WHEN 3 THEN 'Unknown' WHEN 4 THEN r_name END AS municipal,
CASE WHEN c_custkey % 6 <> 5 THEN r_name END AS county
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j6b(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    name, reg, i = F.col("n_name"), F.col("r_name"), F.col("c_custkey") % 6
    loc = (F.when(i == 0, name).when(i == 1, F.concat(name, F.lit(", Worldland")))
           .when(i == 2, F.concat(F.lit("Greater "), name, F.lit(" Region, Area, Worldland")))
           .when(i == 3, F.concat(F.lit("Unknown/"), name)).when(i == 4, F.concat(reg, F.lit(", worldland")))
           .otherwise(F.lit("Worldland")))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("uuid"), loc.alias("loc"))
    return places.resolve_location(rows, nation_places(spark, sf), "loc", "Worldland", (r"^greater\s+", r"\s+region$")).select(
        "uuid", "municipal", "county")


@query("j6c_tier_place", """SELECT concat('c', cast(c_custkey AS string)) AS uuid, CASE WHEN r_name = 'ASIA' AND n_nationkey % 2 = 0 THEN 'HUB' ELSE upper(n_name) END AS tier_place,
CASE WHEN r_name = 'ASIA' AND n_nationkey % 2 = 0 THEN 15 WHEN r_name = 'EUROPE' THEN 10 WHEN r_name = 'ASIA' THEN 7 ELSE 0 END AS points
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j6c(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("uuid"), F.col("n_name").alias("municipal"), F.col("r_name").alias("county"))
    tiers = n.where(F.col("n_nationkey") % 2 == 0).select(place_key(F.col("n_name")).alias("place"), F.lit("HUB").alias("municipality"))
    out = places.resolve_tier_place(rows, tiers, "ASIA")
    points = (F.when(F.col("tier_place") == "HUB", 15).when(F.upper("county") == "EUROPE", 10)
              .when(F.upper("county") == "ASIA", 7).otherwise(0))
    return out.select("uuid", "tier_place", points.alias("points"))


@query("j12_travel_time", """SELECT concat('c', cast(c_custkey AS string)) AS uuid, CASE WHEN c_mktsegment = 'BUILDING' OR n_nationkey % 3 = 2 THEN 'unknown'
WHEN n_nationkey % 3 = 1 THEN 'no_route' ELSE 'found' END AS reach,
CASE WHEN c_mktsegment <> 'BUILDING' AND n_nationkey % 3 = 0 THEN n_nationkey * 10 END AS duration_min FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def j12(spark, sf):
    n = table(spark, sf, "nation").where(F.col("n_nationkey") % 3 < 2)
    ok = F.col("n_nationkey") % 3 == 0
    travel = n.select(place_key(F.col("n_name")).alias("place"), F.when(ok, F.col("n_nationkey") * 10).alias("duration_min"),
                      F.array(F.lit("bus")).alias("modes"), F.when(~ok, F.lit("no_route")).alias("error"))
    return places.with_travel_time(customer_places(spark, sf), travel).select("uuid", "reach", "duration_min")


# ---- copy groups -------------------------------------------------------------------------------------------

@query("a7_copy_groups", DOCS + """SELECT min(uuid) AS first_uuid, count(*) AS n, count(DISTINCT source) AS n_sources,
CASE WHEN count(DISTINCT source) >= 2 AND count(*) = count(DISTINCT source) THEN 1 ELSE 0 END AS unambiguous FROM l GROUP BY k""")
def a7(spark, sf):
    return groups.group_stats(keyed_documents(spark, sf), ["k"], "source").select(
        "first_uuid", "n", "n_sources", flag("unambiguous").alias("unambiguous"))


@query("a8_sources_per_key", DOCS + "SELECT min(uuid) AS first_uuid, count(DISTINCT source) AS n_sources FROM l GROUP BY k")
def a8(spark, sf):
    return groups.group_stats(keyed_documents(spark, sf), ["k"], "source").select("first_uuid", "n_sources")


@query("w3_keeper", GROUPS + f""", r AS (SELECT uuid, source, k, row_number() OVER (PARTITION BY k ORDER BY greatest(score, score_it) DESC, {RANK_SQL}, uuid) AS rn,
count(*) OVER (PARTITION BY k) AS live FROM u WHERE NOT excluded),
kp AS (SELECT k, source AS keeper FROM r WHERE rn = 1 AND live >= 2)
SELECT uuid, concat('duplicate: the same listing is shown from source ', keeper) AS reason FROM r JOIN kp USING (k) WHERE rn > 1""")
def w3(spark, sf):
    g = groups.copy_groups(keyed_documents(spark, sf), ["k"], "source", groups.PAYLOAD)
    m = groups.members(g, groups.hide_duplicates(F.col("members"), SOURCE_ORDER))
    return m.where(F.startswith("exclusion_reason", F.lit(groups.DUPLICATE_PREFIX))).select(
        "uuid", F.col("exclusion_reason").alias("reason"))


_STATUS_RANK = "CASE user_status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(groups.STATUS_FILL_ORDER)) + " ELSE 99 END"


@query("w4_status_fill", GROUPS + f""", d AS (SELECT k, user_status AS st, row_number() OVER (PARTITION BY k ORDER BY {_STATUS_RANK}, uuid) AS rn FROM u WHERE user_status <> 'new')
SELECT uuid, CASE WHEN user_status = 'new' AND st IS NOT NULL THEN st ELSE user_status END AS user_status FROM u LEFT JOIN d ON u.k = d.k AND d.rn = 1""")
def w4(spark, sf):
    g = groups.copy_groups(keyed_documents(spark, sf), ["k"], "source", groups.PAYLOAD)
    return groups.members(g, groups.fill_status(F.col("members"))).select("uuid", "user_status")


@query("w5_block_copy", GROUPS + """, d AS (SELECT k, exclusion_reason AS why, row_number() OVER (PARTITION BY k ORDER BY uuid) AS rn FROM u WHERE excluded)
SELECT uuid, coalesce(exclusion_reason, why) AS reason FROM u LEFT JOIN d ON u.k = d.k AND d.rn = 1""")
def w5(spark, sf):
    g = groups.copy_groups(keyed_documents(spark, sf), ["k"], "source", groups.PAYLOAD)
    return groups.members(g, groups.copy_blocks(F.col("members"))).select("uuid", F.col("exclusion_reason").alias("reason"))


@query("j7_settled_groups", GROUPS + f""", sd AS (SELECT k, user_status AS st, row_number() OVER (PARTITION BY k ORDER BY {_STATUS_RANK}, uuid) AS rn FROM u WHERE user_status <> 'new'),
bd AS (SELECT k, exclusion_reason AS why, row_number() OVER (PARTITION BY k ORDER BY uuid) AS rn FROM u WHERE excluded),
m AS (SELECT u.*, CASE WHEN user_status = 'new' AND st IS NOT NULL THEN st ELSE user_status END AS st2, coalesce(exclusion_reason, why) AS why2
FROM u LEFT JOIN sd ON u.k = sd.k AND sd.rn = 1 LEFT JOIN bd ON u.k = bd.k AND bd.rn = 1),
r AS (SELECT *, CASE WHEN why2 IS NULL THEN row_number() OVER (PARTITION BY k, why2 IS NULL ORDER BY greatest(score, score_it) DESC, {RANK_SQL}, uuid) END AS rn FROM m),
kp AS (SELECT k, source AS keeper FROM r WHERE rn = 1)
SELECT uuid, st2 AS user_status, CASE WHEN rn > 1 THEN concat('duplicate: the same listing is shown from source ', keeper) ELSE why2 END AS reason
FROM r LEFT JOIN kp ON r.k = kp.k""")
def j7(spark, sf):
    return groups.settle(keyed_documents(spark, sf), ["k"], SOURCE_ORDER).select(
        "uuid", "user_status", F.col("exclusion_reason").alias("reason"))


@query("j8_action_reaches_copies", DOCS + """, g AS (SELECT k, count(*) AS n, count(DISTINCT source) AS ns FROM l GROUP BY k),
a AS (SELECT uuid, k, CASE WHEN user_status = 'archived' THEN 'rejected' ELSE 'offer' END AS st, uuid AS seq FROM l WHERE user_status IN ('archived', 'interesting')),
e AS (SELECT l.uuid, a.st, a.seq FROM a JOIN g ON a.k = g.k JOIN l ON l.k = a.k WHERE l.uuid = a.uuid OR (g.ns >= 2 AND g.n = g.ns)),
f AS (SELECT uuid, st, row_number() OVER (PARTITION BY uuid ORDER BY seq DESC) AS rn FROM e) SELECT uuid, st AS user_status FROM f WHERE rn = 1""")
def j8(spark, sf):
    rows = narrow_documents(spark, sf)
    acts = rows.where(F.col("user_status").isin("archived", "interesting")).select(
        "uuid", F.when(F.col("user_status") == "archived", "rejected").otherwise("offer").alias("status"),
        F.substring("uuid", 5, 9).cast("long").alias("seq"))
    return groups.spread_actions(rows, ["k"], acts)


@query("j11_orphaned_duplicates", DOCS + """, a AS (SELECT * FROM l WHERE source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5')), g AS (SELECT k, count(DISTINCT source) AS ns FROM a GROUP BY k),
before AS (SELECT k, count(*) AS n, count(DISTINCT source) AS ns FROM l GROUP BY k)
SELECT a.uuid FROM a JOIN g USING (k) JOIN before USING (k) WHERE g.ns = 1 AND before.ns >= 2 AND NOT a.excluded""")
def j11(spark, sf):
    rows = narrow_documents(spark, sf)
    was = rows.join(groups.group_stats(rows, ["k"], "source").where(F.col("n_sources") >= 2), "k", "left_semi").select("uuid")
    left = rows.where(~F.col("source").isin("src0", "src1", "src2", "src3", "src4", "src5"))
    return groups.orphaned_duplicates(left, ["k"], was)


# ---- freshness, attempts, first and last states ------------------------------------------------------------

_LIMITS = {"click": (0.005, 0.05), "view": (0.002, 1.0), "signup": (1.0, 2.0), "error": (0.0, 0.0)}


def event_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id")).alias("uuid"), F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("first_seen_at"), "user_id", "value", "event_id")


def last_run(spark, sf):
    return event_rows(spark, sf).agg(F.max("first_seen_at").alias("watermark"))


_AGE = """WITH w AS (SELECT max(ts) AS m FROM events), f AS (SELECT event_type AS source,
(epoch_us(any_value(m)) - epoch_us(max(ts))) / 86400000000.0 AS age_days FROM events, w GROUP BY event_type) """


@query("a5_freshness", _AGE + "SELECT source, cast(age_days AS double) AS age_days FROM f")
def a5(spark, sf):
    return health.freshness(event_rows(spark, sf), last_run(spark, sf))


@query("j13_freshness_levels", _AGE + """, t AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{s}', {w}, {b})" for s, (w, b) in _LIMITS.items()) + """) v(source, warn_at, bad_at))
SELECT source, CASE WHEN age_days >= bad_at THEN 'bad' WHEN age_days >= warn_at THEN 'warn' ELSE 'ok' END AS level FROM f JOIN t USING (source)""")
def j13(spark, sf):
    config = health.HealthConfig(order=sorted(_LIMITS), freshness=_LIMITS)
    fresh = health.freshness(event_rows(spark, sf), last_run(spark, sf))
    return health.freshness_levels(fresh, health.thresholds(spark, config)).select("source", "level")


@query("a17_failed_attempts", """WITH ok AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY user_id),
f AS (SELECT e.user_id, count(*) FILTER (WHERE event_type = 'error' AND (t IS NULL OR ts > t)) AS failures FROM events e LEFT JOIN ok ON e.user_id = ok.user_id
WHERE event_type IN ('purchase', 'error') GROUP BY e.user_id)
SELECT concat('u', cast(user_id AS string)) AS uuid, failures, CASE WHEN failures >= 3 THEN 1 ELSE 0 END AS give_up FROM f""")
def a17(spark, sf):
    e = event_rows(spark, sf).where(F.col("source").isin("purchase", "error"))
    log = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("uuid"), F.col("first_seen_at").alias("ts"),
                   F.when(F.col("source") == "purchase", "ok").otherwise("failed").alias("outcome"))
    return A.failed_attempts(log).select("uuid", "failures", flag("give_up").alias("give_up"))


@query("w1_latest_state", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT concat('u', cast(user_id AS string)) AS uuid, event_type AS status, props AS stamp FROM r WHERE rn = 1""")
def w1(spark, sf):
    e = table(spark, sf, "events")
    entries = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("uuid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
                       F.col("event_id").alias("idx"), F.col("event_type").alias("status"), F.lit("t").alias("title"),
                       F.lit("b").alias("business_name"), F.lit("m").alias("municipal"), F.col("props").alias("stamp"),
                       F.lit(False).alias("malformed"))
    return latest_entries(entries).select("uuid", "status", "stamp")


@query("w8_first_occurrence", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT cast(conv_id AS string) AS uuid, role, text FROM r WHERE rn = 1""")
def w8(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("uuid"), F.col("turn").alias("seq"), "role", "text")
    return first_seen(c).select("uuid", "role", "text")


# ---- ranking regression ------------------------------------------------------------------------------------

# Two scorings of the customers: before and after.
_RANKS = """WITH s AS (SELECT concat('c', cast(c_custkey AS string)) AS uuid, c_mktsegment AS title, c_nationkey AS nk,
cast(floor(abs(c_acctbal) / 100) AS int) AS s1, cast(floor(abs(c_acctbal) / 100) AS int) - CASE WHEN c_custkey % 4 = 0 THEN 10 ELSE 0 END AS s2 FROM customer),
v AS (SELECT count(*) AS nv FROM s WHERE nk <> 7),
h1 AS (SELECT s1, count(*) FILTER (WHERE nk <> 7) AS c FROM s GROUP BY s1), h2 AS (SELECT s2, count(*) FILTER (WHERE nk <> 7) AS c FROM s GROUP BY s2),
q1 AS (SELECT s1, 100.0 * coalesce(sum(c) OVER (ORDER BY s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nv AS p1 FROM h1, v),
q2 AS (SELECT s2, 100.0 * coalesce(sum(c) OVER (ORDER BY s2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nv AS p2 FROM h2, v),
b AS (SELECT s.*, cast(p1 AS double) AS p1, cast(p2 AS double) AS p2 FROM s JOIN q1 USING (s1) JOIN q2 USING (s2)) """


def customer_scores(spark, sf):
    c = table(spark, sf, "customer")
    base = F.floor(F.abs("c_acctbal") / 100).cast("int")
    common = [F.concat(F.lit("c"), F.col("c_custkey")).alias("uuid"), F.col("c_mktsegment").alias("title"),
              (F.col("c_nationkey") != 7).alias("visible"),
              F.when(F.col("c_nationkey") < 12, "applied").otherwise("new").alias("user_status")]
    before = c.select(*common, base.alias("score"))
    after = c.select(*common, (base - F.when(F.col("c_custkey") % 4 == 0, 10).otherwise(0)).alias("score"))
    return before, after


@query("a16_percentile", _RANKS + "SELECT uuid, s1 AS score, p1 AS percentile FROM b")
def a16(spark, sf):
    before, _ = customer_scores(spark, sf)
    return regress.percentiles(before, "score", F.col("visible")).select("uuid", "score", "percentile")


@query("j10_before_after", _RANKS + "SELECT uuid, s1 AS before, p1 AS p_before, s2 AS after, p2 AS p_after FROM b")
def j10(spark, sf):
    return regress.compare(*customer_scores(spark, sf), "score").select("uuid", "before", "p_before", "after", "p_after")


@query("w6_drop_outs", _RANKS + """SELECT uuid, s1 AS before, p1 AS p_before, s2 AS after, p2 AS p_after FROM b
WHERE nk < 12 AND p1 >= 95 AND p2 < 95 AND NOT contains(lower(title), 'machin')""")
def w6(spark, sf):
    out = regress.drop_outs(*customer_scores(spark, sf), "score", ("applied",), expected=("machin",))
    return out.select("uuid", "before", "p_before", "after", "p_after")


@query("w12_top_per_profile", """WITH r AS (SELECT concat('c', cast(c_custkey AS string)) AS uuid, c_mktsegment AS profile,
row_number() OVER (PARTITION BY c_mktsegment ORDER BY cast(floor(abs(c_acctbal) / 100) AS int) DESC, concat('c', cast(c_custkey AS string))) AS rank FROM customer)
SELECT uuid, profile, cast(rank AS int) AS rank FROM r WHERE rank <= 30""")
def w12(spark, sf):
    before, _ = customer_scores(spark, sf)
    return regress.top_rows(before.withColumnRenamed("title", "profile"), "profile", "score").select("uuid", "profile", "rank")


@query("f13_identity_key", f"""SELECT s_suppkey, {name_key_sql("concat(s_name, ' AS & Sons ASA.')")} AS employer, {name_key_sql("replace(s_name, '#', ' kf/')")} AS title,
upper(trim(concat(' nation ', cast(s_nationkey AS string)))) AS place FROM supplier""")
def f13(spark, sf):
    from ...functions.identity import identity_key
    key = identity_key(F.concat("s_name", F.lit(" AS & Sons ASA.")), F.replace("s_name", F.lit("#"), F.lit(" kf/")),
                       F.concat(F.lit(" nation "), F.col("s_nationkey")))
    return table(spark, sf, "supplier").select("s_suppkey", key.alias("k")).select("s_suppkey", "k.employer", "k.title", "k.place")
