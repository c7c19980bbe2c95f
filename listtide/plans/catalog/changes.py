"""U: merges, retention and transitions over customers, orders, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.dates import normalize_due_date
from ...functions.figures import extent_percent
from ...functions.text import detect_language
from ...operators import actions as A
from ...operators import lifecycle, merge
from ...schema import DEFAULTS, add_marker, align, union_sources
from .base import AS_OF, AS_OF_EVENTS, DOCS, ORDERS, document_listings, flag, order_listings, query, table, ts

# Stored rows: customers outside one segment. Incoming rows: customers of five nations and up, with holes.
_SIDES = """WITH st AS (SELECT concat('c', cast(c_custkey AS string)) AS uuid, 'ACTIVE' AS status, concat('old ', c_name) AS title, concat('Co ', cast(c_nationkey AS string)) AS business_name,
concat('text of ', c_name) AS description, '2024-01-31' AS application_due, 'Full time' AS extent, 'en' AS language,
c_custkey % 2 = 0 AS manually_added, 'interesting' AS user_status FROM customer WHERE c_mktsegment <> 'FURNITURE'),
inc AS (SELECT concat('c', cast(c_custkey AS string)) AS uuid, CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS title,
CASE WHEN c_custkey % 3 <> 0 THEN concat('Firm ', cast(c_nationkey AS string)) END AS business_name,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('new text of ', c_name) END AS description,
CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'running' WHEN 2 THEN '15.3.2024' END AS application_due,
CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Part time' END AS extent, 'de' AS language, c_custkey % 5 = 0 AS manually_added FROM customer WHERE c_nationkey >= 5),
j AS (SELECT coalesce(st.uuid, inc.uuid) AS k, st.uuid IS NOT NULL AS ho, inc.uuid IS NOT NULL AS hn, st.*, inc.uuid AS iuuid, inc.status AS istatus, inc.title AS ititle,
inc.business_name AS ib, inc.description AS idesc, inc.application_due AS idue, inc.extent AS iext, inc.language AS ilang, inc.manually_added AS iman
FROM st FULL JOIN inc ON st.uuid = inc.uuid) """


def stored_side(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_mktsegment") != "FURNITURE").selectExpr(
        "concat('c', cast(c_custkey AS string)) AS uuid", "'ACTIVE' AS status", "concat('old ', c_name) AS title",
        "concat('Co ', cast(c_nationkey AS string)) AS business_name", "concat('text of ', c_name) AS description",
        "'2024-01-31' AS application_due", "DATE '2024-01-31' AS application_due_sort", "'Full time' AS extent",
        "'en' AS language", "c_custkey % 2 = 0 AS manually_added", "'interesting' AS user_status")


def incoming_side(spark, sf):
    due = """CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'running' WHEN 2 THEN '15.3.2024' END"""
    return table(spark, sf, "customer").where(F.col("c_nationkey") >= 5).selectExpr(
        "concat('c', cast(c_custkey AS string)) AS uuid", "CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status",
        "CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS title",
        "CASE WHEN c_custkey % 3 <> 0 THEN concat('Firm ', cast(c_nationkey AS string)) END AS business_name",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('new text of ', c_name) END AS description",
        f"{due} AS application_due", "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Part time' END AS extent",
        "'de' AS language", "c_custkey % 5 = 0 AS manually_added",
    ).withColumn("application_due_sort", normalize_due_date(F.col("application_due")))


_OUT = "uuid status title business_name description extent language user_status".split()


def _merged(spark, sf, policy):
    m = merge.merge(stored_side(spark, sf), incoming_side(spark, sf), policy, defaults=DEFAULTS)
    return m.select(*_OUT, F.col("application_due_sort").cast("string").alias("due"),
                    flag("manually_added").alias("manual"), F.col("_outcome").alias("outcome"))


_OUTCOME = "CASE WHEN ho AND hn THEN 'merged' WHEN hn THEN 'new' ELSE 'kept' END AS outcome"
_IDUE = "CASE WHEN idue = '15.3.2024' THEN '2024-03-15' END"


@query("u1_overwrite_merge", _SIDES + f"""SELECT k AS uuid, CASE WHEN hn THEN istatus ELSE status END AS status, CASE WHEN hn THEN ititle ELSE title END AS title,
CASE WHEN hn THEN ib ELSE business_name END AS business_name, CASE WHEN hn THEN idesc ELSE description END AS description,
CASE WHEN hn THEN iext ELSE extent END AS extent, CASE WHEN hn THEN ilang ELSE language END AS language,
coalesce(user_status, 'new') AS user_status, CASE WHEN hn THEN {_IDUE} ELSE '2024-01-31' END AS due,
cast(CASE WHEN ho THEN manually_added ELSE iman END AS int) AS manual, {_OUTCOME} FROM j""")
def u1(spark, sf):
    return _merged(spark, sf, merge.OVERWRITE)


@query("u2_merge_policy", _SIDES + f"""SELECT k AS uuid, CASE WHEN hn THEN istatus ELSE status END AS status, CASE WHEN hn THEN ititle ELSE title END AS title,
coalesce(ib, business_name) AS business_name, coalesce(idesc, description) AS description,
CASE WHEN ho THEN coalesce(nullif(iext, ''), extent) ELSE iext END AS extent,
CASE WHEN ho AND idesc IS NULL THEN language WHEN hn THEN ilang ELSE language END AS language, coalesce(user_status, 'new') AS user_status,
CASE WHEN NOT ho THEN {_IDUE} WHEN coalesce(idue, '') = '' THEN '2024-01-31' ELSE {_IDUE} END AS due,
greatest(cast(coalesce(manually_added, false) AS int), cast(coalesce(iman, false) AS int)) AS manual, {_OUTCOME} FROM j""")
def u2(spark, sf):
    return _merged(spark, sf, merge.PARTIAL)


@query("u3_status_only_merge", _SIDES + f"""SELECT k AS uuid, CASE WHEN hn THEN istatus ELSE status END AS status, CASE WHEN ho THEN title ELSE ititle END AS title,
CASE WHEN ho THEN business_name ELSE ib END AS business_name, description, coalesce(user_status, 'new') AS user_status, {_OUTCOME} FROM j""")
def u3(spark, sf):
    stub = incoming_side(spark, sf).select("uuid", "status", "title", "business_name")
    m = merge.merge(stored_side(spark, sf), stub, merge.STATUS_ONLY, defaults=DEFAULTS)
    return m.select("uuid", "status", "title", "business_name", "description", "user_status", F.col("_outcome").alias("outcome"))


@query("u4_tombstones_idempotent", DOCS + f"""SELECT uuid, CASE WHEN source = 'src1' THEN '2023-01-01' ELSE '{AS_OF_EVENTS[:10]}' END AS dismissed FROM l
WHERE user_status = 'archived' OR source = 'src1'""")
def u4(spark, sf):
    rows = document_listings(spark, sf)
    old = rows.where(F.col("source") == "src1").select("uuid", ts("2023-01-01 00:00:00").alias("dismissed_at"))
    once = merge.add_tombstones(old, rows.where(lifecycle.trashed()), ts(AS_OF_EVENTS))
    twice = merge.add_tombstones(once, rows.where(lifecycle.trashed()), ts(AS_OF_EVENTS))
    return twice.select("uuid", F.to_date("dismissed_at").cast("string").alias("dismissed"))


_UNTOUCHED = "user_status = 'new' AND flagged_at IS NULL AND coalesce(notes, '') = ''"


@query("u5a_delete_inactive", ORDERS + f"SELECT uuid FROM l WHERE NOT (status = 'INACTIVE' AND {_UNTOUCHED})")
def u5a(spark, sf):
    return lifecycle.keep(order_listings(spark, sf), lifecycle.inactive_untouched()).select("uuid")


_STALE = f"source IN ('src1', 'src2') AND {_UNTOUCHED} AND NOT manually_added AND first_seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY"


@query("u5b_retire_stale_digest", ORDERS + f"SELECT uuid, CASE WHEN {_STALE} THEN 'tombstone' ELSE 'kept' END AS fate FROM l")
def u5b(spark, sf):
    rows, rule = order_listings(spark, sf), lifecycle.stale_digest(ts(AS_OF), ("src1", "src2"))
    none = rows.limit(0).select("uuid", F.lit(None).cast("timestamp").alias("dismissed_at"))
    stones = merge.add_tombstones(none, lifecycle.removed(rows, rule), ts(AS_OF)).select("uuid", F.lit("tombstone").alias("fate"))
    return stones.unionByName(lifecycle.keep(rows, rule).select("uuid", F.lit("kept").alias("fate")))


@query("u5c_delete_trashed", ORDERS + "SELECT uuid FROM l WHERE user_status <> 'archived'")
def u5c(spark, sf):
    return lifecycle.keep(order_listings(spark, sf), lifecycle.trashed()).select("uuid")


@query("u5d_delete_expired", ORDERS + f"SELECT uuid FROM l WHERE NOT ({_UNTOUCHED} AND coalesce(application_due_sort < DATE '{AS_OF[:10]}', false))")
def u5d(spark, sf):
    return lifecycle.keep(order_listings(spark, sf), lifecycle.past_due_untouched(ts(AS_OF))).select("uuid")


_ANCHOR = "CASE WHEN applied_at IS NOT NULL THEN greatest(cast(applied_at AS date), coalesce(application_due_sort, cast(applied_at AS date))) ELSE application_due_sort END"


def _shift(d: str) -> str:
    return (f"make_date(cast(year({d}) + (month({d}) + 1) // 12 AS bigint), cast((month({d}) + 1) % 12 + 1 AS bigint), 1) "
            f"+ cast(day({d}) - 1 AS int)")


@query("u6_ignore_silent", ORDERS + f""", a AS (SELECT uuid, user_status, {_ANCHOR} AS d FROM l)
SELECT uuid, CASE WHEN user_status = 'applied' AND {_shift('d')} <= DATE '{AS_OF[:10]}' THEN 'ignored' ELSE user_status END AS user_status FROM a""")
def u6(spark, sf):
    return lifecycle.ignore_silent(order_listings(spark, sf), ts(AS_OF)).select("uuid", "user_status")


@query("u7_silence_date", ORDERS + f", a AS (SELECT uuid, {_ANCHOR} AS d FROM l) SELECT uuid, cast({_shift('d')} AS string) AS ignored_on FROM a")
def u7(spark, sf):
    return order_listings(spark, sf).select("uuid", lifecycle.silence_date().cast("string").alias("ignored_on"))


@query("u8_manual_edit", """WITH c AS (SELECT concat('c', cast(c_custkey AS string)) AS uuid, c_custkey AS n, c_name, c_mktsegment <> 'FURNITURE' AS stored,
c_nationkey < 8 AS edited, c_custkey % 2 = 0 AS same FROM customer)
SELECT uuid, CASE WHEN edited THEN CASE WHEN n % 3 = 0 THEN NULL ELSE concat('edit ', c_name) END ELSE concat('old ', c_name) END AS title,
CASE WHEN edited AND NOT same THEN 'own words' ELSE concat('text of ', c_name) END AS description,
CASE WHEN edited AND NOT same THEN 'xx' ELSE 'en' END AS language, CASE WHEN edited AND NOT same THEN NULL ELSE 'lender' END AS borrowed FROM c WHERE stored""")
def u8(spark, sf):
    stored = stored_side(spark, sf).withColumn("description_borrowed_from", F.lit("lender"))
    edits = table(spark, sf, "customer").where(F.col("c_nationkey") < 8).selectExpr(
        "concat('c', cast(c_custkey AS string)) AS uuid", "CASE WHEN c_custkey % 3 <> 0 THEN concat('edit ', c_name) END AS title",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('text of ', c_name) ELSE 'own words' END AS description")
    return merge.apply_edits(stored, edits, F.lit("xx")).select(
        "uuid", "title", "description", "language", F.col("description_borrowed_from").alias("borrowed"))


# Events as user actions: the event type names the field, the value is derived from its number.
def event_actions(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("uuid"),
        F.when(kind == "click", "status").when(kind == "view", "flag").when(kind == "signup", "note").when(kind == "error", "profile").otherwise("status").alias("field"),
        F.when(kind == "purchase", "applied").when(kind == "click", F.when(F.col("value") < 5, "bogus").otherwise("interesting"))
        .when(kind == "view", F.when(F.col("value") < 10, "1").otherwise("0"))
        .when(kind == "signup", F.when(F.col("value") < 5, "").otherwise(F.col("props"))).otherwise("desk").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


_ACTIONS = """WITH e AS (SELECT concat('u', cast(user_id AS string)) AS uuid, ts, event_id, CASE event_type WHEN 'click' THEN 'status' WHEN 'view' THEN 'flag' WHEN 'signup' THEN 'note' WHEN 'error' THEN 'profile' ELSE 'status' END AS field,
CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'click' THEN CASE WHEN value < 5 THEN 'bogus' ELSE 'interesting' END WHEN 'view' THEN CASE WHEN value < 10 THEN '1' ELSE '0' END
WHEN 'signup' THEN CASE WHEN value < 5 THEN '' ELSE props END ELSE 'desk' END AS v FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY uuid, field ORDER BY ts DESC, event_id DESC) AS rn FROM e WHERE v <> 'bogus') """


@query("u9_action_fold", _ACTIONS + """, ap AS (SELECT uuid, max(ts) AS t FROM e WHERE v = 'applied' GROUP BY uuid), us AS (SELECT DISTINCT uuid FROM e)
SELECT us.uuid, s.v AS user_status, epoch_us(ap.t) AS applied_us, CASE WHEN f.v = '1' THEN epoch_us(f.ts) END AS flagged_us, nullif(n.v, '') AS notes, p.v AS profile
FROM us LEFT JOIN r s ON us.uuid = s.uuid AND s.field = 'status' AND s.rn = 1 LEFT JOIN ap ON us.uuid = ap.uuid
LEFT JOIN r f ON us.uuid = f.uuid AND f.field = 'flag' AND f.rn = 1 LEFT JOIN r n ON us.uuid = n.uuid AND n.field = 'note' AND n.rn = 1
LEFT JOIN r p ON us.uuid = p.uuid AND p.field = 'profile' AND p.rn = 1""")
def u9(spark, sf):
    f = A.fold(event_actions(spark, sf))
    return f.select("uuid", "user_status", F.unix_micros("applied_at").alias("applied_us"),
                    F.unix_micros("flagged_at").alias("flagged_us"), "notes", "profile")


@query("u9_latest_value", """WITH r AS (SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT concat('u', cast(user_id AS string)) AS uuid, event_type AS field, props AS value FROM r WHERE rn = 1""")
def u9b(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("uuid"), F.col("event_type").alias("field"), F.col("props").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    return A.latest_values(e).select("uuid", "field", "value")


@query("u10_union_sources", """SELECT concat('cust-', cast(c_custkey AS string)) AS uuid, c_name AS title, c_mktsegment AS sector, cast(NULL AS string) AS municipal, 'new' AS user_status FROM customer
UNION ALL SELECT concat('sup-', cast(s_suppkey AS string)), s_name, NULL, concat('N', cast(s_nationkey AS string)), 'new' FROM supplier""")
def u10(spark, sf):
    a = table(spark, sf, "customer").select(F.concat(F.lit("cust-"), F.col("c_custkey")).alias("uuid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("sector"))
    b = table(spark, sf, "supplier").select(F.concat(F.lit("sup-"), F.col("s_suppkey")).alias("uuid"), F.col("s_name").alias("title"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("municipal"))
    return align(union_sources(a, b)).select("uuid", "title", "sector", "municipal", "user_status")


# Documents as listings with landed detail texts: English ones come back full, German ones empty, others were not tried.
_DETAILS = """WITH d AS (SELECT concat('d', cast(doc_id AS string)) AS uuid, lang, text, n_chars FROM documents) """


def enriched_documents(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("uuid"), F.col("lang"), "text")
    stored = d.select("uuid", F.lit("summary").alias("description"), F.lit("zz").alias("language"),
                      F.lit(50).alias("extent_percent"), ts("2024-01-05 00:00:00").alias("description_fetch_attempted_at"))
    tail = F.when(F.contains("text", F.lit("and")), F.lit(" The position is 80 % of full time, a good position.")).otherwise("")
    details = d.where(F.col("lang").isin("en", "de")).select(
        "uuid", F.when(F.col("lang") == "en", F.concat("text", tail)).alias("text"))
    extent = extent_percent(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("description"))
    return merge.apply_full_texts(stored, details, ts("2024-01-09 00:00:00"), detect_language(F.col("description")), extent)


@query("u11_attempt_times", _DETAILS + "SELECT uuid, CASE WHEN lang IN ('en', 'de') THEN '2024-01-09' ELSE '2024-01-05' END AS attempted FROM d")
def u11(spark, sf):
    return enriched_documents(spark, sf).select("uuid", F.to_date("description_fetch_attempted_at").cast("string").alias("attempted"))


@query("u12_full_text", _DETAILS + """SELECT uuid, CASE WHEN lang = 'en' THEN concat(text, CASE WHEN contains(text, 'and') THEN ' The position is 80 % of full time, a good position.' ELSE '' END) ELSE 'summary' END AS description,
CASE WHEN lang = 'en' AND contains(text, 'and') THEN 80 ELSE 50 END AS extent_percent FROM d""")
def u12(spark, sf):
    return enriched_documents(spark, sf).select("uuid", "description", "extent_percent")


@query("s15_add_column", """SELECT concat('c', cast(c_custkey AS string)) AS uuid, 'new' AS user_status, 0 AS excluded, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS manually_added FROM customer""")
def s15(spark, sf):
    old = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("uuid"), F.col("c_mktsegment").alias("sector"))
    marked = add_marker(old, "manually_added", F.col("sector") == "BUILDING")
    again = add_marker(marked, "manually_added", F.lit(True))
    return align(again).select("uuid", "user_status", flag("excluded").alias("excluded"), flag("manually_added").alias("manually_added"))
