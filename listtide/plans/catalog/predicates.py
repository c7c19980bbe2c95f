"""P, O and the listing part of A and W over orders as listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import parse_int_param, safe_int, safe_url
from ...operators import lifecycle
from ...operators import listing as L
from ...operators.merge import rows_needing_text
from ...sources.feeds import changelog_entries, snapshot_jobs
from .base import AS_OF, AS_OF_EVENTS, DOCS, ORDERS, document_listings, flag, order_listings, query, table, ts

# The default visibility in SQL, once.
_BASE = "(status = 'ACTIVE' OR user_status NOT IN ('new', 'interesting')) AND NOT excluded AND flagged_at IS NULL"
_BACKLOG = "user_status IN ('new', 'interesting')"


def _filtered(name: str, where: str, **kw):
    """Keys matching one ListingQuery."""
    @query(name, ORDERS + f"SELECT uuid FROM l WHERE {where}")
    def run(spark, sf):
        return L.matching(order_listings(spark, sf), L.ListingQuery(**kw)).select("uuid")
    return run


_filtered("p1_active_or_acted", "(status = 'ACTIVE' OR user_status NOT IN ('new', 'interesting')) AND "
          "user_status IN ('new', 'applied', 'archived', 'interesting')",
          show_excluded=True, show_flagged=True, user_status=("new", "applied", "archived", "interesting"))
_filtered("p2_hide_excluded", f"NOT excluded AND {_BACKLOG}", active_only=False, show_flagged=True)
_filtered("p3_hide_flagged", f"flagged_at IS NULL AND {_BACKLOG}", active_only=False, show_excluded=True)
_filtered("p4_status_in", _BASE + " AND user_status = 'applied'", user_status="applied")
_filtered("p5_search_scope", _BASE + " AND user_status <> 'archived' AND (contains(replace(lower(title), ' ', ''), 'order12') OR "
          "contains(replace(lower(description), ' ', ''), 'order12') OR contains(replace(lower(business_name), ' ', ''), 'order12'))",
          search="Order 12")
_filtered("p6_open_backlog", _BASE + f" AND {_BACKLOG}")
_filtered("p7_language", _BASE + f" AND {_BACKLOG} AND language = 'de'", language="de")
_filtered("p8_source", _BASE + f" AND {_BACKLOG} AND source = 'src3'", source="src3")
_filtered("p10_min_score", _BASE + f" AND {_BACKLOG} AND score_it >= 60", min_score=60, profile="desk")
_filtered("p11_min_pay", _BASE + f" AND {_BACKLOG} AND salary_min >= 250000", min_salary=250_000)
_filtered("p12_min_extent", _BASE + f" AND {_BACKLOG} AND extent_percent >= 80", min_extent_percent=80)
_filtered("p13_category_level1", _BASE + f" AND {_BACKLOG} AND level1 = 'IT'", occupation_category="IT")


@query("p9_search_text", DOCS + """SELECT uuid FROM l WHERE NOT excluded AND user_status <> 'archived' AND
(contains(replace(lower(title), ' ', ''), 'oftheand') OR contains(replace(lower(description), ' ', ''), 'oftheand'))""")
def p9(spark, sf):
    rows = document_listings(spark, sf).withColumn("flagged_at", F.lit(None).cast("timestamp")).withColumn(
        "business_name", F.lit(None).cast("string"))
    return L.matching(rows, L.ListingQuery(search="OF the And")).select("uuid")


@query("p14_list_projection", ORDERS + f"""SELECT uuid, title, business_name, source, user_status, published,
score_it AS score, salary_text, extent_percent, status FROM l WHERE {_BASE} AND {_BACKLOG}""")
def p14(spark, sf):
    q = L.ListingQuery(profile="desk")
    return L.matching(order_listings(spark, sf), q).select(*q.select()).select(
        "uuid", "title", "business_name", "source", "user_status", "published", "score", "salary_text",
        "extent_percent", "status")


def order_jobs(spark, sf):
    """Orders as pages of a full snapshot: one page per customer group, a job per order."""
    o = table(spark, sf, "orders")
    job = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("Client "), F.col("o_custkey")).alias("employer"), F.lit(None).cast("string").alias("location"),
        F.lit("summary").alias("summary"), F.lit("link").alias("link"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("deadline"), F.lit(None).cast("string").alias("jobDuration"),
        F.lit("Full time").alias("jobScope"), (F.col("o_orderstatus") == "P").alias("isInternal"))
    return o.select(F.col("o_custkey").cast("int").alias("page"), job.alias("job")).groupBy("page").agg(
        F.collect_list("job").alias("jobs"))


@query("p15_drop_internal", "SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderstatus <> 'P'")
def p15(spark, sf):
    return snapshot_jobs(order_jobs(spark, sf)).select("id", "title")


@query("p16_board_interesting", ORDERS + f"""SELECT uuid, CASE WHEN status = 'ACTIVE' AND coalesce(application_due_sort, DATE '9999-12-31')
>= DATE '{AS_OF[:10]}' THEN 1 ELSE 0 END AS shown FROM l WHERE user_status = 'interesting' AND NOT excluded""")
def p16(spark, sf):
    q = L.ListingQuery(active_only=False, show_flagged=True, user_status="interesting")
    return L.matching(order_listings(spark, sf), q).select(
        "uuid", flag(L.open_interesting(ts(AS_OF))).alias("shown"))


@query("p16_hidden_count", ORDERS + f""", r AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, published DESC, uuid) AS rank FROM l
WHERE NOT excluded AND user_status = 'interesting') SELECT count(*) FILTER (WHERE NOT (status = 'ACTIVE' AND coalesce(application_due_sort, DATE '9999-12-31') >= DATE '{AS_OF[:10]}')) AS hidden
FROM r WHERE rank <= 500""")
def p16_hidden(spark, sf):
    return L.hidden_interesting(L.board(order_listings(spark, sf)), ts(AS_OF))


@query("p17_malformed_entries", """SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS malformed, count(*) AS n
FROM events GROUP BY 1""")
def p17(spark, sf):
    e = table(spark, sf, "events")
    bad = F.col("event_type") == "error"
    entry = F.struct(
        F.when(~bad, F.concat(F.lit("u"), F.col("user_id"))).alias("uuid"), F.lit("ACTIVE").alias("status"),
        F.col("event_type").alias("title"), F.lit("b").alias("businessName"), F.lit("m").alias("municipal"),
        F.col("props").alias("sistEndret"))
    pages = e.select(F.lit("p").alias("id"), F.col("event_id").alias("seq"), F.array(F.struct(entry.alias("_feed_entry"))).alias("items"))
    return changelog_entries(pages).groupBy(flag("malformed").alias("malformed")).agg(F.count(F.lit(1)).alias("n"))


@query("p18_safe_int", """WITH v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN cast(p_partkey AS string)
WHEN 1 THEN concat(' ', cast(p_size AS string), ' ') WHEN 2 THEN p_name WHEN 3 THEN concat(cast(p_partkey AS string), '0000000000') ELSE concat('-', cast(p_size AS string)) END AS raw
FROM part) SELECT p_partkey, CASE WHEN regexp_matches(trim(raw), '^[0-9]{1,9}$') THEN try_cast(trim(raw) AS int) END AS n FROM v""")
def p18(spark, sf):
    raw = """CASE p_partkey % 5 WHEN 0 THEN cast(p_partkey AS string) WHEN 1 THEN concat(' ', cast(p_size AS string), ' ')
    WHEN 2 THEN p_name WHEN 3 THEN concat(cast(p_partkey AS string), '0000000000') ELSE concat('-', cast(p_size AS string)) END"""
    return table(spark, sf, "part").select("p_partkey", safe_int(F.expr(raw)).alias("n"))


@query("p19_needs_enrichment", f"""SELECT concat('doc-', cast(doc_id AS string)) AS uuid FROM documents WHERE source = 'src2' AND length(text) < 1200
AND (doc_id % 3 = 0 OR TIMESTAMP '{AS_OF_EVENTS}' - to_hours(cast(doc_id % 50 AS int)) < TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 24 HOUR)""")
def p19(spark, sf):
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("uuid"), "source", F.lit("ACTIVE").alias("status"),
        F.col("text").alias("description"),
        F.when(F.col("doc_id") % 3 != 0, ts(AS_OF_EVENTS) - F.make_dt_interval(hours=(F.col("doc_id") % 50).cast("int")))
        .alias("description_fetch_attempted_at"))
    return rows_needing_text(d, "src2", ts(AS_OF_EVENTS), max_chars=1200)


@query("p20_past_due", ORDERS + f"""SELECT uuid FROM l WHERE user_status = 'new' AND flagged_at IS NULL AND coalesce(notes, '') = ''
AND application_due_sort < DATE '{AS_OF[:10]}'""")
def p20(spark, sf):
    return lifecycle.removed(order_listings(spark, sf), lifecycle.past_due_untouched(ts(AS_OF))).select("uuid")


@query("p21_safe_url", r"""WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(replace(url, 'https:', 'java script:'), 'http:', 'javascript:')
WHEN 2 THEN concat(chr(9), upper(url)) ELSE replace(url, '//', '') END AS raw FROM pages),
c AS (SELECT page_id, regexp_replace(raw, '[\x00-\x20\x7F]', '', 'g') AS u FROM v)
SELECT page_id, CASE WHEN lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto') THEN u ELSE '#' END AS href FROM c""")
def p21(spark, sf):
    raw = """CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(replace(url, 'https:', 'java script:'), 'http:', 'javascript:')
    WHEN 2 THEN concat(chr(9), upper(url)) ELSE replace(url, '//', '') END"""
    return table(spark, sf, "pages").select("page_id", safe_url(F.expr(raw)).alias("href"))


# ---- ordered output ----------------------------------------------------------------------------------------

def in_place(page):
    """A page with the place of each row in it, as it came out."""
    return page.withColumn("place", F.monotonically_increasing_id() + 1)


@query("o1_list_page", ORDERS + f"""SELECT uuid, score, published, row_number() OVER (ORDER BY score DESC NULLS LAST, published DESC, uuid) - 50 AS place FROM l WHERE {_BASE} AND {_BACKLOG}
ORDER BY score DESC NULLS LAST, published DESC, uuid LIMIT 50 OFFSET 50""")
def o1(spark, sf):
    return in_place(L.list_page(order_listings(spark, sf), L.ListingQuery(), offset=50)).select("uuid", "score", "published", "place")


@query("o2_deadline_order", ORDERS + f"""SELECT uuid, cast(application_due_sort AS string) AS due, row_number() OVER (ORDER BY application_due_sort ASC NULLS LAST, uuid) AS place
FROM l WHERE {_BASE} AND {_BACKLOG} ORDER BY application_due_sort ASC NULLS LAST, uuid LIMIT 50""")
def o2(spark, sf):
    return in_place(L.list_page(order_listings(spark, sf), L.ListingQuery(sort="deadline"))).select(
        "uuid", F.col("application_due_sort").cast("string").alias("due"), "place")


@query("o3_limit_offset", ORDERS + f"""SELECT uuid FROM l WHERE {_BASE} AND {_BACKLOG} AND source = 'src1'
ORDER BY score DESC NULLS LAST, published DESC, uuid LIMIT 20 OFFSET 40""")
def o3(spark, sf):
    return L.list_page(order_listings(spark, sf), L.ListingQuery(source="src1"), limit=20, offset=40).select("uuid")


@query("o4_review_queue", ORDERS + """SELECT uuid, cast(cast(flagged_at AS date) AS string) AS flagged FROM l
WHERE status = 'ACTIVE' AND flagged_at IS NOT NULL""")
def o4(spark, sf):
    return L.review_queue(order_listings(spark, sf)).select("uuid", F.to_date("flagged_at").cast("string").alias("flagged"))


@query("o5_board", ORDERS + """, r AS (SELECT uuid, user_status, row_number() OVER (PARTITION BY user_status
ORDER BY score DESC NULLS LAST, published DESC, uuid) AS rank FROM l WHERE NOT excluded AND user_status NOT IN ('new', 'archived'))
SELECT uuid, user_status, cast(rank AS int) AS rank FROM r WHERE rank <= 500""")
def o5(spark, sf):
    return L.board(order_listings(spark, sf)).select("uuid", "user_status", "rank")


@query("o7_newest_of_source", ORDERS + "SELECT uuid FROM l WHERE source = 'src2' ORDER BY first_seen_at DESC, uuid DESC LIMIT 1")
def o7(spark, sf):
    return L.newest_of(order_listings(spark, sf), "src2")


@query("w7_clamped_page", ORDERS + f""", m AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, published DESC, uuid) AS rn,
count(*) OVER () AS total FROM l WHERE {_BASE} AND {_BACKLOG})
SELECT uuid, score FROM m WHERE rn > (greatest(1, cast(ceil(total / 50.0) AS bigint)) - 1) * 50""")
def w7(spark, sf):
    number = parse_int_param("99999999")
    return L.page(order_listings(spark, sf), L.ListingQuery(), number).select("uuid", "score")


# ---- counters over the same predicate ----------------------------------------------------------------------

@query("a1_count_matching", ORDERS + f"SELECT count(*) AS n FROM l WHERE {_BASE} AND {_BACKLOG} AND language = 'en'")
def a1(spark, sf):
    return L.count_matching(order_listings(spark, sf), L.ListingQuery(language="en"))


@query("a2_count_excluded", ORDERS + "SELECT count(*) AS n_excluded FROM l WHERE status = 'ACTIVE' AND excluded")
def a2(spark, sf):
    return L.counters(order_listings(spark, sf)).select("n_excluded")


@query("a3_count_flagged", ORDERS + "SELECT count(*) AS n_flagged FROM l WHERE status = 'ACTIVE' AND flagged_at IS NOT NULL")
def a3(spark, sf):
    return L.counters(order_listings(spark, sf)).select("n_flagged")


@query("a4_new_high_score", ORDERS + f"""SELECT count(*) AS n FROM l WHERE first_seen_at > TIMESTAMP '{AS_OF}' AND score >= 55
AND status = 'ACTIVE' AND NOT excluded AND flagged_at IS NULL AND {_BACKLOG}""")
def a4(spark, sf):
    return L.count_new_high_score(order_listings(spark, sf), ts(AS_OF), 55)


@query("a6_active_sources", ORDERS + "SELECT DISTINCT source FROM l WHERE status = 'ACTIVE'")
def a6(spark, sf):
    return L.active_sources(order_listings(spark, sf))


@query("s11_scorable_scan", ORDERS + """SELECT uuid, title, description, municipal, county, language, extent_percent, salary_text,
salary_min, business_name, source, user_status FROM l WHERE status = 'ACTIVE'""")
def s11(spark, sf):
    rows = order_listings(spark, sf)
    for c in ("extent", "description_borrowed_from", "engagement_type"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    return L.scorable(rows).drop("extent", "description_borrowed_from", "engagement_type", "occupation_categories")
