"""S, ST, H and X: landed feeds, streams, run summaries and health, all from the given tables.

Feed files are written by Spark from a table into the shared scratch folder and read back by the source readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import health, merge
from ...operators.actions import apply_actions
from ...operators.listing import ListingQuery, matching, score_column
from ...schema import DEFAULTS, RUN
from ...session import scratch_dir
from ...sources import digest as D
from ...sources import feeds as S
from ...sources.components import component_text
from ...sources.registry import SourceSpec, read_all
from ...sources.runs import previous_watermark
from ...sources.versions import BucketedTable, VersionedTable
from ...streaming import ingest, state
from .base import AS_OF_EVENTS, ORDERS, decoded_sql, flag, order_listings, query, table, ts
from .joins import nation_places
from .predicates import order_jobs


# ---- change feed -------------------------------------------------------------------------------------------

def land_changelog(spark, sf, files: int = 10, path: str | None = None, when: str = "true") -> str:
    """Events as pages of a change feed: one page per event hour, every event an entry of its user."""
    path = path or scratch_dir(spark, "changelog")
    e = table(spark, sf, "events").where(when)
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    entry = F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("uuid"),
                     F.when(F.col("event_type") == "error", "INACTIVE").otherwise("ACTIVE").alias("status"),
                     F.col("event_type").alias("title"), F.lit("b").alias("businessName"), F.lit("m").alias("municipal"),
                     F.col("props").alias("sistEndret"))
    item = F.struct(F.col("ts"), F.col("event_id"), F.struct(entry.alias("_feed_entry")).alias("item"))
    pages = e.select(hour.alias("seq"), item.alias("i")).groupBy("seq").agg(F.sort_array(F.collect_list("i")).alias("i"))
    pages.select(F.concat(F.lit("page-"), F.col("seq")).alias("id"), "seq", F.concat(F.lit("page-"), F.col("seq") + 1).alias("next_id"),
                 F.col("i.item").alias("items")).repartition(files, "seq").write.mode("append").json(path)
    return path


_LAST = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT concat('u', cast(user_id AS string)) AS uuid, CASE WHEN event_type = 'error' THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, event_type AS title, props AS stamp FROM r WHERE rn = 1"""


@query("s1_changelog_batch", _LAST)
def s1(spark, sf):
    entries = S.changelog_entries(S.read_changelog(spark, land_changelog(spark, sf)))
    return S.latest_entries(entries).select("uuid", "status", "title", "stamp")


_SLICES = [f"ts {a} AND ts {b}" for a, b in (
    ("< TIMESTAMP '2024-01-10 00:00:00'", "IS NOT NULL"), (">= TIMESTAMP '2024-01-10 00:00:00'", "< TIMESTAMP '2024-01-20 00:00:00'"),
    (">= TIMESTAMP '2024-01-20 00:00:00'", "IS NOT NULL"))]


@query("s1_feed_listings", """SELECT concat('e', cast(event_id AS string)) AS uuid, CASE WHEN event_type = 'error' THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
CASE WHEN event_id % 3 = 0 THEN event_type ELSE concat('ad ', event_type) END AS title, CASE WHEN event_id % 3 > 0 THEN props END AS description,
CASE WHEN event_id % 3 > 0 THEN 'm' || cast(user_id % 7 AS string) ELSE 'm' END AS municipal FROM events""")
def s1_feed(spark, sf):
    """Entries of the feed and their ads land apart: ads of every third event with their entry, of another third a slice later, of the last third never."""
    root = scratch_dir(spark, "feed")
    out = BucketedTable(spark, f"{root}/table", buckets=8)
    uuid, at = F.concat(F.lit("e"), F.col("event_id")).alias("uuid"), F.col("ts").cast("timestamp")

    def land(e: DataFrame, ads: DataFrame) -> None:
        e.select(uuid, F.floor(F.unix_seconds(at) / 3600).alias("seq"), F.col("event_id").alias("idx"), at.alias("ts"),
                 F.when(F.col("event_type") == "error", "INACTIVE").otherwise("ACTIVE").alias("status"), F.col("event_type").alias("title"),
                 F.lit("b").alias("business_name"), F.lit("m").alias("municipal")).write.mode("append").parquet(f"{root}/entries")
        ad = F.struct(F.concat(F.lit("ad "), F.col("event_type")).alias("title"), F.col("props").alias("description"), F.array(
            F.struct(F.concat(F.lit("m"), F.col("user_id") % 7).alias("municipal"))).alias("workLocations"))
        ads.select(uuid, ad.alias("ad_content"), (at + F.expr("INTERVAL 20 MINUTES")).alias("ts")).write.mode("append").json(f"{root}/ads")

    events = table(spark, sf, "events")
    late = events.where("event_id % 3 = 1")
    ends = events.limit(1).withColumn("event_id", F.lit(-2).cast("long"))  # a last entry and a last ad, far ahead, close the wait of all others
    steps = [(events.where(w), events.where(w).where("event_id % 3 = 2").unionByName(late.where(before))) for before, w in zip(["false", *_SLICES], _SLICES)]
    for day in ("2030-01-01", "2031-01-01"):
        end = ends.withColumn("ts", F.lit(day).cast(events.schema["ts"].dataType))
        steps.append((end, end.unionByName(late.where(_SLICES[-1])) if day == "2030-01-01" else end))
    for e, ads in steps:
        land(e, ads)
        entries = spark.readStream.schema(spark.read.parquet(f"{root}/entries").schema).parquet(f"{root}/entries")
        ingest.run_feed(entries, S.stream_ads(spark, f"{root}/ads"), f"{root}/checkpoint", out, wait="1 hour", delay="40 days")
    return out.read().where(~F.col("uuid").startswith("e-")).select("uuid", "status", "title", "description", "municipal")


@query("st1_changelog_stream", _LAST)
def st1(spark, sf):
    landing, root = land_changelog(spark, sf), scratch_dir(spark, "stream")
    out = BucketedTable(spark, f"{root}/table", buckets=8)
    for _ in range(2):  # the second run with the same checkpoint finds nothing to read
        ingest.run_changelog(spark, landing, f"{root}/checkpoint", out, files_per_trigger=4)
    return out.read().select("uuid", "status", "title", "stamp")


@query("st2_skip_unchanged_stamp", """SELECT count(*) AS n FROM events WHERE NOT (event_type = 'view')""")
def st2(spark, sf):
    entries = S.changelog_entries(S.read_changelog(spark, land_changelog(spark, sf)))
    done = entries.where(F.col("title") == "view").select("uuid", F.concat("stamp", F.lit("#view")).alias("stamp"))
    marked = entries.withColumn("stamp", F.concat("stamp", F.lit("#"), "title"))
    return S.unread(marked, done.distinct()).agg(F.count(F.lit(1)).alias("n"))


@query("st2_changed_stream", """WITH r AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT concat('u', cast(user_id AS string)) AS uuid, event_type AS stamp, count(*) AS n FROM r WHERE event_type IS DISTINCT FROM before GROUP BY ALL""")
def st2_stream(spark, sf):
    """The feed lands in three slices; the query is stopped and started again after each."""
    root = scratch_dir(spark, "changed")
    for when in _SLICES:
        land_changelog(spark, sf, files=32, path=f"{root}/landing", when=when)
        entries = S.changelog_entries(S.stream_changelog(spark, f"{root}/landing")).where(~F.col("malformed")).withColumn("stamp", F.col("title"))
        state.run_changed(state.placed_in_time(entries), f"{root}/checkpoint", f"{root}/out", expire_days=3650)
    return spark.read.parquet(f"{root}/out").groupBy("uuid", "stamp").agg(F.count(F.lit(1)).alias("n"))


@query("a17_attempt_stream", """WITH ok AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY user_id),
f AS (SELECT e.user_id, count(*) FILTER (WHERE event_type = 'error' AND (t IS NULL OR ts > t)) AS failures FROM events e LEFT JOIN ok ON e.user_id = ok.user_id
WHERE event_type IN ('purchase', 'error') GROUP BY e.user_id)
SELECT concat('u', cast(user_id AS string)) AS uuid, failures, CASE WHEN failures >= 3 THEN 1 ELSE 0 END AS give_up FROM f""")
def a17_stream(spark, sf):
    root = scratch_dir(spark, "attempts")
    kind = F.col("event_type")
    log = table(spark, sf, "events").where(kind.isin("purchase", "error"))
    out = BucketedTable(spark, f"{root}/table", buckets=8)
    for when in _SLICES:
        log.where(when).select(F.concat(F.lit("u"), F.col("user_id")).alias("uuid"), F.col("ts").cast("timestamp").alias("ts"),
                               F.when(kind == "purchase", "ok").otherwise("failed").alias("outcome")).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema("uuid string, ts timestamp, outcome string").parquet(f"{root}/landing")
        state.run_attempts(stream, f"{root}/checkpoint", out, expire_days=3650)
    return out.read().select("uuid", "failures", F.col("give_up").cast("int").alias("give_up"))


@query("st3_start_at_tip", _LAST.replace("FROM events)", "FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00')").replace(", event_type AS title, props AS stamp", ""))
def st3(spark, sf):
    root = scratch_dir(spark, "tip")
    landing, out = f"{root}/landing", VersionedTable(spark, f"{root}/table")
    for when in ("ts < TIMESTAMP '2024-01-15 00:00:00'", "ts >= TIMESTAMP '2024-01-15 00:00:00'"):  # the first run only notes where the feed stands
        land_changelog(spark, sf, path=landing, when=when)
        ingest.run_changelog(spark, landing, f"{root}/checkpoint", out, files_per_trigger=4, from_tip=True)
    return out.read().select("uuid", "status")


@query("st4_new_since_watermark", """WITH w AS (SELECT max(ts) - INTERVAL 1 DAY AS m FROM events WHERE event_type = 'error') SELECT event_id FROM events, w WHERE ts > m""")
def st4(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    runs = e.where(F.col("event_type") == "error").select((F.col("at") - F.expr("INTERVAL 1 DAY")).alias("watermark"))
    return e.where(F.col("at") > previous_watermark(runs).scalar()).select("event_id")


@query("st5_lookback_window", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY")
def st5(spark, sf):
    mails = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("mail_date"))
    return S.within_lookback(mails, ts(AS_OF_EVENTS), 7, 60).select("event_id")


# Orders as a stream of listing rows: the stored half is merged with all of them, urgent ones are retired.
@query("st6_retired_never_return", ORDERS + """SELECT uuid, CASE WHEN status = 'INACTIVE' THEN 'old' ELSE 'fresh' END AS title FROM l WHERE sector <> '1-URGENT' OR status = 'INACTIVE'""")
def st6(spark, sf):
    root = scratch_dir(spark, "retired")
    o = order_listings(spark, sf).select("uuid", "status", "user_status", "sector")
    out = BucketedTable(spark, f"{root}/table", buckets=8)
    out.write(o.where(F.col("status") == "INACTIVE").select("uuid", F.lit("old").alias("title"), "user_status"))
    stones = o.where(F.col("sector") == "1-URGENT").select("uuid")
    fresh = o.where(F.col("status") != "INACTIVE").select("uuid", F.lit("fresh").alias("title"), "user_status")
    fresh.repartition(6, "uuid").write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(fresh.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/landing")
    for n in (1, 2):  # the whole feed is sent twice
        ingest.run_source(spark, stream, f"{root}/checkpoint{n}", out, merge.PARTIAL, stones)
    return out.read().select("uuid", "title")


@query("st7_action_stream", """WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, event_type FROM events WHERE event_type IN ('click', 'purchase')),
n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, props FROM events WHERE event_type = 'signup'), u AS (SELECT DISTINCT user_id FROM events)
SELECT concat('u', cast(u.user_id AS string)) AS uuid, CASE event_type WHEN 'click' THEN 'interesting' WHEN 'purchase' THEN 'applied' ELSE 'new' END AS user_status, props AS notes,
CASE WHEN EXISTS (SELECT 1 FROM events v WHERE v.user_id = u.user_id AND v.event_type = 'view') THEN 1 ELSE 0 END AS flagged
FROM u LEFT JOIN a ON u.user_id = a.user_id AND a.rn = 1 LEFT JOIN n ON u.user_id = n.user_id AND n.rn = 1""")
def st7(spark, sf):
    root = scratch_dir(spark, "actions")
    e = table(spark, sf, "events")
    uuid, kind = F.concat(F.lit("u"), F.col("user_id")).alias("uuid"), F.col("event_type")
    acts = e.select(
        uuid, F.when(kind == "signup", "note").when(kind == "view", "flag").when(kind == "error", "profile").otherwise("status").alias("field"),
        F.when(kind == "click", "interesting").when(kind == "purchase", "applied").when(kind == "view", "1").otherwise(F.col("props")).alias("value"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    acts.repartition(4, "seq").write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(acts.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
    log = BucketedTable(spark, f"{root}/log", buckets=8)
    ingest.run_actions(spark, stream, f"{root}/checkpoint", log)
    none = F.lit(None)
    stored = e.select(uuid).distinct().select(
        "uuid", F.lit("new").alias("user_status"), none.cast("timestamp").alias("applied_at"),
        none.cast("timestamp").alias("flagged_at"), none.cast("string").alias("notes"))
    return apply_actions(stored, log.read()).select("uuid", "user_status", "notes", flag(F.col("flagged_at").isNotNull()).alias("flagged"))


@query("st8_isolated_sources", """SELECT 'orders' AS source, count(*) AS n, 0 AS failed FROM orders UNION ALL SELECT 'broken', 0, 1 UNION ALL SELECT 'customers', count(*), 0 FROM customer""")
def st8(spark, sf):
    specs = [
        SourceSpec("orders", lambda s: order_listings(s, sf)),
        SourceSpec("broken", lambda s: table(s, sf, "no_such_table")),
        SourceSpec("customers", lambda s: table(s, sf, "customer")),
    ]
    parts = []
    for r in read_all(spark, specs):
        n = r.rows.agg(F.count(F.lit(1)).alias("n")) if r.rows is not None else table(spark, sf, "region").agg(F.lit(0).cast("bigint").alias("n"))
        parts.append(n.select(F.lit(r.spec.name).alias("source"), "n", F.lit(int(r.error is not None)).alias("failed")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- snapshot pages ----------------------------------------------------------------------------------------

@query("s2_snapshot_pages", """WITH p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT cast(max(o_custkey) AS int) AS n_pages, cast(sum(n) AS bigint) AS n_jobs, CASE WHEN arg_max(n, o_custkey) < 100 AND min(o_custkey) = 1 AND count(*) = max(o_custkey) THEN 1 ELSE 0 END AS complete FROM p""")
def s2(spark, sf):
    path = scratch_dir(spark, "snapshot")
    order_jobs(spark, sf).write.json(path)
    return S.snapshot_completeness(S.read_snapshot(spark, path)).select("n_pages", "n_jobs", flag("complete").alias("complete"))


@query("s2_snapshot_listings", """SELECT concat('shop-', cast(o_orderkey AS string)) AS uuid, o_orderpriority AS title, cast(cast(o_orderdate AS date) AS string) AS due, 'Full time' AS extent FROM orders WHERE o_orderstatus <> 'P'""")
def s2b(spark, sf):
    path = scratch_dir(spark, "snapshot")
    order_jobs(spark, sf).write.json(path)
    rows = S.snapshot_listings(S.snapshot_jobs(S.read_snapshot(spark, path)), "shop")
    return rows.select("uuid", "title", F.col("application_due_sort").cast("string").alias("due"), "extent")


# ---- mail digests ------------------------------------------------------------------------------------------

RULE = "-" * 24
TAIL = D.DigestFormat("tail", "More details:", r"(https://board\.example\.com/\d+)", "tail")
FRONT = D.DigestFormat("front", "View listing:", r"https://net\.example\.com/view/(\d+)", "front", noise=(r"^Your alert", r"^\d+ new listings"))


def digest_mails(spark, sf, fmt: D.DigestFormat) -> DataFrame:
    """One mail per customer with a card per order; some cards have no place, a stray comma or no readable link."""
    o = table(spark, sf, "orders")
    i, key = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    nl = F.lit("\n")
    if fmt.layout == "tail":
        who = F.when(i == 1, F.lit("Shop")).otherwise(F.concat(F.lit("Shop, Inc, NATION_"), F.col("o_custkey") % 25))
        head = F.when(i == 2, F.lit(",\n")).otherwise("")
        card = F.concat(F.lit("Hello reader"), nl, F.lit(",Title "), key, nl, head, who)
        card = F.when(i == 2, F.concat(F.lit("Hello"), nl, F.lit("Title "), key, nl, F.lit(","), nl, who)).otherwise(
            F.concat(F.lit("Hello reader"), nl, F.lit(",Title "), key, nl, who))
        link = F.when(i == 3, F.lit("More details: broken")).otherwise(F.concat(F.lit("More details: https://board.example.com/"), key))
    else:
        card = F.concat(F.lit("Your alert"), nl, F.lit("7 new listings"), nl, F.lit("Title "), key,
                        F.when(i == 1, F.lit(" - Shop - due soon")).otherwise(""), nl, F.lit("Shop"), nl,
                        F.lit("NATION_"), F.col("o_custkey") % 25, F.lit(", Worldland"), nl, F.lit("actively hiring"))
        link = F.when(i == 3, F.lit("View listing: gone")).otherwise(F.concat(F.lit("View listing: https://net.example.com/view/"), key))
    block = F.struct(F.col("o_orderkey"), F.concat(card, nl, link, nl).alias("b"))
    return o.select(F.col("o_custkey"), block.alias("b")).groupBy("o_custkey").agg(
        F.array_join(F.sort_array(F.collect_list("b")).getField("b"), RULE + "\n").alias("text"),
    ).select(F.col("o_custkey").cast("string").alias("message"), "text")


@query("s3_digest_tail", """SELECT concat('b-', cast(o_orderkey AS string)) AS uuid, concat('Title ', cast(o_orderkey AS string)) AS title, CASE WHEN o_orderkey % 5 = 1 THEN 'Shop' ELSE 'Shop, Inc' END AS business_name,
CASE WHEN o_orderkey % 5 <> 1 THEN concat('NATION_', cast(o_custkey % 25 AS string)) END AS municipal, CASE WHEN o_orderkey % 5 <> 1 THEN r_name END AS county
FROM orders JOIN nation ON n_nationkey = o_custkey % 25 JOIN region ON r_regionkey = n_regionkey WHERE o_orderkey % 5 <> 3""")
def s3(spark, sf):
    rows = D.digest_listings(D.cards(digest_mails(spark, sf, TAIL), TAIL), "b", nation_places(spark, sf))
    return rows.select("uuid", "title", "business_name", "municipal", "county")


@query("s4_digest_front", """SELECT concat('n-', cast(o_orderkey AS string)) AS uuid, concat('Title ', cast(o_orderkey AS string)) AS title, 'Shop' AS business_name,
concat('NATION_', cast(o_custkey % 25 AS string)) AS municipal, r_name AS county, concat('https://net.example.com/view/', cast(o_orderkey AS string)) AS link
FROM orders JOIN nation ON n_nationkey = o_custkey % 25 JOIN region ON r_regionkey = n_regionkey WHERE o_orderkey % 5 <> 3""")
def s4(spark, sf):
    found = D.cards(digest_mails(spark, sf, FRONT), FRONT)
    rows = D.digest_listings(found, "n", nation_places(spark, sf), country="Worldland", region_words=(r"\s+region$",), link_base="https://net.example.com/view/")
    return rows.select("uuid", "title", "business_name", "municipal", "county", "link")


@query("a13_parse_report", """SELECT count(DISTINCT o_custkey) AS messages, count(*) AS cards, count(*) FILTER (WHERE o_orderkey % 5 <> 3) AS parsed,
concat(cast(count(*) FILTER (WHERE o_orderkey % 5 = 3) AS string), ' of ', cast(count(*) AS string), ' card(s) could not be parsed') AS warning FROM orders""")
def a13(spark, sf):
    return D.parse_warning(D.parse_report(digest_mails(spark, sf, TAIL), TAIL))


# ---- pages, lists, registers, trees ------------------------------------------------------------------------

@query("s5_html_fields", r"""WITH f AS (SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS language, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
trim(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ' ') AS description FROM pages
WHERE regexp_matches(html, '<title>[^<]*</title>') AND regexp_matches(html, '(?s)<article>.*?</article>')), """ + decoded_sql("t", "f", "page_id", "title") + """
SELECT f.page_id, language, trim(t.title, ' ') AS title, description FROM f JOIN t ON f.page_id = t.page_id""")
def s5(spark, sf):
    patterns = {"language": r'<html lang="([a-z]+)"', "title": r"<title>([^<]*)</title>", "description": r"(?s)<article>(.*?)</article>"}
    return S.html_listings(table(spark, sf, "pages").select("page_id", "html"), patterns)


@query("s6_xml_list", "SELECT cast(s_suppkey AS string) AS listing_id, concat('d', cast(s_nationkey AS string)) AS department_id FROM supplier WHERE s_nationkey % 4 <> 3")
def s6(spark, sf):
    path = scratch_dir(spark, "xml")
    i = F.col("s_nationkey") % 4
    department = F.struct(F.concat(F.lit("d"), F.col("s_nationkey")).alias("_id"))
    deps = F.when(i != 3, F.array(department, F.struct(F.lit("other").alias("_id"))))
    table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("_id"), F.struct(deps.alias("Department")).alias("Departments"),
    ).write.format("xml").option("rootTag", "List xmlns=\"urn:demo\"").option("rowTag", "Vacancy").save(path)
    return S.read_listing_ids(spark, path)


@query("s7_postal_register", """WITH r AS (SELECT concat('PLÄCE ', cast(c_custkey % 50 AS string)) AS place, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey DESC) AS rn FROM customer)
SELECT place, concat('NATION_', cast(c_nationkey AS string)) AS municipality FROM r WHERE rn = 1""")
def s7(spark, sf):
    path = scratch_dir(spark, "postal")
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("code"), F.concat(F.lit("Pläce "), F.col("c_custkey") % 50).alias("place"),
        F.col("c_nationkey").cast("string").alias("municipality_code"), F.concat(F.lit(" Nation_"), F.col("c_nationkey"), F.lit(" ")).alias("municipality"), "c_custkey")
    # The register is one ordered file at its source.
    c.coalesce(1).sortWithinPartitions("c_custkey").drop("c_custkey").write.option("sep", "\t").option("encoding", "iso-8859-1").csv(path)
    return S.read_postal(spark, path)


@query("s9_component_text", """SELECT doc_id, trim(regexp_replace(concat(replace(text, chr(10), ' '), ' deep ', ' and a sentence that is long enough to be prose'), '[ ]+', ' ', 'g')) AS text FROM documents""")
def s9(spark, sf):
    t = F.replace("text", F.lit("\n"), F.lit(" "))
    tree = F.to_json(F.struct(
        F.struct(F.concat(F.lit("<b>"), t, F.lit("</b>")).alias("html"), F.lit("https://cdn.example.com/a/very/long/address/of/an/image.png").alias("imageUrl")).alias("head"),
        F.array(F.struct(F.lit("short").alias("kind"), F.struct(F.struct(F.struct(F.struct(F.lit("<i>deep</i>").alias("t")).alias("e")).alias("d")).alias("c")).alias("b"))).alias("parts"),
        F.lit("and a sentence that is long enough to be prose").alias("note")))
    return table(spark, sf, "documents").select("doc_id", component_text(tree).alias("text"))


@query("s10_manual_adds", r"""SELECT CASE WHEN regexp_matches(url, '/[a-z]{2}/(\d+)') THEN concat('web-', regexp_extract(url, '/[a-z]{2}/(\d+)', 1)) ELSE concat('manual-', left(sha256(concat_ws(chr(1), url, 'Page', cast(page_id AS string))), 12)) END AS uuid,
CASE WHEN regexp_matches(url, '/[a-z]{2}/(\d+)') THEN 'web' ELSE 'manual' END AS source, url AS link, 'Page' AS title FROM pages""")
def s10(spark, sf):
    none = F.lit(None).cast("string")
    adds = table(spark, sf, "pages").select(F.concat(F.lit(" "), F.col("url")).alias("link"), F.lit("Page").alias("title"), F.col("page_id").cast("string").alias("business_name"),
                                            none.alias("municipal"), none.alias("county"), F.lit("").alias("description"), none.alias("application_due"))
    return S.manual_listings(adds, r"/[a-z]{2}/(\d+)", "web").select("uuid", "source", "link", "title")


# ---- versions, runs, health --------------------------------------------------------------------------------

@query("s12_atomic_write", ORDERS + "SELECT uuid, score FROM l")
def s12(spark, sf):
    t = VersionedTable(spark, scratch_dir(spark, "atomic"))
    rows = order_listings(spark, sf).select("uuid", "score")
    t.write(rows.withColumn("score", F.lit(0)))
    t.write(rows)
    spark.range(1).write.mode("overwrite").parquet(t.directory(3))
    t._fs.delete(t._path(t.directory(3) + "/_SUCCESS"), False)  # a write that never committed
    return t.read()


@query("s14_version_retention", "SELECT count(*) AS n, 3 AS first_version, 12 AS last_version, 10 AS versions FROM region")
def s14(spark, sf):
    t = VersionedTable(spark, scratch_dir(spark, "versions"))
    for _ in range(12):
        t.write(table(spark, sf, "region"))
    kept = t.versions()
    return t.read().agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(kept[0]).alias("first_version"), F.lit(kept[-1]).alias("last_version"), F.lit(len(kept)).alias("versions"))


def event_runs(spark, sf) -> DataFrame:
    """Events as the runs table: one run per day, one row per event type, counts as statistics."""
    e = table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint")
    big = F.count_if(F.col("value") > 20)
    per = e.groupBy(day.alias("run_id"), F.col("event_type").alias("source")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("watermark"), F.count(F.lit(1)).alias("n"), big.alias("big"))
    stats = F.create_map(F.lit("fetched"), F.col("n"), F.lit("marked_inactive"), F.col("big"),
                         F.lit("messages"), F.when(F.col("source") == "view", 0).otherwise(F.col("n")).cast("bigint"), F.lit("detail_errors"), F.col("big"))
    rows = per.select("run_id", "watermark", "source", stats.alias("stats"),
                      F.when(F.col("source") == "click", "half parsed").alias("warning"), F.when(F.col("source") == "error", "timeout").alias("error"))
    own = per.groupBy("run_id").agg(F.max("watermark").alias("watermark")).select(
        "run_id", "watermark", F.array(F.struct(F.lit("rescore").alias("stage"), F.lit("boom").alias("error"))).alias("stage_errors"))
    return rows.unionByName(own, allowMissingColumns=True).select(*RUN.fieldNames())


_RUNS = """WITH p AS (SELECT date_diff('day', DATE '2024-01-01', cast(ts AS date)) AS run_id, event_type AS source, max(ts) AS watermark, count(*) AS n, count(*) FILTER (WHERE value > 20) AS big FROM events GROUP BY 1, 2) """


@query("s13_run_summary", _RUNS + "SELECT run_id, source, n AS fetched, big AS marked_inactive, epoch_us(watermark) AS watermark_us FROM p")
def s13(spark, sf):
    return event_runs(spark, sf).where(F.col("source").isNotNull()).select(
        "run_id", "source", F.col("stats")["fetched"].alias("fetched"), F.col("stats")["marked_inactive"].alias("marked_inactive"),
        F.unix_micros("watermark").alias("watermark_us"))


@query("a12_deactivation_share", _RUNS + """SELECT run_id, source, n AS fetched, big AS closed, cast(big AS double) / (n + big) AS share, CASE WHEN cast(big AS double) / (n + big) > 0.3 THEN 'warn' ELSE 'ok' END AS level FROM p""")
def a12(spark, sf):
    return health.deactivation_share(event_runs(spark, sf))


HEALTH = health.HealthConfig(order=("click", "error", "purchase", "signup", "view"),
                             freshness={"click": (0.001, 30.0), "purchase": (0.0, 0.001), "view": (0.0, 0.0), "error": (0.0, 0.0)},
                             data_loss=("click", "view"), changelog="signup", snapshot="purchase")


def _issues(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("first_seen_at"))
    return health.evaluate(event_runs(spark, sf), rows, ts(AS_OF_EVENTS), HEALTH)


# The rules in SQL over the newest run; each rule is also its own query.
_HEALTH = _RUNS + """, c AS (SELECT * FROM p WHERE run_id = (SELECT max(run_id) FROM p)), w AS (SELECT max(watermark) AS m FROM c),
a AS (SELECT event_type AS source, (epoch_us(any_value(m)) - epoch_us(max(ts))) / 86400000000.0 AS age FROM events, w GROUP BY event_type),
issues AS (SELECT 'run' AS source, 'warn' AS level, 'H1' AS rule, cast(cast(round((epoch_us(TIMESTAMP '""" + AS_OF_EVENTS + """') - epoch_us(m)) / 86400000000.0) AS int) AS string) AS detail FROM w WHERE (epoch_us(TIMESTAMP '""" + AS_OF_EVENTS + """') - epoch_us(m)) / 86400000000.0 >= 3
UNION ALL SELECT 'run', 'bad', 'H2', 'rescore: boom' UNION ALL SELECT source, 'bad', 'H3', 'timeout' FROM c WHERE source = 'error'
UNION ALL SELECT source, 'bad', 'H4', 'half parsed' FROM c WHERE source = 'click'
UNION ALL SELECT source, 'warn', 'H5', concat('held ', cast(big AS string)) FROM c WHERE source = 'signup' AND big > 0
UNION ALL SELECT source, 'warn', 'H6', concat(cast(big AS string), '/', cast(n + big AS string)) FROM c WHERE source = 'purchase' AND cast(big AS double) / (n + big) > 0.3
UNION ALL SELECT source, 'bad', 'H7', 'no messages' FROM c WHERE source = 'view'
UNION ALL SELECT c.source, CASE WHEN age >= CASE c.source WHEN 'click' THEN 30 ELSE 0.001 END THEN 'bad' ELSE 'warn' END, 'H8', cast(cast(round(age) AS int) AS string)
FROM c JOIN a USING (source) WHERE c.source IN ('click', 'purchase') AND age >= CASE c.source WHEN 'click' THEN 0.001 ELSE 0 END) """


@query("o6_health_issues", _HEALTH + "SELECT source, level, rule, detail FROM issues")
def o6(spark, sf):
    return _issues(spark, sf)


_HEALTH_RULES = ("H2", "H3", "H4", "H7", "H8")


def _rule(rule: str):
    @query(f"{rule.lower()}_health_rule", _HEALTH + f"SELECT source, level, detail FROM issues WHERE rule = '{rule}'")
    def run(spark, sf):
        return _issues(spark, sf).where(F.col("rule") == rule).select("source", "level", "detail")
    return run


for _r in _HEALTH_RULES:
    _rule(_r)


# Rules that need another state of the runs: a stale run, a held feed, a mass deactivation.
@query("h1_stale_run", """WITH w AS (SELECT max(ts) AS m FROM events) SELECT 'warn' AS level, cast(cast(round((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(m)) / 86400000000.0) AS int) AS string) AS detail FROM w""")
def h1(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("first_seen_at"))
    out = health.evaluate(event_runs(spark, sf), rows, ts("2024-03-01 00:00:00"), HEALTH)
    return out.where(F.col("rule") == "H1").select("level", "detail")


def shifted_runs(spark, sf) -> DataFrame:
    """The runs again with more detail errors and closed rows than fetched ones."""
    more = F.map_concat(
        F.map_filter("stats", lambda k, v: ~k.isin("detail_errors", "marked_inactive")),
        F.create_map(F.lit("detail_errors"), F.col("stats")["fetched"], F.lit("marked_inactive"), F.col("stats")["fetched"]))
    return event_runs(spark, sf).withColumn("stats", F.when(F.col("source").isNotNull(), more))


@query("h5_held_feed", _RUNS + "SELECT source, 'warn' AS level, concat('held ', cast(n AS string)) AS detail FROM p WHERE run_id = (SELECT max(run_id) FROM p) AND source = 'signup'")
def h5(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("first_seen_at"))
    out = health.evaluate(shifted_runs(spark, sf), rows, ts(AS_OF_EVENTS), HEALTH)
    return out.where(F.col("rule") == "H5").select("source", "level", "detail")


@query("h6_mass_deactivation", _RUNS + "SELECT source, 'warn' AS level, concat(cast(n AS string), '/', cast(2 * n AS string)) AS detail FROM p WHERE run_id = (SELECT max(run_id) FROM p) AND source = 'purchase'")
def h6(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("first_seen_at"))
    out = health.evaluate(shifted_runs(spark, sf), rows, ts(AS_OF_EVENTS), HEALTH)
    return out.where(F.col("rule") == "H6").select("source", "level", "detail")


# ---- extension points --------------------------------------------------------------------------------------

@query("x1_sql_expressions", "SELECT o_orderkey, lower(o_orderpriority) AS low, upper(trim(o_orderpriority)) AS up FROM orders")
def x1(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("x1_orders")
    return spark.sql("SELECT o_orderkey, lower(o_orderpriority) AS low, upper(trim(o_orderpriority)) AS up FROM x1_orders")


@query("x2_profile_parameter", ORDERS + """SELECT 'floor' AS profile, count(*) AS n FROM l WHERE (status = 'ACTIVE' OR user_status NOT IN ('new', 'interesting')) AND NOT excluded AND flagged_at IS NULL AND user_status IN ('new', 'interesting') AND score >= 70
UNION ALL SELECT 'desk', count(*) FROM l WHERE (status = 'ACTIVE' OR user_status NOT IN ('new', 'interesting')) AND NOT excluded AND flagged_at IS NULL AND user_status IN ('new', 'interesting') AND score_it >= 70""")
def x2(spark, sf):
    rows = order_listings(spark, sf)
    parts = []
    for profile in ("floor", "desk"):
        score_column(profile)
        parts.append(matching(rows, ListingQuery(profile=profile, min_score=70)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(profile).alias("profile"), "n"))
    return parts[0].unionByName(parts[1])


@query("x3_source_registry", """SELECT concat('cust-', cast(c_custkey AS string)) AS uuid, 'customers' AS source, c_name AS title FROM customer
UNION ALL SELECT concat('sup-', cast(s_suppkey AS string)), 'suppliers', s_name FROM supplier""")
def x3(spark, sf):
    specs = [
        SourceSpec("customers", lambda s: table(s, sf, "customer").select(F.concat(F.lit("cust-"), F.col("c_custkey")).alias("uuid"), F.col("c_name").alias("title"))),
        SourceSpec("suppliers", lambda s: table(s, sf, "supplier").select(F.concat(F.lit("sup-"), F.col("s_suppkey")).alias("uuid"), F.col("s_name").alias("title"))),
    ]
    out = None
    for r in read_all(spark, specs):
        rows = r.rows.withColumn("source", F.lit(r.spec.name))
        if out is None:
            out = rows
        else:
            out = merge.merge(out, rows, r.spec.policy, defaults=DEFAULTS).drop("_outcome")
    return out.select("uuid", "source", "title")
