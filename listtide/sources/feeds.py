"""Readers over landed feed files; each yields listing columns (a subset of the unified row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import iso_or_null, iso_or_text, normalize_due_date
from ..functions.identity import place_key
from ..functions.text import extract, unescape
from ..operators.places import resolve_region
from ..operators.skew import first_by, last_by
from ..schema import CATEGORY

S = T.StringType()


def _struct(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, S) for n in names.split()])


# ---- change feed -------------------------------------------------------------------------------------------

ENTRY = _struct("uuid status title businessName municipal sistEndret")
CHANGELOG = T.StructType([
    T.StructField("id", S), T.StructField("seq", T.LongType()), T.StructField("next_id", S),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("_feed_entry", ENTRY)]))), T.StructField("_corrupt_record", S),
])


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGELOG).json(path)


def stream_changelog(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same pages as a stream; the checkpoint is the cursor."""
    return spark.readStream.schema(CHANGELOG).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _corrupt(pages: DataFrame) -> Column:
    return F.col("_corrupt_record").isNotNull() if "_corrupt_record" in pages.columns else F.lit(False)


def changelog_entries(pages: DataFrame) -> DataFrame:
    """One row per feed entry with its position (seq, idx); `malformed` marks entries without id or status. A page
    that cannot be parsed counts as one malformed entry without a position."""
    e = F.col("item")["_feed_entry"]
    each = pages.withColumn("_lost", _corrupt(pages)).select(
        F.col("id").alias("page_id"), F.col("seq"), "_lost", F.posexplode_outer("items").alias("idx", "item"))
    return each.where(F.col("idx").isNotNull() | F.col("_lost")).select(
        "page_id", "seq", "idx", e["uuid"].alias("uuid"), e["status"].alias("status"), e["title"].alias("title"),
        e["businessName"].alias("business_name"), e["municipal"].alias("municipal"), e["sistEndret"].alias("stamp"),
        (e.isNull() | e["uuid"].isNull() | e["status"].isNull()).alias("malformed"))


def latest_entries(entries: DataFrame) -> DataFrame:
    """The last state of each key in feed order."""
    cols = ["seq", "idx", "status", "title", "business_name", "municipal", "stamp"]
    return last_by(entries.where(~F.col("malformed")), ["uuid"], [F.col("seq"), F.col("idx")], cols)


def unread(entries: DataFrame, done: DataFrame) -> DataFrame:
    """Partial progress: entries whose change stamp is the one already stored are skipped."""
    return entries.join(done.select("uuid", "stamp"), ["uuid", "stamp"], "left_anti")


AD = T.StructType([
    *[T.StructField(n, S) for n in ("title description applicationUrl applicationDue link published expires updated "
                                    "engagementtype extent sector").split()],
    T.StructField("employer", _struct("name orgnr")),
    T.StructField("workLocations", T.ArrayType(_struct("municipal county"))),
    T.StructField("occupationCategories", CATEGORY),
])
AD_DETAIL = T.StructType([T.StructField("uuid", S), T.StructField("ad_content", AD)])


def ad_listings(details: DataFrame, *extra: str) -> DataFrame:
    """Landed ad details as listing columns (and the columns `extra`); a NULL ad means the ad is gone and yields no row."""
    ad, loc = F.col("ad_content"), F.try_element_at(F.col("ad_content")["workLocations"], F.lit(1))
    return details.where(ad.isNotNull()).select(
        "uuid", F.lit("ACTIVE").alias("status"), ad["title"].alias("title"),
        ad["employer"]["name"].alias("business_name"), loc["municipal"].alias("municipal"), loc["county"].alias("county"),
        ad["description"].alias("description"), ad["employer"]["name"].alias("employer_name"),
        ad["employer"]["orgnr"].alias("employer_orgnr"), ad["applicationUrl"].alias("application_url"),
        ad["applicationDue"].alias("application_due"), normalize_due_date(ad["applicationDue"]).alias("application_due_sort"),
        ad["link"].alias("link"), ad["published"].alias("published"), ad["expires"].alias("expires"),
        ad["updated"].alias("updated"), ad["engagementtype"].alias("engagement_type"), ad["extent"].alias("extent"),
        ad["sector"].alias("sector"), F.coalesce(ad["occupationCategories"], F.array().cast(CATEGORY)).alias("occupation_categories"),
        F.to_json(ad).alias("raw_json"), *extra)


def stream_ads(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Landed ad details (uuid, ad_content, ts) as a stream."""
    schema = T.StructType([*AD_DETAIL.fields, T.StructField("ts", T.TimestampType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


# ---- full snapshot -----------------------------------------------------------------------------------------

PAGE_SIZE = 100
JOB = T.StructType([T.StructField("id", T.LongType()), *_struct(
    "title employer location summary link deadline jobDuration jobScope").fields, T.StructField("isInternal", T.BooleanType())])
SNAPSHOT = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("jobs", T.ArrayType(JOB)),
                         T.StructField("_corrupt_record", S)])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path)


def snapshot_completeness(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row (n_pages, n_jobs, complete): complete when pages 1 to n are all there and readable, and the last one
    came back short, so paging ended by itself."""
    n = F.size(F.coalesce("jobs", F.array().cast(T.ArrayType(JOB))))
    whole = ~F.bool_or("lost") & (F.min("page") == 1) & (F.count_distinct("page") == F.max("page"))
    return pages.select("page", n.alias("n"), (_corrupt(pages) | F.col("page").isNull()).alias("lost")).agg(
        F.max("page").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_jobs"),
        F.coalesce(whole & (F.max_by("n", "page") < page_size), F.lit(False)).alias("complete"))


def snapshot_jobs(pages: DataFrame) -> DataFrame:
    """External postings of the snapshot; internal ones are dropped."""
    return pages.select(F.explode("jobs").alias("j")).select("j.*").where(~F.coalesce("isInternal", F.lit(False)))


def snapshot_listings(jobs: DataFrame, prefix: str, places: DataFrame | None = None) -> DataFrame:
    due = iso_or_text(F.col("deadline"))
    out = jobs.select(
        F.concat(F.lit(prefix + "-"), F.col("id")).alias("uuid"), F.lit("ACTIVE").alias("status"), "title",
        F.col("employer").alias("business_name"), F.col("employer").alias("employer_name"),
        F.coalesce("location", F.lit("")).alias("municipal"), F.col("summary").alias("description"),
        F.col("link").alias("application_url"), "link", due.alias("application_due"),
        normalize_due_date(due).alias("application_due_sort"), F.col("jobDuration").alias("engagement_type"),
        F.col("jobScope").alias("extent"))
    return resolve_region(out, places) if places is not None else out


# ---- listing pages and lists -------------------------------------------------------------------------------

def html_listings(pages: DataFrame, patterns: dict[str, str], html: str = "html", defaults: dict[str, str] | None = None) -> DataFrame:
    """Fields of a listing page by pattern (group 1), entities decoded except in the description; a page without
    title or description yields no row."""
    found = {n: extract(F.col(html), p) for n, p in patterns.items()}
    rows = pages.where(found["title"].isNotNull() & found["description"].isNotNull())
    cols = []
    for name, c in found.items():
        if name == "description":
            value = F.trim(c)
        elif name == "application_due":
            value = iso_or_null(c)
        else:
            value = F.trim(unescape(c))
        if defaults and name in defaults:
            value = F.coalesce(F.nullif(value, F.lit("")), F.lit(defaults[name]))
        cols.append(value.alias(name))
    keep = [c for c in pages.columns if c != html and c not in found]
    return rows.select(*keep, *cols)


LIST_ITEM = T.StructType([
    T.StructField("_id", S),
    T.StructField("Departments", T.StructType([
        T.StructField("Department", T.ArrayType(T.StructType([T.StructField("_id", S)])))])),
])


def read_listing_ids(spark: SparkSession, path: str, row_tag: str = "Vacancy") -> DataFrame:
    """XML list -> (listing_id, department_id of the first department); entries lacking either are skipped."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(LIST_ITEM).load(path)
    dep = F.try_element_at(F.col("Departments")["Department"], F.lit(1))["_id"]
    return rows.select(F.col("_id").alias("listing_id"), dep.alias("department_id")).where(
        (F.coalesce("listing_id", F.lit("")) != "") & (F.coalesce("department_id", F.lit("")) != ""))


# ---- place registers ---------------------------------------------------------------------------------------

REGION = T.StructType([T.StructField("name", S), T.StructField("municipality", T.ArrayType(_struct("name")))])


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGION).option("multiLine", "true").json(path)


# The one difference between ISO-8859-1 and Windows-1252: bytes 0x80-0x9F; undefined ones become U+FFFD.
_C1 = "".join(chr(i) for i in range(0x80, 0xA0))
_CP1252 = _C1.encode("latin-1").decode("cp1252", errors="replace")


def read_postal(spark: SparkSession, path: str) -> DataFrame:
    """Postal register (tab separated, Windows-1252) -> place, municipality; the last line of a place wins."""
    raw = spark.read.schema(_struct("code place municipality_code municipality")).option("sep", "\t").option(
        "encoding", "iso-8859-1").option("quote", "").csv(path)
    place, municipality = (place_key(F.translate(c, _C1, _CP1252)) for c in ("place", "municipality"))
    lines = raw.select(
        place.alias("place"), municipality.alias("municipality"),
        F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                 F.monotonically_increasing_id().alias("i")).alias("line"))
    return lines.where((F.col("place") != "") & (F.col("municipality") != "")).groupBy("place").agg(
        F.max_by("municipality", "line").alias("municipality"))


# ---- manual adds -------------------------------------------------------------------------------------------

def manual_listings(adds: DataFrame, link_pattern: str, link_source: str) -> DataFrame:
    """Entered listings: id and source from a recognised link, else an id derived from the content. Empty
    fields mean unknown; the marker `manually_added` is set."""
    link = F.trim(F.coalesce("link", F.lit("")))
    known = link.rlike(link_pattern)
    own = F.concat(F.lit("manual-"), F.left(F.sha2(F.concat_ws("\u0001", link, "title", "business_name", "municipal"), 256), F.lit(12)))

    def given(c: str) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return adds.select(
        F.when(known, F.concat(F.lit(link_source + "-"), F.regexp_extract(link, link_pattern, 1))).otherwise(own).alias("uuid"),
        F.when(known, F.lit(link_source)).otherwise("manual").alias("source"), F.lit("ACTIVE").alias("status"),
        F.trim("title").alias("title"), given("business_name").alias("business_name"),
        given("business_name").alias("employer_name"), given("municipal").alias("municipal"), given("county").alias("county"),
        given("description").alias("description"), F.nullif(link, F.lit("")).alias("application_url"),
        F.nullif(link, F.lit("")).alias("link"), given("application_due").alias("application_due"),
        normalize_due_date(F.trim("application_due")).alias("application_due_sort"), F.lit(True).alias("manually_added"))


def first_seen(rows: DataFrame, key: str = "uuid", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """First occurrence per key of a run, in feed order."""
    cols = [c for c in rows.columns if c != key]
    return first_by(rows, [key], [F.col(c) for c in order], cols)


def within_lookback(mails: DataFrame, as_of: Column, days: int, retention_days: int, column: str = "mail_date") -> DataFrame:
    """Mails of the lookback window; a window longer than the retention of retired keys is a configuration error."""
    if days > retention_days:
        raise ValueError(f"lookback of {days} days exceeds the retention of {retention_days} days")
    return mails.where(F.col(column) >= as_of - F.make_dt_interval(days=F.lit(days)))
