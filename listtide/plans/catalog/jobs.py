"""The whole job over two feeds made of the customers: actions and copies, language, run rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import merge
from ...operators.pack import DEMO_PACK
from ...schema import ACTION, TOMBSTONE
from ...sources.registry import SourceSpec, read_all
from ..refresh import Landed, RefreshResult, refresh
from .base import flag, query, table

NOW = dt.datetime(2025, 6, 1, 12, 0)
ENGLISH = "The house is quiet and the rooms are bright. You share the kitchen with one person and you can use the garden. "
GERMAN = "Das Haus ist ruhig und die Zimmer sind hell. Sie teilen die Küche mit einer Person und nutzen auch den Garten. "


def feed(spark, sf, name: str, german: bool = False) -> DataFrame:
    """Every customer as a listing of the feed; the same customer in two feeds is one posting."""
    text = F.when((F.col("c_custkey") % 2 == 0) & F.lit(german), GERMAN * 3).otherwise(ENGLISH * 3)
    return table(spark, sf, "customer").select(
        F.concat(F.lit(f"{name}-"), "c_custkey").alias("uuid"), F.concat(F.lit("Room "), "c_custkey").alias("title"),
        F.col("c_name").alias("business_name"), F.lit("Harbour").alias("municipal"), F.lit("COAST").alias("county"),
        text.alias("description"), F.lit("ACTIVE").alias("status"))


def run(spark, sf, stored: DataFrame | None = None, actions: DataFrame | None = None, german: bool = False, **more) -> RefreshResult:
    specs = [SourceSpec(n, lambda s, n=n: feed(s, sf, n, german), policy=merge.OVERWRITE, lends_text=True) for n in ("a", "b")]
    specs.append(SourceSpec("gone", lambda s: table(s, sf, "no_such_table")))
    return refresh(spark, stored, spark.createDataFrame([], TOMBSTONE), read_all(spark, specs), actions, DEMO_PACK, NOW, **more)


def actions(spark, sf) -> DataFrame:
    """Two thirds of the customers' first listings become `applied`; half of those are reset later."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")

    def at(value: str, day: int):
        return [F.concat(F.lit("a-"), key).alias("uuid"), F.lit("status").alias("field"), F.lit(value).alias("value"),
                F.lit(dt.datetime(2025, 5, day)).cast("timestamp").alias("ts"), (key * 2 + day).cast("long").alias("seq")]

    out = c.where(key % 3 < 2).select(*at("applied", 28)).unionByName(c.where(key % 3 == 1).select(*at("new", 29)))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in ACTION])


@query("refresh_actions", """SELECT concat(s, '-', cast(c_custkey AS string)) AS uuid, CASE WHEN c_custkey % 3 = 0 THEN 'applied' ELSE 'new' END AS user_status,
CASE WHEN c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND s = 'a') THEN 1 ELSE 0 END AS dated FROM customer, (VALUES ('a'), ('b')) t(s)""")
def refresh_actions(spark, sf):
    out = run(spark, sf, actions=actions(spark, sf)).listings
    return out.select("uuid", "user_status", flag(F.col("applied_at").isNotNull()).alias("dated"))


@query("refresh_second_run", """SELECT concat(s, '-', cast(c_custkey AS string)) AS uuid, CASE WHEN c_custkey % 2 = 0 THEN 'de' ELSE 'en' END AS language
FROM customer, (VALUES ('a'), ('b')) t(s)""")
def refresh_second_run(spark, sf):
    first = run(spark, sf)
    return run(spark, sf, stored=first.listings, german=True).listings.select("uuid", "language")


@query("refresh_run_rows", """SELECT s AS source, n AS n_new, 0 AS failed FROM (SELECT count(*) AS n FROM customer), (VALUES ('a'), ('b')) t(s)
UNION ALL SELECT 'gone', NULL, 1 UNION ALL SELECT 'run', NULL, 0""")
def refresh_run_rows(spark, sf):
    rows = run(spark, sf).run
    return rows.select(F.coalesce("source", F.lit("run")).alias("source"), F.try_element_at("stats", F.lit("new")).alias("n_new"),
                       flag(F.col("error").isNotNull()).alias("failed"))


DETAIL = "The kitchen is large and you share it with one other person. The post is 60 % of full time, a post for the summer. "


@query("refresh_details", f"""SELECT concat(s, '-', cast(c_custkey AS string)) AS uuid, CASE WHEN s = 'a' AND c_custkey % 4 < 3 THEN 1 ELSE 0 END AS tried,
CASE WHEN s = 'a' AND c_custkey % 4 < 2 THEN '{(DETAIL * 2).strip()}' ELSE '{(ENGLISH * 3).strip()}' END AS description FROM customer, (VALUES ('a'), ('b')) t(s)""")
def refresh_details(spark, sf):
    """Detail pages of three quarters of one feed were asked for; a third of those came back without a text."""
    key = F.col("c_custkey")
    details = table(spark, sf, "customer").where(key % 4 < 3).select(
        F.concat(F.lit("a-"), key).alias("uuid"), F.when(key % 4 < 2, DETAIL * 2).otherwise(F.lit("")).alias("text"))
    out = run(spark, sf, landed=Landed(details=details)).listings
    return out.select("uuid", flag(F.coalesce(F.col("description_fetch_attempted_at") == F.lit(NOW), F.lit(False))).alias("tried"), F.trim("description").alias("description"))


@query("refresh_edits", f"""SELECT concat(s, '-', cast(c_custkey AS string)) AS uuid, CASE WHEN s = 'b' AND c_custkey % 5 = 0 THEN 'my room' ELSE concat('Room ', cast(c_custkey AS string)) END AS title,
CASE WHEN s = 'b' AND c_custkey % 5 = 0 THEN 'de' ELSE 'en' END AS language FROM customer, (VALUES ('a'), ('b')) t(s)""")
def refresh_edits(spark, sf):
    """Edited rows keep what the user wrote in the run that lands the edits; the language follows the new text."""
    edits = table(spark, sf, "customer").where(F.col("c_custkey") % 5 == 0).select(
        F.concat(F.lit("b-"), "c_custkey").alias("uuid"), F.lit("my room").alias("title"), F.lit(GERMAN * 3).alias("description"))
    return run(spark, sf, landed=Landed(edits=edits)).listings.select("uuid", "title", "language")


def digest_run(spark, sf, stored, days: int, parsed: int, landed: Landed | None = None):
    """A digest of customers whose mail came `key % 10` days before the run, read over a window of `days`."""
    mails = lambda s: feed(s, sf, "d").withColumn(
        "mail_date", F.lit(NOW).cast("timestamp") - F.make_dt_interval(days=(F.regexp_extract("uuid", "[0-9]+", 0).cast("int") % 10)))
    spec = SourceSpec("d", mails, policy=merge.OVERWRITE, digest=True, lookback_days=days)
    parse = spark.createDataFrame([(5, 10, parsed)], "messages int, cards int, parsed int")
    landed = landed or Landed(parses={"d": parse})
    stones = spark.createDataFrame([(f"d-{k}", NOW) for k in range(41)], TOMBSTONE)
    return refresh(spark, stored, stones, read_all(spark, [spec], NOW), None, DEMO_PACK, NOW, landed=landed, since=NOW - dt.timedelta(days=1), min_score=0)


@query("refresh_absent", """SELECT concat('d-', cast(c_custkey AS string)) AS uuid, p AS run FROM customer, (VALUES ('parsed'), ('gap')) t(p)
WHERE c_custkey > 40 AND (c_custkey % 10 <= 3 OR p = 'gap')""")
def refresh_absent(spark, sf):
    """A second run over a shorter window: what no digest of the window mentions goes, but only if every card was parsed."""
    first = digest_run(spark, sf, None, 30, 10)
    outs = [digest_run(spark, sf, first.listings, 3, n).listings.select("uuid", F.lit(name).alias("run")) for name, n in (("parsed", 10), ("gap", 9))]
    return outs[0].unionByName(outs[1])


@query("refresh_readd", """SELECT concat('d-', cast(c_custkey AS string)) AS uuid FROM customer WHERE c_custkey > 40 OR c_custkey % 2 = 0""")
def refresh_readd(spark, sf):
    """Keys with a tombstone stay away, those added again by hand come back."""
    again = spark.createDataFrame([(f"d-{k}",) for k in range(0, 41, 2)], "uuid string")
    return digest_run(spark, sf, None, 30, 10, Landed(readded=again)).listings.select("uuid")


@query("refresh_new_high", "SELECT count(*) AS n FROM customer WHERE c_custkey > 40")
def refresh_new_high(spark, sf):
    """The run's own row holds how many rows are new since the last run and score enough."""
    rows = digest_run(spark, sf, None, 30, 10).run
    return rows.where("source IS NULL").select(F.try_element_at("stats", F.lit("new_high_score")).cast("long").alias("n"))
