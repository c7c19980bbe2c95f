"""Plain-text mail digests: dashed blocks with a marker line that carries the link."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cut_at_employer, extract
from ..operators.places import resolve_location, resolve_region


@dataclass(frozen=True)
class DigestFormat:
    """Where a card's fields are: `tail` reads the two lines before the marker, `front` the first three lines."""

    name: str
    marker: str
    link: str                       # pattern of the link, group 1 = link or id
    layout: str                     # "tail" or "front"
    noise: Sequence[str] = ()       # lines that belong to no card (front layout)
    rule: str = "-{20,}"


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per mail: message (file path) and whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("message"), F.col("value").alias("text"))


def cards(mails: DataFrame, fmt: DigestFormat) -> DataFrame:
    """Parsed cards: message, block, title, employer, location, link."""
    blocks = mails.select("message", F.posexplode(F.split("text", fmt.rule)).alias("block", "_b")).where(
        F.contains("_b", F.lit(fmt.marker)))
    lines = F.filter(F.transform(F.split("_b", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform("_lines", lambda x: F.startswith(x, F.lit(fmt.marker))), True)
    b = blocks.withColumn("_lines", lines).withColumn("_at", at.cast("int")).where(F.col("_at") > 0)
    b = b.withColumn("link", extract(F.element_at("_lines", F.col("_at")), fmt.link)).where(F.col("link").isNotNull())
    if fmt.layout == "tail":
        return _tail(b)
    noise = "|".join(fmt.noise) if fmt.noise else r"(?!)"
    b = b.withColumn("_card", F.filter(F.slice("_lines", F.lit(1), F.col("_at") - 1), lambda x: ~x.rlike(noise)))
    b = b.where(F.size("_card") >= 3)
    title, employer, location = (F.get("_card", F.lit(i)) for i in range(3))
    return b.select("message", "block", cut_at_employer(title, employer).alias("title"), employer.alias("employer"),
                    location.alias("location"), "link")


def _tail(b: DataFrame) -> DataFrame:
    b = b.where(F.col("_at") >= 3).withColumn("_who", F.get("_lines", F.col("_at") - 2)).withColumn(
        "_t", F.get("_lines", F.col("_at") - 3))
    stray = F.col("_t") == ","  # left over from the previous block
    b = b.where(~stray | (F.col("_at") >= 4)).withColumn(
        "_t", F.when(stray, F.get("_lines", F.col("_at") - 4)).otherwise(F.col("_t")))
    last_comma = r"^(.*),([^,]*)$"
    split = F.col("_who").rlike(last_comma)
    employer = F.when(split, F.trim(F.regexp_extract("_who", last_comma, 1))).otherwise(F.col("_who"))
    return b.select(
        "message", "block", F.trim(F.regexp_replace("_t", "^,+", "")).alias("title"),
        F.coalesce(F.nullif(employer, F.lit("")), F.col("_who")).alias("employer"),
        F.when(split, F.nullif(F.trim(F.regexp_extract("_who", last_comma, 2)), F.lit(""))).alias("location"), "link")


def parse_report(mails: DataFrame, fmt: DigestFormat) -> DataFrame:
    """One row (messages, cards, parsed): marker lines are counted independently of the parser."""
    pattern = rf"(?m)^\s*{fmt.marker}"
    counted = mails.agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))), F.lit(0)).alias("cards"))
    parsed = cards(mails, fmt).agg(F.count(F.lit(1))).scalar()
    return counted.select("*", parsed.alias("parsed"))


def parse_warning(report: DataFrame) -> DataFrame:
    """The report with a warning text when mails hold no cards or cards were lost."""
    gap = F.col("cards") - F.col("parsed")
    return report.withColumn("warning", F.when(
        (F.col("messages") > 0) & (F.col("cards") == 0), F.concat(F.col("messages"), F.lit(" message(s) without any card")),
    ).when(gap > 0, F.concat(gap, F.lit(" of "), F.col("cards"), F.lit(" card(s) could not be parsed"))))


def digest_listings(found: DataFrame, prefix: str, places: DataFrame, country: str | None = None,
                    region_words: Sequence[str] = (), link_base: str | None = None) -> DataFrame:
    """Cards as listing columns; the first card of an id in mail order stays."""
    ident = F.substring_index("link", "/", -1)
    link = F.concat(F.lit(link_base), ident) if link_base else F.col("link")
    rows = found.select(
        F.concat(F.lit(prefix + "-"), ident).alias("uuid"), F.lit("ACTIVE").alias("status"), "title",
        F.col("employer").alias("business_name"), F.col("employer").alias("employer_name"),
        F.col("location").alias("municipal"), link.alias("application_url"), link.alias("link"),
        F.struct("message", "block").alias("seq"))
    firsts = rows.groupBy("uuid").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("uuid", "seq")]), "seq").alias("_r"))
    rows = firsts.select("uuid", "_r.*")
    if country:
        return resolve_location(rows, places, "municipal", country, region_words)
    return resolve_region(rows, places)
