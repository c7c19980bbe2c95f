"""Place names to regions and tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import place_key
from .skew import first_by, lookup


def region_map(regions: DataFrame) -> DataFrame:
    """(name, municipality array<struct<name>>) -> place, region. Bilingual names count once per part; a region
    without municipalities stands for itself; a place named twice takes the last one in (region, position) order."""
    whole = regions.where(F.size(F.coalesce("municipality", F.array().cast("array<struct<name:string>>"))) == 0).select(
        place_key(F.col("name")).alias("place"), F.col("name").alias("region"), F.lit(-1).alias("seq"))
    parts = regions.select(F.col("name").alias("region"), F.posexplode("municipality").alias("seq", "m")).select(
        "region", "seq", F.explode(F.split(F.col("m")["name"], " - ")).alias("part"),
    ).select(place_key(F.col("part")).alias("place"), "region", "seq")
    return whole.unionByName(parts).groupBy("place").agg(F.max_by("region", F.struct("region", "seq")).alias("region"))


def with_postal(places: DataFrame, postal: DataFrame) -> DataFrame:
    """Postal places of a known municipality join the map unless the name is already there."""
    extra = postal.join(places.select(F.col("place").alias("municipality"), "region"), "municipality").select("place", "region")
    return places.unionByName(extra.join(places.select("place"), "place", "left_anti"))


def resolve_region(rows: DataFrame, places: DataFrame, column: str = "municipal", key: str = "uuid") -> DataFrame:
    """Region by trimmed upper-case place name; an unknown place stays NULL."""
    keyed = rows.withColumn("place", place_key(F.col(column)))
    return lookup(keyed, places.select("place", F.col("region").alias("county")), ["place"], [key]).drop("place")


def resolve_location(rows: DataFrame, places: DataFrame, column: str, country: str, region_words: Sequence[str],
                     key: str = "uuid") -> DataFrame:
    """Free-form location -> municipal, county: country suffix cut, first comma part, region words dropped,
    '/'-separated candidates; the first candidate known as a place decides the county, else the first
    candidate read as a region name. A bare country has neither."""
    text = F.regexp_replace(F.trim(column), rf"(?i),\s*{country}$", "")
    first = F.trim(F.regexp_replace(F.get(F.split(text, ","), F.lit(0)), "(?i)" + "|".join(region_words), ""))
    split = F.filter(F.transform(F.split(first, "/"), lambda p: F.trim(p)), lambda p: p != "")
    candidates = F.when(F.lower(text) != country.lower(), F.when(F.size(split) > 0, split).otherwise(F.array(first)))
    keyed = rows.withColumn("_cand", candidates)
    seen = keyed.select(key, F.posexplode("_cand").alias("_pos", "_c")).select(
        key, "_pos", place_key(F.col("_c")).alias("place"))
    found = first_by(lookup(seen, places, ["place"], [key], "inner"), [key], [F.col("_pos")], ["region"])
    names = places.select("region").distinct().select(
        place_key(F.col("region")).alias("_rk"), F.col("region").alias("_named"))
    out = keyed.join(found, key, "left").withColumn("municipal", F.get("_cand", F.lit(0)))
    out = lookup(out.withColumn("_rk", place_key(F.col("municipal"))), names, ["_rk"], [key])
    return out.withColumn("county", F.when(F.col("municipal").isNotNull(), F.coalesce("region", "_named"))).drop(
        "_cand", "region", "_rk", "_named")


def resolve_tier_place(rows: DataFrame, tier_places: DataFrame, home_region: str, key: str = "uuid") -> DataFrame:
    """`tier_place`: inside the home region a place name is replaced by its tier municipality, elsewhere and for
    unknown names it stays. `tier_places` is (place, municipality)."""
    own = place_key(F.col("municipal"))
    home = F.upper(F.coalesce(F.col("county"), F.lit(""))) == home_region
    keyed = rows.withColumn("_own", own).withColumn("place", F.when(home, own))
    return lookup(keyed, tier_places.select("place", "municipality"), ["place"], [key]).withColumn(
        "tier_place", F.coalesce("municipality", "_own")).drop("place", "municipality", "_own")


def with_travel_time(rows: DataFrame, travel: DataFrame, column: str = "municipal", key: str = "uuid") -> DataFrame:
    """`reach`: found (with duration_min), the landed error ('no_route', 'not_found'), or 'unknown' when nothing
    has landed for the place."""
    keyed = rows.withColumn("place", place_key(F.col(column)))
    dim = travel.select("place", "duration_min", "modes", F.col("error").alias("_err"), F.lit(True).alias("_hit"))
    reach = F.when(F.col("_hit").isNull(), "unknown").otherwise(F.coalesce("_err", F.lit("found")))
    return lookup(keyed, dim, ["place"], [key]).withColumn("reach", reach).drop("_err", "_hit", "place")
