"""Identity of a posting across sources, and category tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORY

# Company-form words dropped from names, and the letters a key keeps besides a-z and digits.
COMPANY_FORMS = ("as", "asa", "kf", "ans")
KEY_LETTERS = "a-z0-9æøå"


def name_key(c: Column) -> Column:
    """Lower case, company forms removed, everything but letters and digits a blank, blanks squeezed."""
    low = F.lower(F.coalesce(c, F.lit("")))
    word = r"[\p{L}\p{M}\p{N}_]"
    starts = "".join(sorted({form[0] for form in COMPANY_FORMS}))
    # The first-letter test comes first: it fails on most positions without looking around.
    bare = F.regexp_replace(low, rf"(?=[{starts}])(?<!{word})(?:{'|'.join(COMPANY_FORMS)})(?!{word})\.?", "")
    spaced = F.regexp_replace(bare, rf"[^{KEY_LETTERS}]+", " ")
    return F.trim(spaced)


def place_key(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def identity_key(employer: Column, title: Column, place: Column) -> Column:
    return F.struct(
        name_key(employer).alias("employer"), name_key(title).alias("title"), place_key(place).alias("place"),
    )


def identity_hash(employer: Column, title: Column, place: Column) -> Column:
    """256-bit digest of the identity key: a narrow shuffle key even when titles are long."""
    parts = (name_key(employer), name_key(title), place_key(place))
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def parse_categories(raw: Column) -> Column:
    return F.coalesce(F.from_json(raw, CATEGORY), F.array().cast(CATEGORY))


def level1_set(categories: Column) -> Column:
    names = F.transform(F.coalesce(categories, F.array().cast(CATEGORY)), lambda x: x["level1"])
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def has_level1(categories: Column, name: str) -> Column:
    return F.coalesce(F.exists(categories, lambda x: x["level1"] == F.lit(name)), F.lit(False))


def has_pair(categories: Column, level1: str, level2: str) -> Column:
    return F.coalesce(
        F.exists(categories, lambda x: (x["level1"] == F.lit(level1)) & (x["level2"] == F.lit(level2))), F.lit(False))
