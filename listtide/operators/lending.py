"""Borrowed descriptions: thin sources read the text of the best matching row of a full source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import first_by, in_keys, lookup

MIN_LENT_CHARS = 200  # fixed value: shortest plain text worth lending


def best_lenders(rows: DataFrame, key: Sequence[str], lender_order: Sequence[str], plain: Column) -> DataFrame:
    """key -> lender: preferred source first, then the longest text, then the smallest id. Ids and lengths
    only take part in the shuffle; the text follows by id."""
    rank = F.array_position(F.array(*[F.lit(s) for s in lender_order]), F.col("source"))
    fit = rows.where((rank > 0) & (F.length(plain) >= MIN_LENT_CHARS)).select(
        *key, "uuid", rank.alias("_rank"), F.length("description").alias("_len"))
    return first_by(fit, key, [F.col("_rank"), -F.col("_len"), F.col("uuid")], ["uuid"]).withColumnRenamed(
        "uuid", "lender")


def borrow(rows: DataFrame, key: Sequence[str], thin_sources: Sequence[str], lender_order: Sequence[str],
           plain: Column) -> DataFrame:
    """Rows of thin sources without a text of their own get (description, description_borrowed_from) from their
    lender; when no lender is left an earlier borrow stays; own text is never replaced. Adds `_borrowed`
    (the text or its origin changed)."""
    thin = F.coalesce(F.col("source").isin(*thin_sources) & (
        F.col("description_borrowed_from").isNotNull() | (F.coalesce(F.col("description"), F.lit("")) == "")), F.lit(False))
    # Only rows that may borrow are shuffled, and only texts of the sources that lend; all other rows pass untouched.
    asked = rows.where(thin)
    lenders = in_keys(best_lenders(rows, key, lender_order, plain), asked, key)
    texts = rows.where(F.col("source").isin(*lender_order)).select(F.col("uuid").alias("lender"), F.col("description").alias("_text"))
    out = lookup(asked, lenders.join(texts, "lender"), key, ["uuid"])
    stays = F.col("description_borrowed_from").isNotNull() & (F.coalesce(F.col("description"), F.lit("")) != "")
    text = F.when(F.col("lender").isNotNull(), F.col("_text")).when(stays, F.col("description"))
    origin = F.when(F.col("lender").isNotNull(), F.col("lender")).when(stays, F.col("description_borrowed_from"))
    moved = ~text.eqNullSafe(F.col("description")) | ~origin.eqNullSafe(F.col("description_borrowed_from"))
    lent = out.select(*[text.alias(c) if c == "description" else origin.alias(c) if c == "description_borrowed_from" else F.col(c)
                        for c in rows.columns], moved.alias("_borrowed"))
    return lent.unionByName(rows.where(~thin).withColumn("_borrowed", F.lit(False)))


def with_lender(rows: DataFrame) -> DataFrame:
    """Detail lookup: each row next to the title and source of the row it borrows from."""
    dim = rows.select(F.col("uuid").alias("description_borrowed_from"), F.col("title").alias("lender_title"),
                      F.col("source").alias("lender_source"))
    return lookup(rows, dim, ["description_borrowed_from"], ["uuid"])
