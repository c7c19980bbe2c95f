"""The corpus pipeline: five stages, each one applying an operator to all that its predecessor kept."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listtide.llm import bpe, contamination, jaccard, secrets, toxicity
from listtide.llm.tables import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; fitted on the labelled rows of this stage's documents.

    Null and empty texts are scored by empty features; without labels of both classes nothing (or, if all labels say so, all) goes.
    Repeated rows and rows without an id are judged like any other by their text."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep_text=True).where("predicted = 0").select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the one of smallest id (rows without an id last), then of smallest content.

    Rows are told apart by all their columns, so different texts under one id are different rows, and of wholly equal rows one stays.
    Rows whose text is null, empty or without a word have no duplicates: all of them stay."""
    number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    row = F.concat(F.coalesce(number, F.lit("null")), F.lit("-"), F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256))
    keyed = docs.select(row.alias("key"), F.struct("*").alias("row"))  # no column of the documents can clash with these
    found = jaccard.near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key"), (F.col("n_shingles") > 0).alias("worded")).distinct()
    kept = keyed.join(keep, "key")
    one = kept.where("worded").dropDuplicates(["key"])
    return one.unionByName(kept.where("NOT worded")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of a benchmark item; null, empty and wordless texts stay, repeated rows are judged alike."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; a null text stays null, an empty one empty, repeated rows stay."""
    return secrets.redact(docs, secrets.train(docs.select("doc_id", "text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, one row each; a null or empty text has no tokens."""
    return bpe.digest(bpe.encode_decode(docs.select("doc_id", "text"), *bpe.public_vocabulary()))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: SQL cannot express the fitted stages; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of `sf_dir`; each stage's rows are written before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
