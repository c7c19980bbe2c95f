"""The physical plans are the ones we want: pruned scans, pushed filters, no needless exchange."""

import pytest
from pyspark.sql import functions as F

from listtide.functions import text
from listtide.functions.identity import identity_hash
from listtide.operators import blocks, groups, merge, places, scoring, skew
from listtide.operators import listing as L
from listtide.operators.pack import DEMO_PACK
from listtide.schema import align


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def listings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "listings")
    align(spark.range(200).select(F.concat(F.lit("u"), "id").alias("uuid"), F.lit("ACTIVE").alias("status"), F.lit("text").alias("description"))
          ).repartition(16).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # show filters and schemas in full
    yield spark.read.parquet(path)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_page_is_a_top_k_over_a_pruned_scan(listings):
    p = plan(L.list_page(listings, L.ListingQuery(min_salary=1000, language="en"), offset=50))
    assert "TakeOrderedAndProject" in p and "Exchange" not in p
    filters = p[p.index("PushedFilters"):p.index("ReadSchema")]
    for f in ("EqualTo(language,en)", "GreaterThanOrEqual(salary_min,1000)", "IsNull(flagged_at)", "EqualTo(status,ACTIVE)"):
        assert f in filters
    assert "description" not in p[p.index("ReadSchema"):] and "raw_json" not in p


def test_scorable_scan_is_pruned(listings):
    p = plan(L.scorable(listings))
    assert "raw_json" not in p and "score_breakdown" not in p and "EqualTo(status,ACTIVE)" in p


def test_board_limits_each_task_before_the_shuffle(listings):
    p = plan(L.board(listings))
    assert p.count("WindowGroupLimit") == 4  # two steps, each limited before and after its shuffle


def test_rules_are_narrow(spark, listings):
    cores = spark.sparkContext.defaultParallelism
    rows = listings.repartition(cores * 2).select("*")
    p = plan(scoring.with_scores(scoring.with_facts(blocks.with_blocks(rows, DEMO_PACK), DEMO_PACK), DEMO_PACK))
    assert p.count("Exchange") == 1 and "Join" not in p   # the repartition of this test alone
    assert p.count("ArrowEvalPython") == 1


def test_groups_shuffle_no_text_and_use_no_window(listings):
    keyed = listings.withColumn("k", identity_hash(F.col("business_name"), F.col("title"), F.col("municipal")))
    p = plan(groups.settle(keyed.select("k", "source", *groups.PAYLOAD), ["k"], ["a", "b"]))
    assert "Window" not in p and "description" not in p
    assert p.count("Exchange hashpartitioning") == 2


def test_groups_decide_by_aggregates(listings):
    keyed = listings.withColumn("k", identity_hash(F.col("business_name"), F.col("title"), F.col("municipal")))
    p = plan(groups.settle(keyed.select("k", "source", *groups.PAYLOAD), ["k"], ["a", "b"]))
    assert "lambda" not in p


def test_texts_without_tags_are_only_looked_through(spark):
    texts = ["a <br/>b", "no tag", "  two  blanks\t tab\tend\u00a0", None, "1 < 2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.squeeze(text.untag(F.col("t")))).collect()] == ["a \nb", "no tag", " two blanks tab end ", "", "1 < 2"]
    assert "Contains(t" in plan(df.select(text.untag(F.col("t"))))


def test_merge_is_one_join_on_the_key(listings):
    p = plan(merge.merge(listings, listings.select("uuid", "title"), merge.PARTIAL))
    assert p.count("FullOuter") == 1


def test_small_dimension_is_not_shuffled(spark, listings, tmp_path):
    spark.createDataFrame([("HARBOUR", "COAST")], "place string, region string").write.parquet(str(tmp_path / "places"))
    dim = spark.read.parquet(str(tmp_path / "places"))
    p = plan(places.resolve_region(listings, dim))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_large_dimension_salts_hot_keys(spark, listings, no_broadcast):
    dim = listings.groupBy("title").agg(F.max("uuid").alias("v"))
    p = plan(skew.lookup(listings.select("uuid", "title"), dim, ["title"], ["uuid"]))
    assert "_salt" in p
