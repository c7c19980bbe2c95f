"""Queries next to their SQL on odd inputs that the given tables hold only at larger scales."""

import html

import pytest
from compare import connect, diff

from listtide.plans.catalog import ORACLES, QUERIES

ODD = ["cut &amp", "a&ampb &lt;p&gt; &notit; &not; &nosuch; & &; &amp;lt;", "&#65;&#x41;&#x1F600 &#0; &#128; &#xD800; &#99999999999; &#1; &#x1FFFE;x",
       "&nbsp;&NotEqualTilde;&Tab;|&quot;&apos;", "plain", "", "fran&ccedil;ais e&#769;"]


def compare(spark, tmp_path, name, **tables):
    for table, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / "raw" / table))
        part = next((tmp_path / "raw" / table).glob("*.parquet"))
        part.rename(tmp_path / f"{table}.parquet")
    return diff(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)).sql(ORACLES[name]))


@pytest.mark.parametrize("name", ["f2_strip_html", "f3_entities", "s5_html_fields"])
def test_every_reference_is_decoded_in_sql_too(spark, tmp_path, name):
    page = lambda t: f'<html lang="en"><title>{t}</title><article>{t}</article><p class="x">{t}</p>'
    rows = [(i, "u", page(t)) for i, t in enumerate(ODD)] + [(90, "u", None), (91, "u", "<title>t</title><article>no language</article>")]
    assert compare(spark, tmp_path, name, pages=spark.createDataFrame(rows, "page_id long, url string, html string")) == []


def test_references_in_sql_are_those_of_html(spark, tmp_path):
    rows = [(i, "u", t) for i, t in enumerate(ODD)]
    assert compare(spark, tmp_path, "f3_entities", pages=spark.createDataFrame(rows, "page_id long, url string, html string")) == []
    got = connect(str(tmp_path)).sql(ORACLES["f3_entities"]).fetchall()
    assert {k: v for k, v in got} == {i: html.unescape(t) for i, t in enumerate(ODD)}


def test_keywords_where_title_and_text_meet(spark, tmp_path):
    texts = ["of all the\nrest", "die Zeit und\nmehr", "the  of", "plain &amp of", "with <b>the</b> of", None, ""]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    assert compare(spark, tmp_path, "r_score_documents", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string")) == []


@pytest.mark.parametrize("first", [0, 1])
def test_pages_of_a_snapshot_start_at_one(spark, tmp_path, first):
    rows = [(k * 10, k, "O", "1-URGENT") for k in (0, 1, 2, 4) if k >= first] + [(30 + first, 3 if first else 2, "O", "1-URGENT")]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    assert compare(spark, tmp_path, "s2_snapshot_pages", orders=df.selectExpr("*", "DATE '1998-01-01' AS o_orderdate")) == []


def test_no_task_gets_more_than_its_share_of_the_files(spark, tmp_path):
    from listtide.session import spread
    spark.range(200_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert spread(rows).rdd.getNumPartitions() == 8
    assert spread(rows, size // 20).rdd.getNumPartitions() in (20, 21) and spread(rows, size // 20).count() == 200_000


def test_the_end_of_a_longer_number_is_no_share(spark, tmp_path):
    ends = ["126.57.31.34%%%", "+1 (988) 555-0546%%%", "6791628068594162%%%", "62,5 %", "4.0.%%%", ""]
    rows = [(i, f"this and that {end}", "en", 1) for i, end in enumerate(ends)] + [(90, "und 10.0.0.7%%%", "de", 1), (91, "this 10.0.0.7%%%", "en", 1)]
    assert compare(spark, tmp_path, "u12_full_text", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")) == []
