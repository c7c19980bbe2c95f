"""Outcomes that single operators do not show: losses, repeated keys, resets, dates, isolation."""

import datetime as dt

from pyspark.sql import functions as F

from listtide.operators import merge
from listtide.operators.pack import DEMO_PACK
from listtide.plans.refresh import refresh
from listtide.schema import ACTION, TOMBSTONE
from listtide.sources import feeds
from listtide.sources.registry import SourceSpec, read_all
from listtide.sources.versions import VersionedTable
from listtide.streaming import ingest
from test_refresh import LONG, NOW, feed


def page(seq, *uuids):
    items = ",".join('{"_feed_entry":{"uuid":"%s","status":"ACTIVE","sistEndret":"%d"}}' % (u, seq) for u in uuids)
    return '{"id":"p%d","seq":%d,"items":[%s]}' % (seq, seq, items)


def test_a_broken_page_is_counted_and_an_empty_one_is_none(spark, tmp_path):
    (tmp_path / "a.json").write_text(page(1, "x", "y") + "\n" + '{"id": "p2", "seq": 2, "items": [{"_feed\n' + page(3) + "\n")
    rows = feeds.changelog_entries(feeds.read_changelog(spark, str(tmp_path))).collect()
    assert sorted(r.uuid or "" for r in rows) == ["", "x", "y"] and sum(r.malformed for r in rows) == 1


def test_snapshot_gaps_are_not_complete(spark, tmp_path):
    one = lambda n: '{"page": %d, "jobs": [{"id": %d}]}' % (n, n)
    for name, lines, complete in (("whole", [one(1), one(2), one(3)], True), ("gap", [one(1), one(3)], False), ("late", [one(2)], False),
                                  ("broken", [one(1), one(2), '{"page": 3, "jo'], False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(lines))
        assert feeds.snapshot_completeness(feeds.read_snapshot(spark, str(tmp_path / name))).first().complete is complete, name


def test_a_repeated_key_leaves_one_row(spark):
    stored = spark.createDataFrame([("a", "old")], "uuid string, title string")
    new = spark.createDataFrame([("a", "one", 1), ("b", "x", 4), ("a", "two", 2), ("b", "y", 3)], "uuid string, title string, seq int")
    got = merge.merge(stored, new, merge.OVERWRITE, order="seq").drop("seq")
    assert sorted((r.uuid, r.title) for r in got.collect()) == [("a", "two"), ("b", "x")]


def test_the_tip_passes_only_later_pages(spark, tmp_path):
    land, table = tmp_path / "land", VersionedTable(spark, str(tmp_path / "table"))
    land.mkdir()
    (land / "a.json").write_text(page(1, "x") + "\n" + page(2, "y"))
    for n in (3, None):
        ingest.run_changelog(spark, str(land), str(tmp_path / "check"), table, from_tip=True)
        if n:
            assert not table.versions() or table.read().count() == 0
            (land / "b.json").write_text(page(3, "z"))
    assert [r.uuid for r in table.read().collect()] == ["z"]


def test_broken_pages_behind_the_tip_are_counted(spark, tmp_path):
    land, table, lost = tmp_path / "land", VersionedTable(spark, str(tmp_path / "table")), []
    land.mkdir()
    (land / "a.json").write_text(page(1, "x") + "\n" + '{"id": "p2", "seq": 2, "items": [{"_feed\n')
    for n in (3, None):
        ingest.run_changelog(spark, str(land), str(tmp_path / "check"), table, from_tip=True,
                             on_batch=lambda _, batch: lost.append(batch.where("malformed").count()))
        if n:
            assert sum(lost) == 0
            (land / "b.json").write_text(page(3, "z") + "\n" + '{"id": "p4", "seq": 4, "items": [{"_feed\n')
    assert [r.uuid for r in table.read().collect()] == ["z"] and sum(lost) == 1


def once(spark, stored, rows, actions=None, more=()):
    specs = [SourceSpec(f"s{k}", lambda s, r=r: feed(s, *r), policy=merge.OVERWRITE, lends_text=True) for k, r in enumerate(rows)] + list(more)
    return refresh(spark, stored, spark.createDataFrame([], TOMBSTONE), read_all(spark, specs), actions, DEMO_PACK, NOW)


def test_a_reset_reaches_the_copies_and_stays(spark):
    rows = [[dict(uuid="x-1", description=LONG)], [dict(uuid="y-1", description=LONG)]]
    log = [("x-1", "status", "applied", dt.datetime(2025, 5, 1), 1)]
    first = once(spark, None, rows, spark.createDataFrame(log, ACTION))
    got = {r.uuid: r for r in first.listings.collect()}
    assert {u: r.user_status for u, r in got.items()} == {"x-1": "applied", "y-1": "applied"}
    assert got["x-1"].applied_at == dt.datetime(2025, 5, 1) and got["y-1"].applied_at == NOW
    log.append(("x-1", "status", "new", dt.datetime(2025, 5, 2), 2))
    again = once(spark, first.listings, rows, spark.createDataFrame(log, ACTION))
    assert {r.uuid: r.user_status for r in again.listings.collect()} == {"x-1": "new", "y-1": "new"}


def test_language_follows_the_text_and_sources_are_isolated(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is no table PAR1")
    schema = feed(spark, dict(uuid="q")).schema
    broken = SourceSpec("broken", lambda s: s.read.schema(schema).parquet(str(tmp_path / "bad.parquet")))
    german = "<p>Das Zimmer ist ruhig und hell, und die Lage ist gut. Wir suchen eine Person, die gerne kocht und nicht raucht.</p>" * 4
    first = once(spark, None, [[dict(uuid="x-1", description=LONG)]], more=[broken])
    assert first.stage_errors == [] and [r.language for r in first.listings.collect()] == ["en"]
    later = once(spark, first.listings, [[dict(uuid="x-1", description=german)]])
    assert [r.language for r in later.listings.collect()] == ["de"]
    assert [bool(r.error) for r in read_all(spark, [broken])] == [True]


def test_no_job_runs_while_a_scoring_plan_is_built(spark):
    from listtide.operators import scoring
    from test_rules import row_frame
    rows = row_frame(spark, dict(description="x")).groupBy("uuid").agg(*[F.first(c).alias(c) for c in (
        "title", "description", "municipal", "county", "language", "extent_percent", "engagement_type", "occupation_categories")])
    spark.sparkContext.setJobGroup("plan", "plan")
    scoring.with_facts(rows, DEMO_PACK)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
