"""Bucketed tables, state kept per key, and entries joined with their ads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listtide.sources.versions import BucketedTable
from listtide.streaming import ingest, state


def overwrite(stored, batch):
    return batch if stored is None else batch.unionByName(stored.join(batch.select("uuid"), "uuid", "left_anti"))


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "uuid string, n long")


def values(df):
    return {r.uuid: r.n for r in df.collect()}


def test_an_update_writes_the_touched_bucket_only(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), buckets=16)
    t.update(rows(spark, [(f"u{k}", k) for k in range(200)]), overwrite)
    before = t.places()
    assert len(before) > 10 and values(t.read()) == {f"u{k}": k for k in range(200)}
    t.update(rows(spark, [("u7", -1)]), overwrite)
    after = t.places()
    assert sum(before[b] != after[b] for b in before) == 1 and values(t.read()) == {f"u{k}": -1 if k == 7 else k for k in range(200)}
    assert values(t.read(version=1)) == {f"u{k}": k for k in range(200)}
    seen = []
    t.update(rows(spark, [("u7", 5)]), lambda stored, batch: seen.append(stored.count()) or overwrite(stored, batch))
    assert seen[0] < 60  # the fold is given one bucket, not the table
    assert t.update(rows(spark, []), overwrite) == 3


def test_old_versions_and_lost_buckets(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), buckets=4)
    t.write(rows(spark, [(f"u{k}", k) for k in range(40)]))
    for k in range(12):
        t.update(rows(spark, [("u1", 100 + k)]), overwrite)
    assert len(t.versions()) == 10
    kept = {p.name for p in (tmp_path / "t" / "data").iterdir() if p.is_dir()}
    assert {p.split("/")[1] for p in t.places().values()} <= kept and len(kept) <= 12
    t.update(rows(spark, [("u1", 0)]), lambda stored, batch: stored.where("false"))  # a fold may empty a bucket
    assert "u1" not in values(t.read()) and len(values(t.read())) < 40
    again = BucketedTable(spark, str(tmp_path / "t"), buckets=99)
    assert again.buckets == 4 and values(again.read()) == values(t.read())


def test_empty_table(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"))
    t.write(rows(spark, []))
    assert t.read().count() == 0 and t.read().columns == ["uuid", "n"]
    t.update(rows(spark, [("a", 1)]), overwrite)
    assert values(t.read()) == {"a": 1}


AT = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("late", [False, True])
def test_attempts_over_restarts(spark, tmp_path, late):
    hours = [("a", 1, "failed"), ("a", 2, "failed"), ("b", 1, "failed"), ("a", 3, "ok"), ("a", 4, "failed"), ("c", 1, "ok"), ("b", 2, "failed"), ("b", 3, "failed")]
    halves = [hours[4:], hours[:4]] if late else [hours[:4], hours[4:]]
    table = BucketedTable(spark, str(tmp_path / "t"), buckets=4)
    for part in halves:
        frame = spark.createDataFrame([(u, AT + dt.timedelta(hours=h), o) for u, h, o in part], "uuid string, ts timestamp, outcome string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "land"))
        state.run_attempts(stream, str(tmp_path / "c"), table, delay="30 days")
    assert {r.uuid: (r.failures, r.give_up) for r in table.read().collect()} == {"a": (1, False), "b": (3, True), "c": (0, False)}


def test_changed_entries_and_expiry(spark, tmp_path):
    days = [[("a", 0, "x"), ("a", 1, "x"), ("b", 0, None), ("b", 1, None)], [("a", 2, "x"), ("a", 3, "y"), ("c", 2, "z")], [("t", 200, "t")], [("t", 201, "u")],
            [("c", 202, "z")]]
    for part in days:  # c is silent for longer than its state lives: the same stamp counts as new
        frame = spark.createDataFrame([(u, d, 0, s, AT + dt.timedelta(days=d)) for u, d, s in part], "uuid string, seq long, idx int, stamp string, ts timestamp")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "land"))
        state.run_changed(stream, str(tmp_path / "c"), str(tmp_path / "out"))
    got = sorted(((r.uuid, r.seq, r.stamp) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == sorted([("a", 0, "x"), ("b", 0, None), ("b", 1, None), ("a", 3, "y"), ("c", 2, "z"), ("t", 200, "t"), ("t", 201, "u"), ("c", 202, "z")], key=repr)


def test_ads_land_later_or_never(spark, tmp_path):
    entry = "uuid string, seq long, idx int, ts timestamp, status string, title string, business_name string, municipal string"
    ad = "uuid string, ad_content struct<title: string, description: string>, ts timestamp"
    hour = lambda h: AT + dt.timedelta(hours=h)
    steps = [
        ([("a", 1, 0, hour(0), "ACTIVE", "ea", None, "m"), ("b", 1, 1, hour(0), "ACTIVE", "eb", None, "m")], [("a", ("aa", "text a"), hour(0.5))]),
        ([("a", 2, 0, hour(1), "INACTIVE", "ea2", None, "m")], [("b", ("ab", "text b"), hour(1))]),
        ([("end", 9, 0, hour(900), "ACTIVE", "end", None, "m")], [("end", ("end", ""), hour(900))]),
        ([("end", 9, 1, hour(999), "ACTIVE", "end", None, "m")], [("end", ("end", ""), hour(999))])]
    table, alone = BucketedTable(spark, str(tmp_path / "t"), buckets=4), []
    for e, a in steps:
        spark.createDataFrame(e, entry).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        spark.createDataFrame(a, ad).coalesce(1).write.mode("append").json(str(tmp_path / "a"))
        from listtide.sources import feeds
        ingest.run_feed(spark.readStream.schema(entry).parquet(str(tmp_path / "e")), feeds.stream_ads(spark, str(tmp_path / "a")), str(tmp_path / "c"), table,
                        on_batch=lambda _, b: alone.extend(r.uuid for r in b.where("NOT with_ad").collect()))
    got = {r.uuid: (r.status, r.title, r.description) for r in table.read().where(F.col("uuid") != "end").collect()}
    assert got["a"] == ("INACTIVE", "ea2", "text a")  # the closing entry brings no ad and keeps the text
    assert got["b"] == ("ACTIVE", "ab", "text b") and alone[0] == "a"


def test_many_keys_share_a_state(spark, tmp_path):
    rows = [(f"k{i}", dt.datetime(2025, 1, 1, 0, 0, i), "failed" if i % 3 else "ok") for i in range(50)]
    table = BucketedTable(spark, str(tmp_path / "table"), buckets=4)
    for n in (1, 2):  # the second half of the log meets the states of the first
        spark.createDataFrame(rows, "uuid string, ts timestamp, outcome string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("uuid string, ts timestamp, outcome string").parquet(str(tmp_path / "in"))
        state.run_attempts(stream, str(tmp_path / "check"), table, groups=4, delay="30 days")
        assert {(r.uuid, r.failures) for r in table.read().collect()} == {(k, n * int(o == "failed")) for k, _, o in rows}


def test_a_batch_is_kept_while_it_is_asked(spark, tmp_path):
    from test_faults import page
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.json").write_text(page(1, "x") + "\n" + page(2, "y"))
    table, kept = BucketedTable(spark, str(tmp_path / "table"), buckets=4), []
    ingest.run_changelog(spark, str(tmp_path / "land"), str(tmp_path / "check"), table, on_batch=lambda _, batch: kept.append(batch.is_cached))
    assert kept == [True] and table.read().count() == 2


@pytest.mark.parametrize("begun", ["on disk", "in memory"])
def test_what_waits_for_its_ad_is_kept_on_disk(spark, tmp_path, begun):
    from listtide.sources import feeds
    entry = "uuid string, seq long, idx int, ts timestamp, status string, title string, business_name string, municipal string"
    ad = "uuid string, ad_content struct<title: string, description: string>, ts timestamp"
    table, names = BucketedTable(spark, str(tmp_path / "t"), buckets=4), ["spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.join.stateFormatVersion"]
    before = [spark.conf.get(k, None) for k in names]
    for hour, key in ((0, "a"), (900, "b"), (1800, "c")):
        at = AT + dt.timedelta(hours=hour)
        spark.createDataFrame([(key, hour, 0, at, "ACTIVE", key, None, "m")], entry).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        spark.createDataFrame([(key, ("ad " + key, "text"), at)] if hour else [], ad).coalesce(1).write.mode("append").json(str(tmp_path / "a"))
        entries, ads = spark.readStream.schema(entry).parquet(str(tmp_path / "e")), feeds.stream_ads(spark, str(tmp_path / "a"))
        if not hour and begun == "in memory":  # a checkpoint of before goes on as it is
            ingest.feed_listings(entries, ads).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(
                lambda batch, _: batch.foreach(lambda row: None)).trigger(availableNow=True).start().awaitTermination()
        else:
            ingest.run_feed(entries, ads, str(tmp_path / "c"), table)
        assert [spark.conf.get(k, None) for k in names] == before
    assert {r.uuid: r.title for r in table.read().collect()} == {"a": "a", "b": "ad b", "c": "ad c"}
    kinds = {p.suffix for p in (tmp_path / "c" / "state").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert (".delta" in kinds) == (begun == "in memory") and (".zip" in kinds) == (begun == "on disk")
