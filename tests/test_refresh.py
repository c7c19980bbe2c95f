"""The end-to-end job on landed fixtures: merge, deactivate, borrow, score, settle, retire, repeat."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listtide.operators import merge
from listtide.operators.pack import DEMO_PACK
from listtide.plans.derive import present
from listtide.plans.refresh import refresh
from listtide.schema import ACTION, LISTING, TOMBSTONE
from listtide.sources.registry import SourceSpec, read_all

NOW = dt.datetime(2025, 6, 1, 12, 0)
LONG = "<p>A garden with compost and an orchard near the harbour.</p>" + "<p>We value calm people and good coffee.</p>" * 8
COLS = ("uuid string, title string, business_name string, municipal string, county string, description string, application_due string, "
        "application_due_sort date, status string")


def feed(spark, *rows):
    data = [tuple({**dict(uuid=None, title="Garden shed", business_name="Acme AS", municipal="Harbour", county="COAST", description=None,
                          application_due=None, application_due_sort=None, status="ACTIVE"), **r}.values()) for r in rows]
    return spark.createDataFrame(data, COLS)


def specs(spark, snapshot_rows):
    return [
        SourceSpec("full1", lambda s: feed(s, dict(uuid="f-1", description=LONG), dict(uuid="f-2", title="Kiosk", description=LONG),
                                           dict(uuid="f-3", title="Old post", description=LONG, application_due="1.5.2025", application_due_sort=dt.date(2025, 5, 1)),
                                           dict(uuid="f-4", status="INACTIVE", title="Gone")), policy=merge.OVERWRITE, lends_text=True),
        SourceSpec("full2", lambda s: feed(s, *snapshot_rows), snapshot=True, lends_text=True),
        SourceSpec("thin1", lambda s: feed(s, dict(uuid="t-1", business_name="ACME"), dict(uuid="t-9", title="Trashed before")), thin=True, digest=True),
        SourceSpec("broken", lambda s: s.read.parquet("/nonexistent")),
    ]


SNAP = [dict(uuid=f"s-{i}", title=f"Post {i}", description=LONG + f"<p>usd {30 + i} 000</p>", business_name=f"Firm {i}") for i in range(12)]


def run(spark, stored, stones, rows, complete=True, actions=None):
    results = read_all(spark, specs(spark, rows))
    done = spark.createDataFrame([(complete,)], "complete boolean")
    return refresh(spark, stored, stones, results, actions, DEMO_PACK, NOW, {"full2": done}), results


@pytest.fixture(scope="module")
def first(spark):
    stones = spark.createDataFrame([("t-9", NOW)], TOMBSTONE)
    res, results = run(spark, None, stones, SNAP)
    assert [r.spec.name for r in results if r.error] == ["broken"] and res.stage_errors == []
    return res


def rows_of(res):
    return {r["uuid"]: r for r in res.listings.collect()}


def test_first_run(spark, first):
    got = rows_of(first)
    assert first.listings.schema.fieldNames() == LISTING.fieldNames()
    assert set(got) == {"f-1", "f-2", "t-1", *(f"s-{i}" for i in range(12))}   # inactive, expired and tombstoned ones are out
    t = got["t-1"]
    assert t["description_borrowed_from"] == "f-1" and t["language"] == "en" and t["description"] == LONG
    assert t["excluded"] and t["exclusion_reason"].endswith("from source full1") and not got["f-1"]["excluded"]
    assert got["f-2"]["exclusion_reason"] == "commercial let"
    assert got["s-3"]["salary_text"] == "usd 33 000" and got["s-3"]["salary_min"] == 33000
    assert got["f-1"]["score"] > got["f-1"]["score_it"] and got["f-1"]["user_status"] == "new"
    counts = {(r["source"], r["outcome"]): r["n"] for r in first.outcomes.collect()}
    assert counts == {("full1", "new"): 4, ("full2", "new"): 12, ("thin1", "new"): 1}


def test_second_run_changes_nothing(spark, first):
    again, _ = run(spark, first.listings, first.tombstones, SNAP)
    order = [c for c in LISTING.fieldNames() if c not in ("score_breakdown", "score_it_breakdown")]
    a = first.listings.select(*order).orderBy("uuid").collect()
    b = again.listings.select(*order).orderBy("uuid").collect()
    assert a == b


def test_missing_rows_deactivate_only_on_a_complete_snapshot(spark, first):
    # s-0 was acted on, so it is kept as history when it leaves the feed
    act = spark.createDataFrame([("s-0", "status", "applied", NOW, 1), ("s-1", "note", "ask again", NOW, 2)], ACTION)
    for complete, kept, status in ((True, 10 + 2, "INACTIVE"), (False, 12, "ACTIVE")):
        res, _ = run(spark, first.listings, first.tombstones, SNAP[2:], complete, act)
        got = rows_of(res)
        assert sum(u.startswith("s-") for u in got) == kept
        assert got["s-0"]["status"] == status and got["s-0"]["user_status"] == "applied" and got["s-0"]["applied_at"] == NOW
        assert got["s-1"]["notes"] == "ask again"


def test_too_small_a_snapshot_is_not_trusted(spark, first):
    res, _ = run(spark, first.listings, first.tombstones, SNAP[:5])
    assert sum(u.startswith("s-") for u in rows_of(res)) == 12


def test_trash_leaves_a_tombstone_and_stays_away(spark, first):
    act = spark.createDataFrame([("s-5", "status", "archived", NOW, 1)], ACTION)
    res, _ = run(spark, first.listings, first.tombstones, SNAP, actions=act)
    assert "s-5" not in rows_of(res) and "s-5" in {r["uuid"] for r in res.tombstones.collect()}
    later, _ = run(spark, res.listings, res.tombstones, SNAP)
    assert "s-5" not in rows_of(later)


def test_orphan_keeps_hidden(spark, first):
    # the keeper leaves: its copy must not surface as a new listing
    without = first.listings.where(F.col("uuid") != "f-1")
    results = read_all(spark, [SourceSpec("thin1", lambda s: feed(s, dict(uuid="t-1", business_name="ACME")), thin=True, digest=True)])
    res = refresh(spark, without, first.tombstones, results, None, DEMO_PACK, NOW)
    t = rows_of(res)["t-1"]
    assert t["excluded"] and t["exclusion_reason"].startswith("duplicate of a closed listing")
    assert t["description"] == LONG and t["description_borrowed_from"] == "f-1"


def test_present(first):
    page = present(first.listings, F.lit(NOW), F.lit(dt.datetime(2025, 1, 1)))
    row = page.where(F.col("uuid") == "f-1").collect()[0]
    assert row["href"] == "#" and row["is_new"] and row["band"] in ("high", "mid", "low") and row["days_left"] is None
