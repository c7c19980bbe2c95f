"""Listing pages, merges, retention, actions, snapshots, versions, streams, health and readers on small fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from listtide.operators import actions as A
from listtide.operators import health, lifecycle, merge, regress
from listtide.operators import listing as L
from listtide.schema import ACTION, USER_STATUSES
from listtide.sources import digest as D
from listtide.sources import feeds as S
from listtide.sources.runs import run_rows
from listtide.sources.versions import VersionedTable
from listtide.streaming import ingest

NOW = dt.datetime(2025, 6, 1, 12, 0)


def listing_rows(spark, n=400, seed=1):
    rnd = random.Random(seed)
    data = [(f"u{i:04d}", "ACTIVE", "new", f"2025-0{rnd.randrange(1, 10)}-01" if rnd.random() < .9 else None, rnd.choice([None, 10, 20, 30]),
             rnd.randrange(100), None if rnd.random() < .3 else dt.date(2025, 1, rnd.randrange(1, 9))) for i in range(n)]
    df = spark.createDataFrame(data, "uuid string, status string, user_status string, published string, score int, score_it int, application_due_sort date")
    for c in L.LIST_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("timestamp" if c.endswith("_at") else "string"))
    return data, df.withColumn("excluded", F.lit(False))


@pytest.mark.parametrize("sort", ["score", "deadline"])
def test_pages_cover_the_list_once(spark, sort):
    data, df = listing_rows(spark)
    if sort == "score":
        key = lambda r: (r[4] is None, -(r[4] or 0), r[3] is None, tuple(-ord(ch) for ch in r[3] or ""), r[0])
    else:
        key = lambda r: (r[6] is None, r[6] or dt.date.max, r[0])
    want = [r[0] for r in sorted(data, key=key)]
    q = L.ListingQuery(sort=sort)
    for number in (1, 4, 8, 99):
        k = min(number, 8)
        assert [r["uuid"] for r in L.page(df, q, number).collect()] == want[(k - 1) * 50:k * 50]


def test_profile_and_status_are_checked():
    with pytest.raises(ValueError):
        L.score_column("nobody")
    with pytest.raises(ValueError):
        S.within_lookback(None, None, 90, 60)


def test_count_and_list_share_the_predicate(spark):
    _, df = listing_rows(spark)
    q = L.ListingQuery(min_score=20)
    assert L.count_matching(df, q).collect()[0]["n"] == L.matching(df, q).count()


def test_merge_policies(spark):
    schema = "uuid string, status string, business_name string, description string, application_due string, application_due_sort date, language string, manually_added boolean, user_status string"
    day = dt.date(2025, 1, 1)
    old = spark.createDataFrame([("a", "ACTIVE", "Acme", "text", "2025-01-01", day, "en", True, "applied"), ("b", "ACTIVE", "Beta", None, "2025-01-01", day, None, False, "new")], schema)
    new = spark.createDataFrame([("a", "INACTIVE", None, None, "", None, None, False, "new"), ("b", "ACTIVE", "B2", "fresh", "running", None, "de", False, "new"),
                                 ("c", "ACTIVE", "C", None, None, None, None, False, None)], schema)
    got = {r["uuid"]: r for r in merge.merge(old, new, merge.PARTIAL, defaults={"user_status": "new"}).collect()}
    assert tuple(got["a"])[1:9] == ("INACTIVE", "Acme", "text", "2025-01-01", day, "en", True, "applied")
    assert tuple(got["b"])[1:9] == ("ACTIVE", "B2", "fresh", "running", None, "de", False, "new")
    assert got["c"]["user_status"] == "new" and got["c"]["_outcome"] == "new"
    twice = merge.merge(merge.merge(old, new, merge.PARTIAL).drop("_outcome"), new, merge.PARTIAL).drop("_outcome")
    assert sorted(map(str, twice.collect())) == sorted(map(str, merge.merge(old, new, merge.PARTIAL).drop("_outcome").collect()))


@pytest.mark.parametrize("seen, complete, closed", [(20, True, 0), (10, True, 10), (9, True, 0), (0, True, 0), (12, False, 0)])
def test_snapshot_guards(spark, seen, complete, closed):
    rows = spark.createDataFrame([(f"u{i}", "s", "ACTIVE") for i in range(20)] + [("x", "other", "ACTIVE")], "uuid string, source string, status string")
    keys = spark.createDataFrame([(f"u{i}",) for i in range(seen)], "uuid string")
    out = merge.deactivate_missing(rows, keys, spark.createDataFrame([(complete,)], "complete boolean"), "s")
    assert out.where("status = 'INACTIVE'").count() == closed and out.count() == 21


def test_few_rows_may_all_go(spark):
    rows = spark.createDataFrame([(f"u{i}", "s", "ACTIVE") for i in range(9)], "uuid string, source string, status string")
    out = merge.deactivate_missing(rows, spark.createDataFrame([("new",)], "uuid string"), spark.createDataFrame([(True,)], "complete boolean"), "s")
    assert out.where("status = 'INACTIVE'").count() == 9


def test_absent_rows_go_only_after_a_full_parse(spark):
    rows = spark.createDataFrame([("a", "s", "new"), ("b", "s", "new"), ("c", "s", "applied"), ("d", "o", "new")], "uuid string, source string, user_status string").selectExpr(
        "*", "cast(null as timestamp) flagged_at", "cast(null as string) notes", "false manually_added")
    seen = spark.createDataFrame([("a",), (None,)], "uuid string")
    for parsed, left in ((3, ["a", "c", "d"]), (2, ["a", "b", "c", "d"])):
        parse = spark.createDataFrame([(1, 3, parsed)], "messages long, cards long, parsed long")
        assert sorted(r[0] for r in merge.retire_absent(rows, seen, parse, "s", lifecycle.never_shown_by_user()).select("uuid").collect()) == left


def test_retention_exemptions(spark):
    base = [(f"{s}-{f}-{n}-{m}", s, dt.datetime(2025, 1, 1) if f else None, n, bool(m), "INACTIVE", dt.datetime(2025, 1, 1), dt.date(2025, 1, 1), "thin")
            for s in USER_STATUSES for f in (0, 1) for n in (None, "", "x") for m in (0, 1)]
    df = spark.createDataFrame(base, "uuid string, user_status string, flagged_at timestamp, notes string, manually_added boolean, status string, first_seen_at timestamp, application_due_sort date, source string")
    now = F.lit(NOW).cast("timestamp")
    touched = {r[0] for r in base if r[1] != "new" or r[2] or r[3]}
    for rule in (lifecycle.inactive_untouched(), lifecycle.past_due_untouched(now)):
        assert {r["uuid"] for r in lifecycle.keep(df, rule).collect()} == touched
    stale = lifecycle.stale_digest(now, ["thin"])
    assert {r["uuid"] for r in lifecycle.keep(df, stale).collect()} == touched | {r[0] for r in base if r[4]}


def test_fold_equals_replay_in_any_split(spark):
    rnd = random.Random(4)
    log = []
    for i in range(300):
        field = rnd.choice(["status", "flag", "note", "profile"])
        value = {"status": rnd.choice(USER_STATUSES + ("bogus",)), "flag": rnd.choice("01"), "note": rnd.choice(["", "n1", "n2"]), "profile": "desk"}[field]
        log.append((f"u{rnd.randrange(12)}", field, value, NOW + dt.timedelta(minutes=rnd.randrange(50)), i))
    want = {}
    for u, field, v, ts, _ in sorted(log, key=lambda r: (r[3], r[4])):
        w = want.setdefault(u, {"s": None, "a": None, "f": None, "n": None})
        if field == "status" and v in USER_STATUSES:
            w["s"] = v
            w["a"] = ts if v == "applied" else w["a"]
        elif field == "flag":
            w["f"] = ts if v == "1" else None
        elif field == "note":
            w["n"] = v or None
    df = spark.createDataFrame(log, ACTION)
    halves = A.compact(A.compact(df.where("seq % 2 = 0")).unionByName(A.compact(df.where("seq % 2 = 1"))))
    for frame in (df, halves):
        got = {r["uuid"]: {"s": r["user_status"], "a": r["applied_at"], "f": r["flagged_at"], "n": r["notes"]} for r in A.fold(frame).collect()}
        assert got == want


def test_failed_attempts_reset_on_success(spark, no_broadcast):
    t = lambda m: NOW + dt.timedelta(minutes=m)
    log = [("a", t(1), "failed"), ("a", t(2), "failed"), ("a", t(3), "ok"), ("a", t(4), "failed"), ("b", t(1), "failed"), ("b", t(2), "failed"), ("b", t(3), "failed"),
           *[("hot", t(i), "failed") for i in range(40)]]
    got = {r["uuid"]: (r["failures"], r["give_up"]) for r in A.failed_attempts(spark.createDataFrame(log, "uuid string, ts timestamp, outcome string")).collect()}
    assert got == {"a": (1, False), "b": (3, True), "hot": (40, True)}


def test_percentiles_against_bisect(spark):
    import bisect
    rnd = random.Random(9)
    rows = [(f"u{i}", rnd.randrange(101), rnd.random() < .8) for i in range(300)]
    pop = sorted(s for _, s, v in rows if v)
    out = regress.percentiles(spark.createDataFrame(rows, "uuid string, score int, visible boolean"), "score", F.col("visible")).collect()
    assert {r["uuid"]: round(r["percentile"], 9) for r in out} == {u: round(100 * bisect.bisect_left(pop, s) / len(pop), 9) for u, s, _ in rows}


# ---- files -------------------------------------------------------------------------------------------------

def test_versions_count_only_when_committed(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(4):
        t.write(spark.range(i + 1), keep=2)
    assert t.versions() == [3, 4] and t.read().count() == 4
    (tmp_path / "t" / "v=000004" / "_SUCCESS").unlink()
    assert t.versions() == [3] and t.read().count() == 3
    assert t.write(spark.range(9), keep=2) == 5 and t.read().count() == 9


def page(seq, *entries):
    return json.dumps({"id": f"p{seq}", "seq": seq, "next_id": f"p{seq + 1}", "items": [{"_feed_entry": e} for e in entries]})


def test_changelog_stream_equals_batch_and_replays(spark, tmp_path):
    land, out = tmp_path / "land", VersionedTable(spark, str(tmp_path / "table"))
    land.mkdir()
    e = lambda u, s, st: {"uuid": u, "status": s, "title": "t", "sistEndret": st}
    (land / "1.json").write_text(page(1, e("a", "ACTIVE", "1"), e("b", "ACTIVE", "1"), e("a", "INACTIVE", "2"), None, {"uuid": "x"}))
    stones = spark.createDataFrame([("z", NOW)], "uuid string, dismissed_at timestamp")
    ck = str(tmp_path / "ck")
    ingest.run_changelog(spark, str(land), ck, out, stones)
    (land / "2.json").write_text(page(2, e("b", "INACTIVE", "3"), e("z", "ACTIVE", "3"), e("c", "ACTIVE", "3")))
    ingest.run_changelog(spark, str(land), ck, out, stones)
    n = len(out.versions())
    ingest.run_changelog(spark, str(land), ck, out, stones)           # nothing unread
    assert len(out.versions()) == n
    state = {r["uuid"]: r["status"] for r in out.read().collect()}
    assert state == {"a": "INACTIVE", "b": "INACTIVE", "c": "ACTIVE"}
    old = S.changelog_entries(S.read_changelog(spark, str(land / "1.json")))
    ingest.merge_changelog_batch(out, old, stones)                     # a page sent again changes nothing
    assert {r["uuid"]: r["status"] for r in out.read().collect()} == state
    everything = S.changelog_entries(S.read_changelog(spark, str(land)))
    assert everything.where("malformed").count() == 2
    assert {r["uuid"]: r["status"] for r in S.latest_entries(everything).collect() if r["uuid"] != "z"} == state


def test_fresh_entries_drop_repeats(spark, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    rows = [("a", "1", NOW), ("a", "1", NOW + dt.timedelta(hours=1)), ("a", "2", NOW), ("b", "1", NOW)]
    df = spark.createDataFrame(rows, "uuid string, stamp string, ts timestamp")
    df.write.parquet(src)
    q = (ingest.fresh_entries(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("fresh")
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.sql("SELECT uuid, stamp FROM fresh").distinct().count() == spark.sql("SELECT * FROM fresh").count() == 3


def test_postal_register_with_undefined_bytes(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes("1\tKåfjord\t10\tOne\n2\tKåfjord\t11\tTwo\n3\t€ \x80\t12\tThree\n".encode("cp1252", errors="replace") + b"4\tB\x81d\t13\tFour\n5\t\t1\tX\n")
    got = {r["place"]: r["municipality"] for r in S.read_postal(spark, str(tmp_path / "p.txt")).collect()}
    assert got == {"KÅFJORD": "TWO", "€ ?": "THREE", "B�D": "FOUR"}


def test_regions(spark, tmp_path):
    from listtide.operators import places
    (tmp_path / "r.json").write_text(json.dumps([{"name": "City", "municipality": []}, {"name": "North", "municipality": [{"name": "Tromsø - Romsa"}, {"name": "Alta"}]}]))
    m = places.region_map(S.read_regions(spark, str(tmp_path / "r.json")))
    assert {r["place"]: r["region"] for r in m.collect()} == {"CITY": "City", "TROMSØ": "North", "ROMSA": "North", "ALTA": "North"}
    postal = spark.createDataFrame([("FJORD", "ALTA"), ("ALTA", "CITY"), ("NOPE", "UNKNOWN")], "place string, municipality string")
    assert {r["place"]: r["region"] for r in places.with_postal(m, postal).collect()}["FJORD"] == "North"
    assert places.with_postal(m, postal).count() == 5


TAIL = D.DigestFormat("a", "More details:", r"(https://board\.example\.com/\d+)", "tail")
FRONT = D.DigestFormat("b", "View listing:", r"https://net\.example\.com/view/(\d+)", "front", noise=(r"^Your alert", r"new listings$"))


def test_digest_tail(spark, tmp_path):
    rule = "-" * 30
    (tmp_path / "m1.txt").write_text(f"Hello\n\nCook\nInn, Main Street, Oslo\nMore details: https://board.example.com/1\n{rule}\n,Driver\nKiwi\nMore details: https://board.example.com/2\n"
                                     f"{rule}\nClerk\n,\nShop, Bergen\nMore details: https://board.example.com/3\n{rule}\nMore details: lost\n{rule}\nFooter")
    mails = D.read_digests(spark, str(tmp_path))
    got = {r["link"][-1]: (r["title"], r["employer"], r["location"]) for r in D.cards(mails, TAIL).collect()}
    assert got == {"1": ("Cook", "Inn, Main Street", "Oslo"), "2": ("Driver", "Kiwi", None), "3": ("Clerk", "Shop", "Bergen")}
    r = D.parse_warning(D.parse_report(mails, TAIL)).collect()[0]
    assert (r["messages"], r["cards"], r["parsed"]) == (1, 4, 3) and r["warning"].startswith("1 of 4")


def test_digest_front(spark):
    rule = "-" * 40
    text = (f"Your alert for cook\n3 new listings\nCook - Inn - due 1 May\nInn\nOslo, Norway\nactively hiring\nView listing: https://net.example.com/view/77?x\n{rule}\n"
            f"Only two\nlines\nView listing: https://net.example.com/view/78\n{rule}\nno marker")
    got = D.cards(spark.createDataFrame([("m", text)], "message string, text string"), FRONT).collect()
    assert [(r["title"], r["employer"], r["location"], r["link"]) for r in got] == [("Cook", "Inn", "Oslo, Norway", "77")]


def test_snapshot_completeness(spark):
    job = "named_struct('id', 1L, 'title', 't', 'employer', 'e', 'location', 'l', 'summary', 's', 'link', 'x', 'deadline', '01.02.2025', 'jobDuration', 'd', 'jobScope', 'j', 'isInternal', false)"
    full = spark.range(2).selectExpr("cast(id + 1 as int) page", f"array_repeat({job}, 3) jobs")
    short = full.unionByName(spark.range(1).selectExpr("3 page", f"array_repeat({job}, 2) jobs"))
    assert S.snapshot_completeness(full, 3).collect()[0]["complete"] is False
    assert tuple(S.snapshot_completeness(short, 3).collect()[0]) == (3, 8, True)


# ---- health ------------------------------------------------------------------------------------------------

CONFIG = health.HealthConfig(order=("feed", "snap", "mail"), freshness={"feed": (1.5, 3), "mail": (3, 7)}, data_loss=("mail",), changelog="feed", snapshot="snap")


def issues(spark, stats, now=NOW, ages=(), **kw):
    runs = run_rows(spark, 1, dt.datetime(2025, 5, 1), {"feed": {"new": 1}}).unionByName(run_rows(spark, 2, NOW, stats, **kw))
    rows = spark.createDataFrame([(s, NOW - dt.timedelta(days=d)) for s, d in ages] or [("none", NOW)], "source string, first_seen_at timestamp")
    return [(r["source"], r["level"], r["rule"]) for r in health.evaluate(runs, rows, F.lit(now).cast("timestamp"), CONFIG).collect()]


def test_health_rules(spark):
    assert issues(spark, {"feed": {"new": 3}}) == []
    assert issues(spark, {"feed": {}}, now=NOW + dt.timedelta(days=3)) == [("run", "warn", "H1")]
    assert issues(spark, {"feed": {}}, stage_errors=[("rescore", "x")]) == [("run", "bad", "H2")]
    assert issues(spark, {"mail": {"messages": 0}}, errors={"mail": "down"}, warnings={"mail": "w"}) == [("mail", "bad", "H3")]
    assert issues(spark, {"feed": {}, "mail": {}}, warnings={"feed": "w", "mail": "w"}) == [("mail", "bad", "H4"), ("feed", "warn", "H4")]
    assert issues(spark, {"feed": {"degraded": 1, "detail_errors": 4}}) == [("feed", "warn", "H5")]
    assert issues(spark, {"snap": {"fetched": 0}}) == [("snap", "bad", "H6")]
    assert issues(spark, {"snap": {"fetched": 70, "marked_inactive": 30}}) == []
    assert issues(spark, {"snap": {"fetched": 69, "marked_inactive": 31}}) == [("snap", "warn", "H6")]
    assert issues(spark, {"mail": {"messages": 0}}, ages=[("mail", 9)]) == [("mail", "bad", "H7")]
    assert issues(spark, {"mail": {"messages": 1}, "feed": {}}, ages=[("mail", 9), ("feed", 2)]) == [("mail", "bad", "H8"), ("feed", "warn", "H8")]
