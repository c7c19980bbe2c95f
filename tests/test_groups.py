"""Group passes against brute force in plain Python, with a hot ambiguous key and shuffled input."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from listtide.operators import groups, lending, skew
from listtide.schema import USER_STATUSES

ORDER = ["full1", "full2", "thin1"]
SOURCES = ORDER + ["other"]


def make_rows(seed=1, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        excluded = rnd.random() < 0.2
        rows.append((
            f"u{i:04d}", "hot" if hot else f"k{rnd.randrange(160)}", rnd.choice(SOURCES), rnd.choice(USER_STATUSES + ("new",) * 6),
            excluded, (f"why {i}" if rnd.random() < 0.8 else None) if excluded else None, rnd.randrange(5), rnd.randrange(5),
            "ACTIVE" if rnd.random() < 0.9 else "INACTIVE"))
    return rows


SCHEMA = ("uuid string, k string, source string, user_status string, excluded boolean, exclusion_reason string, "
          "score int, score_it int, status string")


def brute_settle(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(dict(zip(("uuid", "k", "source", "user_status", "excluded", "why", "score", "score_it"), r)))
    out = {}
    for g in by.values():
        src = [m["source"] for m in g]
        if len(set(src)) < 2 or len(set(src)) != len(src):
            continue
        donors = sorted((m for m in g if m["user_status"] != "new"),
                        key=lambda m: (groups.STATUS_FILL_ORDER.index(m["user_status"]), m["uuid"]))
        for m in g:
            if m["user_status"] == "new" and donors:
                m["filled"] = donors[0]["user_status"]
        blocked = sorted((m for m in g if m["excluded"] and m["why"]), key=lambda m: m["uuid"])
        for m in g:
            if not m["excluded"] and blocked:
                m["excluded"], m["why"] = True, blocked[0]["why"]
        live = sorted((m for m in g if not m["excluded"]), key=lambda m: (
            -max(m["score"], m["score_it"]), ORDER.index(m["source"]) if m["source"] in ORDER else 99, m["uuid"]))
        for m in live[1:]:
            m["excluded"], m["why"] = True, f"duplicate: the same listing is shown from source {live[0]['source']}"
        for m in g:
            out[m["uuid"]] = (m.get("filled", m["user_status"]), m["excluded"], m["why"])
    return out


def test_settle_equals_brute_force_in_any_order(spark, no_broadcast):
    rows = make_rows()
    want = brute_settle(rows)
    for seed in (None, 5):
        data = list(rows)
        if seed:
            random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, SCHEMA).repartition(seed or 1)
        got = {r["uuid"]: (r["user_status"], r["excluded"], r["exclusion_reason"]) for r in groups.settle(df, ["k"], ORDER).collect()}
        assert got == want and want
        visible = defaultdict(int)
        for r in rows:
            if r[0] in got and not got[r[0]][1]:
                visible[r[1]] += 1
        assert max(visible.values()) == 1  # one visible row per group at most


def test_settle_is_stable_on_its_own_output(spark):
    df = spark.createDataFrame(make_rows(3), SCHEMA)
    once = groups.settle(df, ["k"], ORDER)
    changed = df.drop("user_status", "excluded", "exclusion_reason", "score", "score_it", "source").join(once, "uuid")
    # A scoring pass starts from the rules again, so duplicate marks are not input of the next pass.
    dup = F.coalesce(F.startswith("exclusion_reason", F.lit(groups.DUPLICATE_PREFIX)), F.lit(False))
    changed = changed.withColumn("excluded", F.col("excluded") & ~dup).withColumn("exclusion_reason", F.when(~dup, F.col("exclusion_reason")))
    again = groups.settle(changed, ["k"], ORDER)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def brute_actions(rows, acts):
    state = {}
    for uuid, status, _ in sorted(acts, key=lambda a: a[2]):
        row = next((r for r in rows if r[0] == uuid), None)
        if row is None:
            continue
        same = [r for r in rows if r[8] == "ACTIVE" and r[0] != uuid and r[1] == row[1]]
        src = [row[2]] + [r[2] for r in same]
        twins = same if len(src) >= 2 and len(set(src)) == len(src) else []
        for u in [uuid] + [r[0] for r in twins]:
            state[u] = status
    return state


def test_actions_reach_copies(spark, no_broadcast):
    rows = make_rows(7)
    rnd = random.Random(2)
    acts = [(f"u{rnd.randrange(650):04d}", rnd.choice(USER_STATUSES), i) for i in range(150)]
    got = groups.spread_actions(spark.createDataFrame(rows, SCHEMA), ["k"], spark.createDataFrame(acts, "uuid string, status string, seq long"))
    assert {r["uuid"]: r["user_status"] for r in got.collect()} == brute_actions(rows, acts)


def test_one_action_counts_its_rows(spark):
    rows = spark.createDataFrame([("a", "k", "s1", "new", False, None, 1, 1, "ACTIVE"), ("b", "k", "s2", "applied", False, None, 1, 1, "ACTIVE"),
                                  ("c", "x", "s1", "new", False, None, 1, 1, "ACTIVE")], SCHEMA)
    assert groups.set_status_with_copies(rows, ["k"], "a", "new").count() == 2
    assert groups.set_status_with_copies(rows, ["k"], "c", "offer").count() == 1
    assert groups.set_status_with_copies(rows, ["k"], "zz", "offer").count() == 0


def test_orphans_stay_hidden(spark):
    rows = spark.createDataFrame([
        ("a", "k1", "s1", "new", False, None, 1, 1, "ACTIVE"), ("b", "k2", "s1", "new", False, None, 1, 1, "ACTIVE"),
        ("c", "k2", "s2", "new", False, None, 1, 1, "ACTIVE"), ("d", "k3", "s1", "new", True, "x", 1, 1, "ACTIVE"),
        ("e", "k4", "s1", "new", False, None, 1, 1, "ACTIVE")], SCHEMA)
    was = spark.createDataFrame([("a",), ("b",), ("d",)], "uuid string")
    assert [r[0] for r in groups.orphaned_duplicates(rows, ["k"], was).collect()] == ["a"]


def test_lookup_is_exact_with_hot_and_null_keys(spark, no_broadcast):
    big = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 40}") for i in range(500)]
    dim = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)]
    b = spark.createDataFrame(big, "id long, k string")
    d = spark.createDataFrame(dim, "k string, v int")
    out = skew.lookup(b, d, ["k"], ["id"])
    want = dict(dim)
    assert {(r["id"], r["k"], r["v"]) for r in out.collect()} == {(i, k, want.get(k)) for i, k in big}
    assert out.count() == 500
    inner = skew.lookup(b, d, ["k"], ["id"], "inner")
    assert inner.count() == sum(k in want for _, k in big)


LEND = "uuid string, k string, source string, description string, description_borrowed_from string"


def test_borrowing(spark):
    long, longer, short = "x" * 210, "y" * 230, "z" * 20
    rows = [
        ("f1", "a", "full2", longer, None), ("f2", "a", "full1", long, None), ("f3", "a", "full1", long, None), ("t1", "a", "thin", None, None),
        ("f4", "b", "full1", short, None), ("t2", "b", "thin", "old", "gone"), ("t3", "c", "thin", "own text", None),
        ("t4", "a", "thin", "own text", None), ("t5", "d", "thin", None, None), ("o1", "a", "other", None, None)]
    for data in (rows, rows[::-1]):
        out = lending.borrow(spark.createDataFrame(data, LEND), ["k"], ["thin"], ["full1", "full2"], F.trim("description"))
        got = {r["uuid"]: (r["description"], r["description_borrowed_from"], r["_borrowed"]) for r in out.collect()}
        assert got["t1"] == (long, "f2", True)          # preferred source before longer text, then the smallest id
        assert got["t2"] == ("old", "gone", False)      # lender lost: the earlier borrow stays
        assert got["t3"] == got["t4"] == ("own text", None, False)
        assert got["t5"][:2] == (None, None) and got["o1"][:2] == (None, None)
        assert got["f4"] == (short, None, False)


def test_borrowing_with_hot_key(spark, no_broadcast):
    rows = [("f", "hot", "full1", "x" * 300, None)] + [(f"t{i}", "hot" if i % 2 else f"k{i}", "thin", None, None) for i in range(200)]
    out = lending.borrow(spark.createDataFrame(rows, LEND), ["k"], ["thin"], ["full1"], F.trim("description"))
    assert out.count() == 201 and out.where(F.col("description_borrowed_from") == "f").count() == 100


def test_sides_that_grow_are_not_broadcast(spark):
    """However small the files of a row-level side are, it does not go through the driver."""
    from listtide.operators import actions
    rows = spark.createDataFrame([("a", "new", None, None, None)], "uuid string, user_status string, applied_at timestamp, flagged_at timestamp, notes string")
    log = spark.createDataFrame([("a", "status", "applied", None, 1)], "uuid string, field string, value string, ts timestamp, seq long")
    out = actions.apply_actions(rows, log)
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    assert [r.user_status for r in out.collect()] == ["applied"]
