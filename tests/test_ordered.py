"""Deep pages and running sums against plain ordering."""

import datetime as dt
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from listtide.functions import clauses as C
from listtide.functions import figures
from listtide.operators import ordered, regress


def rows_of(kind, n, rng):
    day = dt.datetime(2026, 1, 1)
    score = {"equal": lambda k: 7, "few": lambda k: rng.choice([None, 1, 2]), "many": lambda k: rng.randrange(10**9)}[kind]
    return [(score(k), rng.choice([None, day + dt.timedelta(hours=rng.randrange(5))]), f"u{k:05d}") for k in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("kind", ["equal", "few", "many"])
def test_narrowed_pages(spark, kind):
    rng = random.Random(kind)
    rows = rows_of(kind, 3000, rng)
    df = spark.createDataFrame(rows, "score long, published timestamp, uuid string").repartition(6)
    keys = [ordered.SortKey("score", True), ordered.SortKey("published", True), ordered.SortKey("uuid")]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, -(r[1].timestamp() if r[1] else 0), r[2]))
    for start in (0, 1490, 2950, 2999):
        part, at = ordered.narrowed(df, keys, start, 20, 3000, 60)
        assert part.count() <= 60 and at + 20 <= 80
        got = part.orderBy(*[k.order() for k in keys]).offset(at).limit(20).collect()
        assert [tuple(r) for r in got] == want[start:start + 20]


def test_narrowed_equal_rows_end(spark):
    df = spark.createDataFrame([(1, "a")] * 500 + [(0, "b")], "score long, uuid string")
    part, at = ordered.narrowed(df, [ordered.SortKey("score", True), ordered.SortKey("uuid")], 499, 2, 501, 6)
    assert [r.uuid for r in part.orderBy(F.desc("score"), "uuid").offset(at).limit(2).collect()] == ["a", "b"]


def test_before_is_the_order(spark):
    points = [(s, t) for s in (None, 1, 2) for t in (None, "a", "b")]
    df = spark.createDataFrame(points, "score long, uuid string")
    keys = [ordered.SortKey("score", True), ordered.SortKey("uuid")]
    rank = {p: i for i, p in enumerate(tuple(r) for r in df.orderBy(*[k.order() for k in keys]).collect())}
    for p in points:
        got = {(r.score, r.uuid): r.x for r in df.withColumn("x", ordered.before(keys, p)).collect()}
        assert got == {q: rank[q] < rank[p] for q in points}


@pytest.mark.parametrize("per_task", [None, "100"])
def test_running_sum(spark, per_task):
    if per_task:
        spark.conf.set("listtide.rows_per_task", per_task)
    try:
        values = [(k, k % 7) for k in random.Random(4).sample(range(5000), 1000)]
        out = ordered.running_sum(spark.createDataFrame(values, "k long, v long"), "k", "v", "below", "total")
        ordered_values = sorted(values)
        below = dict(zip((k for k, _ in ordered_values), itertools.accumulate((v for _, v in ordered_values), initial=0)))
        total = sum(v for _, v in values)
        got = {r.k: (r.below, r.total) for r in out.collect()}
        assert got == {k: (below[k], total) for k in below}
    finally:
        spark.conf.unset("listtide.rows_per_task")


def test_percentiles_of_as_many_scores_as_rows(spark):
    spark.conf.set("listtide.rows_per_task", "50")
    try:
        df = spark.range(400).select((F.col("id") * 37 % 1009).alias("score"), (F.col("id") % 3 > 0).alias("visible"))
        out = regress.percentiles(df, "score", F.col("visible"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [" not in plan or "_range" in plan
        rows = out.collect()
        seen = [r.score for r in rows if r.visible]
        assert all(abs(r.percentile - 100 * sum(s < r.score for s in seen) / len(seen)) < 1e-9 for r in rows)
    finally:
        spark.conf.unset("listtide.rows_per_task")


def test_many_figures_in_one_text(spark):
    """Work for a match is bounded: a text of 20,000 figures takes seconds, start-up included."""
    text = "salary " + "x 1234 " * 20_000 + "usd 45 000 - 50 000"
    df = spark.createDataFrame([(text,)], "t string")
    run = lambda n: df.select(figures.pay_text(figures.pay_mention(F.col("t"))).alias("p"), F.lit(n)).first().p
    run(0)
    start = time.perf_counter()
    assert run(1) == "usd 45 000 – 50 000"
    assert time.perf_counter() - start < 4


def test_sides_of_a_match_are_cut(spark):
    text = "a" * 50 + "HIT" + "b" * 50 + "HIT" + "c" * 5
    got = spark.createDataFrame([(text,)], "t string").select(C.hits(F.col("t"), "HIT", 10, 7).alias("h")).first().h
    assert [tuple(h) for h in got] == [("a" * 10, "HIT", "b" * 7), ("b" * 10, "HIT", "c" * 5)]
    near = spark.createDataFrame([("xHxHxHx",)], "t string").select(C.hits(F.col("t"), "H", 4, 4).alias("h")).first().h
    assert [(h.before, h.after) for h in near] == [("x", "xHxH"), ("xHx", "xHx"), ("HxHx", "x")]
