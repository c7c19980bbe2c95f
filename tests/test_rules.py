"""Clause engine, figures and single functions on hand-made cases."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from listtide.functions import clauses as C
from listtide.functions import dates, figures, text
from listtide.operators import blocks, scoring
from listtide.operators.pack import DEMO_PACK, DEMO_WORDS, title_blocks_from
from listtide.schema import CATEGORY
from listtide.sources.components import component_text


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v")).alias("r")).collect()[0]["r"]


def test_sections_and_clauses(spark):
    body = "intro 3.5 stars. more; yes\nhouse rules:\n5 years of renting\n\ngood to know:\n" + "\n".join(f"line {i}" for i in range(12)) + "\nversion 2. next"
    got = one(spark, body, lambda c: C.clauses(c, DEMO_WORDS))
    flat = [(x["clause"], x["section"], x["near"]) for x in got]
    assert flat[:4] == [("intro 3.5 stars", None, True), ("more", None, True), ("yes", None, True), ("5 years of renting", "req", True)]
    assert ("line 8", "opt", True) in flat and ("line 9", "opt", False) in flat
    assert flat[-2:] == [("version 2", "opt", False), ("next", "opt", False)]


def test_all_matches_with_their_sides(spark):
    got = one(spark, "aa x bb x cc", lambda c: C.hits(c, "x"))
    assert [(h["before"], h["hit"], h["after"]) for h in got] == [("aa ", "x", " bb x cc"), ("aa x bb ", "x", " cc")]
    assert one(spark, "none here", lambda c: C.hits(c, "x")) == []


@pytest.mark.parametrize("clause, firm", [
    ("you need a permit", True), ("a permit is optional", False), ("a car is optional, and a permit is needed", True),
    ("no permit", False), ("not the bus but a permit", True), ("there is no call for such a permit", False),
    ("a permit (optional abroad, and more) is needed", True), ("without usual old permit", False), ("without many of the usual old permit", True),
])
def test_firm_in_segment(spark, clause, firm):
    assert one(spark, clause, lambda c: F.exists(C.hits(c, "permit"), lambda h: C.firm_in_segment(h, DEMO_WORDS))) is firm


def test_negation_window_of_scoring(spark):
    near, far = "not " + "x" * 30 + " skill", "not " + "x" * 50 + " skill"
    for t, n in ((near, 0), (far, 1), ("skill, not skill", 1), ("skill or the like", 1), ("skill optional", 0)):
        got = one(spark, t, lambda c: F.size(C.firm_hits(C.clauses(c, DEMO_WORDS), "skill", DEMO_WORDS)))
        assert got == n, t


@pytest.mark.parametrize("body, label", [
    ("usd 45 000 - 52 000 per year", "usd 45 000 – 52 000"), ("Salary between 400 000 and 500 000 usd", "usd 400 000 – 500 000"),
    ("$ 45.000 120 bonus", "usd 45 000"), ("Wage 39 000 usd", "usd 39 000"), ("We sold 45 000 books", None), ("", None), ("usd 1 250 000", "usd 1 250 000"),
])
def test_pay(spark, body, label):
    assert one(spark, body, lambda c: figures.pay_text(figures.pay_mention(c))) == label


@pytest.mark.parametrize("raw, iso, shown", [
    ("2025-03-09T10:00:00Z", "2025-03-09", "09.03.2025"), ("9.3.2025", "2025-03-09", "09.03.2025"), ("09-03-2025", "2025-03-09", "09.03.2025"),
    ("as soon as possible", None, "as soon as possible"), ("", None, None), (None, None, None), ("2026-02-31", None, "31.02.2026"),
])
def test_due_dates(spark, raw, iso, shown):
    assert one(spark, raw, lambda c: dates.normalize_due_date(c).cast("string")) == iso
    assert one(spark, raw, dates.format_due) == shown


def test_month_shift_rolls_over(spark):
    for day, want in (("2025-12-31", "2026-03-03"), ("2025-01-15", "2025-03-15"), ("2023-12-30", "2024-03-01")):
        assert one(spark, day, lambda c: dates.plus_months(c.cast("date"), 2).cast("string")) == want


def test_text_functions(spark):
    assert one(spark, "<p>á &eacute;&amp;lt;</p>x  \ty", text.strip_html) == "\ná é&lt;\nx y"
    assert one(spark, "Å", text.normalize_text) == "Å"
    assert one(spark, "java\tscript:alert(1)", text.safe_url) == "#"
    assert one(spark, " HTTPS://x.example ", text.safe_url) == "HTTPS://x.example"
    assert one(spark, "²", text.safe_int) is None
    assert one(spark, "100% A_b", lambda c: text.contains_folded(c, "0% a_B")) is True
    assert one(spark, "100x Aab", lambda c: text.contains_folded(c, "0% a_B")) is False


def test_components_at_any_depth(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":[{"h":"<p>deep</p>"}]}}}}}},"url":"https://x.example/' + "y" * 60 + '","k":"short","l":"' + "w" * 41 + '"}'
    assert one(spark, deep, component_text) == "deep\n " + "w" * 41


ROW = "title string, description string, municipal string, county string, language string, extent_percent int, engagement_type string, uuid string"


def row_frame(spark, *rows):
    base = dict(title="Clerk", description="", municipal=None, county=None, language=None, extent_percent=None, engagement_type=None)
    data = [tuple({**base, **r, "uuid": f"u{i}"}.values()) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ROW).withColumn("occupation_categories", F.lit(None).cast(CATEGORY))


def test_gate_rounds_half_to_even(spark):
    cases = [dict(county="Capital"), dict(language="en", description="First home welcome."), dict(county="Harbour", municipal="Harbour", description="Video viewing.")]
    out = scoring.score(row_frame(spark, *cases), DEMO_PACK).orderBy("uuid").collect()
    # context points 10, 22 and 30: the gate takes 8 (7.5), 16 (16.5) and 22 (22.5)
    assert [r["score_breakdown"]["context_gate"]["points"] for r in out] == [-8, -16, -22]
    for r in out:
        assert r["score"] == max(0, min(100, 10 + sum(e["points"] for e in r["score_breakdown"].values())))


def test_both_profiles_equal_single_passes(spark):
    rows = row_frame(spark, dict(title="Music room", description="Piano with kiln. Must have a parking permit."),
                     dict(title="Garden shed", description="Compost and orchard, video viewing."))
    both = scoring.score(rows, DEMO_PACK).orderBy("uuid").select("score", "score_it").collect()
    single = [scoring.score(rows, DEMO_PACK, (p,)).orderBy("uuid").select(c).collect() for p, c in (("floor", "score"), ("desk", "score_it"))]
    assert [tuple(r) for r in both] == [(a[0], b[0]) for a, b in zip(*single)]


def test_title_shares_the_first_line_with_the_body(spark):
    # Scoring reads title and body as one line, so a heading there is no heading; blocks read the body alone.
    body = "House rules:<br>Parking permit<br>Boiler licence"
    scored = scoring.score(row_frame(spark, dict(description=body)), DEMO_PACK).collect()[0]
    assert scored["score_breakdown"]["licence_penalty"]["points"] == 0
    blocked = blocks.with_blocks(row_frame(spark, dict(description=body)), DEMO_PACK).collect()[0]
    assert blocked["exclusion_reason"] == DEMO_PACK.certificate_reason


def test_section_reach_in_blocks(spark):
    near = "Good to know:<br>" + "filler<br>" * 8 + "Board vetting"
    far = "Good to know:<br>" + "filler<br>" * 9 + "Board vetting"
    out = blocks.with_blocks(row_frame(spark, dict(description=near), dict(description=far)), DEMO_PACK).orderBy("uuid").collect()
    assert [r["excluded"] for r in out] == [False, True]


def test_title_rules_from_a_table(spark):
    rules = spark.createDataFrame([("p", "t1", "title", r"\bbaker\b", 2, "food"), ("p", "t2", "title", r"\bpilot\b", 1, "air"), ("q", "t3", "title", "x", 1, "no")],
                                  "pack string, rule_id string, scope string, pattern string, ord int, reason string")
    pack = replace(DEMO_PACK, title_blocks=title_blocks_from(rules, "p"))
    out = blocks.with_blocks(row_frame(spark, dict(title="Baker and pilot"), dict(title="Baker")), pack).orderBy("uuid").collect()
    assert [r["exclusion_reason"] for r in out] == ["air", "food"]


def test_patterns_with_known_stretches_decide_as_without(spark):
    """A pattern's needles only spare the match; a pattern put together from another one forgets them."""
    from listtide.functions import keywords as K
    from listtide.operators.pack import phrases
    p = phrases("parking permit", "bank reference")
    assert K.needles(p) == ("parking permit", "bank reference") and K.needles(K.unicode(p)) == K.needles(p)
    assert K.needles("(?i)" + p) == () and K.needles(phrases(r"no\w+")) == () and K.needles(K.either([p, "x+"])) == ()
    texts = ["a parking permit", "a parking permits", "Bank reference", "bank  reference", "", None, "no bank reference."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(K.mentions(F.col("t"), K.unicode(p)).alias("a"), F.col("t").rlike("(?U)" + p).alias("b"),
                     F.coalesce(~K.may_match(F.col("t"), p) & F.col("t").rlike(p), F.lit(False)).alias("lost")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and not any(r.lost for r in rows)
