"""R and B: scoring and blocking of adverts rendered from the orders.

Each sentence of an advert is chosen by a column of the order, so the expected verdict follows in SQL from the
same columns without any text matching: an independent check of the clause rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...operators import blocks, scoring
from ...operators.pack import DEMO_PACK
from ...schema import CATEGORY
from ...session import SHARE, spread
from .base import TAGS_SQL, decoded_sql, flag, query, table


def selectors() -> tuple[Column, Column, Column, Column]:
    """Customer key, order key, priority, and the id of the advert."""
    key = F.col("o_orderkey")
    return F.col("o_custkey"), key, F.col("o_orderpriority"), F.concat(F.lit("ord-"), F.lpad(key.cast("string"), 9, "0"))


TITLES = {"1-URGENT": "Garden shed", "2-HIGH": "Music room", "3-MEDIUM": "Grand loft residence",
          "4-NOT SPECIFIED": "Storage unit", "5-LOW": "Starter bunk"}


def pick(sel: Column, *texts: str, other: str = "") -> Column:
    out = None
    for i, t in enumerate(texts):
        out = F.when(sel == i, F.lit(t)) if out is None else out.when(sel == i, F.lit(t))
    return out.otherwise(F.lit(other))


def adverts(spark, sf) -> DataFrame:
    o = spread(table(spark, sf, "orders"), SHARE)
    C, K, PR, UUID = selectors()
    title = F.lit("")
    for p, t in TITLES.items():
        title = F.when(PR == p, F.lit(t)).otherwise(title)
    sentences = F.concat_ws(
        " ", F.lit("Welcome."),
        pick(C % 4, "We share compost and orchard.", "Piano and rehearsal space with kiln and loom.",
             "First floor with a shared cellar.", "Guest nights only."),
        pick(K % 4, "Video viewing possible.", "There is not video viewing yet."),
        pick(K % 7, "At least 5 years of renting.", "Not 5 years of renting but curiosity.", "2-6 years of renting.",
             "This house has seen 20 years of renting to all.", "No more than 3 years of renting.", "Three years of renting.",
             "Many years of renting."),
        pick(C % 6, "A parking permit is optional.", "You must have a parking permit.", "", "",
             "Parking permit or the like is expected."),
        pick(C % 5, "You will look after tenants.", "No need to look after tenants.", "To look after tenants is optional."),
        pick(K % 3, "Italian spoken at home is expected.", "Italian spoken at home is optional."),
        pick(C % 8, "Guarantor letter."), pick(C % 9, "Some agency fee."),
        pick(K % 5, "Must have a tenancy certificate.", "Must have a tenancy certificate in music.",
             "A tenancy certificate is optional.", "Tenancy certificate."),
        pick(C % 7, "Flat share background wanted.", "Flat share background is optional."),
        pick(K % 6, "First home welcome."), pick(K % 8, "", "The let runs for a full year."))
    body = F.concat(
        F.lit("<p>"), sentences, F.lit("</p><h3>House rules:</h3><ul><li>"),
        pick(C % 6, "Good mood", "Good mood", "Parking permit", other="Good mood"),
        F.lit("</li></ul><h3>Good to know:</h3><ul><li>"),
        pick(C % 6, "Coffee", "Coffee", "Coffee", "Parking permit", other="Coffee"), F.lit("</li></ul>"))

    def cat(*pairs: tuple[str, str]) -> Column:
        return F.array(*[F.struct(F.lit(a).alias("level1"), F.lit(b).alias("level2")) for a, b in pairs]).cast(CATEGORY)

    cats = (F.when(C % 11 == 0, cat(("Plot", "Field"))).when(C % 11 == 1, cat(("Plot", "Field"), ("Barn", "Loft")))
            .when(C % 11 == 2, cat(("Studio", "Sound"))).when(C % 11 == 3, cat(("Studio", "Sound"), ("Plot", "Field")))
            .when(C % 11 == 4, cat(("Office", "Desk"))).when(C % 11 == 5, cat(("Office", "Desk"), ("Parking", "Deck"))))
    return o.select(
        UUID.alias("uuid"), F.concat(title, F.when(K % 4 == 2, F.lit(" (online)")).otherwise("")).alias("title"),
        body.alias("description"),
        pick(C % 7, "Harbour", "pier ", "Old Bridge", "Bridgetown", "Somewhere", "Somewhere", "Pier").alias("municipal"),
        pick(C % 7, "COAST", "Coast", "Coast", "Inland", "coast", "Capital", "Inland").alias("county"),
        F.when(C % 3 == 0, "en").otherwise("de").alias("language"), cats.alias("occupation_categories"),
        F.when(C % 4 == 1, 70).when(C % 4 > 1, 100).alias("extent_percent"),
        F.when(K % 8 < 2, "Short let room").otherwise("Permanent").alias("engagement_type"))


def scored(spark, sf) -> DataFrame:
    return scoring.with_scores(scoring.with_facts(adverts(spark, sf), DEMO_PACK), DEMO_PACK)


# ---- the same arithmetic from the selectors ----------------------------------------------------------------

_FACTS = """WITH s AS (SELECT concat('ord-', lpad(cast(o_orderkey AS string), 9, '0')) AS uuid, o_custkey AS c, o_orderkey AS k, o_orderpriority AS p FROM orders),
f AS (SELECT *, p = '2-HIGH' AS target, p = '3-MEDIUM' AS ict, k % 4 IN (0, 2) AS remote, c % 3 = 0 AS english, k % 6 = 0 OR p = '5-LOW' AS entry,
CASE WHEN c % 7 IN (0, 1) THEN 15 WHEN c % 7 IN (2, 3, 5) THEN 10 WHEN c % 7 = 4 THEN 7 ELSE 0 END AS location,
CASE c % 4 WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN p = '2-HIGH' THEN 2 ELSE 1 END WHEN 3 THEN CASE WHEN p = '2-HIGH' THEN 1 ELSE 0 END ELSE 0 END AS a_hits,
CASE WHEN p = '1-URGENT' THEN 1 ELSE 0 END AS b_title, CASE WHEN p = '1-URGENT' THEN 1 ELSE 0 END + CASE WHEN c % 4 = 0 THEN 2 ELSE 0 END AS b_hits,
CASE c % 11 WHEN 0 THEN 10 WHEN 1 THEN 15 ELSE 0 END AS cat_bonus,
CASE WHEN c % 11 = 4 THEN -15 WHEN c % 11 = 5 THEN -25 WHEN p = '4-NOT SPECIFIED' THEN -15 ELSE 0 END AS cat_pen,
c % 7 NOT IN (0, 1) AND k % 4 NOT IN (0, 2) AS moving FROM s),
t AS (SELECT *, least((a_hits + CASE WHEN target OR ict THEN 2 ELSE 0 END) * 8, 40) AS a_pts, least((b_hits + b_title) * 6, 30) AS b_pts,
location + CASE WHEN remote THEN 15 ELSE 0 END + CASE WHEN english THEN 10 ELSE 0 END + CASE WHEN entry THEN 12 ELSE 0 END AS context FROM f),
g AS (SELECT *, a_pts >= 16 OR (c % 11 IN (2, 3) AND a_pts > 0) AS rel_desk, b_title > 0 OR b_hits >= 2 OR (cat_bonus > 0 AND p <> '3-MEDIUM') AS rel_floor FROM t),
x AS (SELECT uuid, """

# component -> (points in the floor profile, points in the desk profile)
_PTS: dict[str, tuple[str, str]] = {
    "language_bonus": ("CASE WHEN english THEN 10 ELSE 0 END",) * 2,
    "track_a": ("0", "a_pts"),
    "pair_tag_bonus": ("0", "CASE WHEN c % 11 IN (2, 3) AND a_pts > 0 THEN 8 ELSE 0 END"),
    "track_b": ("b_pts", "0"),
    "track_c": ("0", "CASE WHEN c % 4 = 1 THEN 6 ELSE 0 END"),
    "role_title_penalty": ("CASE WHEN p = '5-LOW' THEN -40 ELSE 0 END",) * 2,
    "entry_level_bonus": ("CASE WHEN entry THEN 12 ELSE 0 END",) * 2,
    "senior_penalty": ("CASE WHEN ict THEN -15 ELSE 0 END + CASE WHEN k % 7 IN (0, 2, 5, 6) THEN -10 ELSE 0 END",
                       "CASE WHEN ict THEN -15 ELSE 0 END + CASE WHEN k % 7 = 0 THEN -10 ELSE 0 END"),
    "management_penalty": ("CASE WHEN c % 5 = 0 THEN -30 ELSE 0 END",) * 2,
    "remote_bonus": ("CASE WHEN remote THEN 15 ELSE 0 END",) * 2,
    "location_bonus": ("location",) * 2,
    "licence_penalty": ("CASE WHEN c % 6 IN (1, 2) THEN -20 ELSE 0 END",) * 2,
    "degree_penalty": ("CASE WHEN c % 8 = 0 THEN -10 ELSE 0 END",) * 2,
    "fluency_penalty": ("CASE WHEN k % 3 = 0 THEN -20 ELSE 0 END",) * 2,
    "category_points": ("cat_bonus + cat_pen", "cat_pen"),
    "channel_penalty": ("CASE WHEN c % 9 = 0 THEN -10 ELSE 0 END",) * 2,
    "relocation_penalty": ("CASE WHEN moving AND c % 4 = 1 THEN -40 ELSE 0 END + CASE WHEN moving AND k % 8 = 0 THEN -40 ELSE 0 END",) * 2,
    "formal_penalty": ("CASE WHEN k % 5 = 0 THEN -35 ELSE 0 END",) * 2,
    "experience_penalty": ("CASE WHEN c % 7 = 0 THEN -25 ELSE 0 END",) * 2,
    "context_gate": ("CASE WHEN rel_floor THEN 0 ELSE -(cast(round_even(context * 0.75, 0) AS int) + cat_bonus) END",
                     "CASE WHEN rel_desk THEN 0 ELSE -cast(round_even(context * 0.75, 0) AS int) END"),
}
FACTS = _FACTS + ", ".join(
    f"cast({e[i]} AS int) AS {n}_{side}" for n, e in _PTS.items() for i, side in enumerate(("floor", "desk"))) + " FROM g) "
_RULES = {
    "r1_language_bonus": "language_bonus", "r2_track_a": "track_a", "r3_pair_bonus": "pair_tag_bonus", "r4_track_b": "track_b",
    "r5_track_c": "track_c", "r6_role_title": "role_title_penalty", "r7_entry_level": "entry_level_bonus",
    "r8_seniority": "senior_penalty", "r9_management": "management_penalty", "r10_remote": "remote_bonus",
    "r11_location_tier": "location_bonus", "r12_licence": "licence_penalty", "r13_degree": "degree_penalty",
    "r14_fluency": "fluency_penalty", "r15_category_points": "category_points", "r16_channel": "channel_penalty",
    "r17_relocation": "relocation_penalty", "r18_formal": "formal_penalty", "r19_experience": "experience_penalty",
    "r20_context_gate": "context_gate",
}


def _component(name: str, part: str):
    @query(name, FACTS + f"SELECT uuid, {part}_floor AS floor, {part}_desk AS desk FROM x")
    def run(spark, sf):
        facts = scoring.with_facts(adverts(spark, sf), DEMO_PACK)
        points = {side: scoring.component(DEMO_PACK, scoring.PROFILES[side], part)["points"] for side in ("floor", "desk")}
        return facts.select("uuid", points["floor"].alias("floor"), points["desk"].alias("desk"))
    return run


for _name, _part in _RULES.items():
    _component(_name, _part)


def _total_sql(side: str) -> str:
    return "least(greatest(10 + " + " + ".join(f"{n}_{side}" for n in _PTS) + ", 0), 100)"


@query("r21_relevance", FACTS.replace("x AS (SELECT uuid, ", "x AS (SELECT uuid, rel_floor, rel_desk, ") + "SELECT uuid, cast(rel_floor AS int) AS floor, cast(rel_desk AS int) AS desk FROM x")
def r21(spark, sf):
    s = scoring.with_facts(adverts(spark, sf), DEMO_PACK)
    rel = {side: F.size(scoring.component(DEMO_PACK, spec, "context_gate")["matched"]) == 0 for side, spec in scoring.PROFILES.items()}
    return s.select("uuid", flag(rel["floor"]).alias("floor"), flag(rel["desk"]).alias("desk"))


@query("a9_score_totals", FACTS + f"SELECT uuid, cast({_total_sql('floor')} AS int) AS score, cast({_total_sql('desk')} AS int) AS score_it FROM x")
def a9(spark, sf):
    return scored(spark, sf).select("uuid", "score", "score_it")


@query("a15_category_sums", FACTS + "SELECT uuid, category_points_floor AS points FROM x")
def a15(spark, sf):
    facts = scoring.with_facts(adverts(spark, sf), DEMO_PACK)
    return facts.select("uuid", (F.col("f_cat_bonus") + F.col("f_cat_penalty")).alias("points"))


@query("r22_breakdown", FACTS + " UNION ALL ".join(f"SELECT uuid, '{n}' AS component, {n}_desk AS points FROM x" for n in _PTS))
def r22(spark, sf):
    return scoring.long_form(scored(spark, sf), "desk")


# The same engine on the documents: three tracks, title = first line, no other rule can fire on invented prose. A keyword counts anywhere in
# the title and the plain text behind it, also where the two meet.
_SQUEEZED = r"regexp_replace(nfc_normalize({}), '[ \t\x{{A0}}]+', ' ', 'g')"


@query("r_score_documents", f"WITH u AS (SELECT doc_id, {TAGS_SQL.format('text')} AS plain FROM documents), " + decoded_sql("p", "u", "doc_id", "plain") + f""",
d AS (SELECT documents.doc_id, lower(coalesce({_SQUEEZED.format("split_part(text, chr(10), 1)")}, '')) AS t, lower(coalesce({_SQUEEZED.format("plain")}, '')) AS b
FROM documents LEFT JOIN p ON documents.doc_id = p.doc_id),
w AS (SELECT doc_id, """ + ", ".join(
    f"CASE WHEN contains(t || ' ' || b, '{w}') THEN 1 ELSE 0 END AS h{i}, CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END AS t{i}"
    for i, w in enumerate(("the of", "und die", "ation", "que la", "with"))) + """ FROM d)
SELECT doc_id, cast(least((h0 + h1 + t0 + t1) * 8, 40) AS int) AS track_a, cast(least((h2 + h3 + t2 + t3) * 6, 30) AS int) AS track_b, cast(least(h4 * 3, 15) AS int) AS track_c FROM w""")
def r_documents(spark, sf):
    from dataclasses import replace

    from ...operators.pack import Track
    pack = replace(DEMO_PACK, track_a=Track(("the of", "und die"), 8, 40), track_b=Track(("ation", "que la"), 6, 30), track_c=Track(("with",), 3, 15))
    none = F.lit(None)
    d = spread(table(spark, sf, "documents")).select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("description"),
        none.cast("string").alias("municipal"), none.cast("string").alias("county"), F.col("lang").alias("language"),
        none.cast(CATEGORY).alias("occupation_categories"), none.cast("int").alias("extent_percent"), none.cast("string").alias("engagement_type"))
    s = scoring.with_scores(scoring.with_facts(d, pack), pack)
    desk, floor = F.col("score_it_breakdown"), F.col("score_breakdown")
    return s.select("doc_id", desk["track_a"]["points"].alias("track_a"), floor["track_b"]["points"].alias("track_b"), desk["track_c"]["points"].alias("track_c"))


# ---- hard blocks -------------------------------------------------------------------------------------------

# (text, rule it must trigger)
CASES: tuple[tuple[str, str | None], ...] = (
    ("A calm house.", None), ("You need approval by the landlord.", "B4"), ("Approval by the landlord is optional.", None),
    ("A few of our rooms need approval by the landlord.", None), ("This is a cooperative. Approval is expected.", "B4"),
    ("Approval is expected.", None), ("In the cooperative approval is expected for entry.", None),
    ("You are a registered sublessor.", "B5"), ("You are a registered sublessor, optional but open.", None),
    ("You are a registered sublessor. It is fine if no registered sublessor applies.", None),
    ("You must hold a lodging licence.", "B5t"), ("You must speak Greek at table.", "B6"), ("You must speak Greek at table or English.", None),
    ("You must speak Greek at table and English.", "B6"), ("You must be vetted by the board.", "B7"), ("The tenant must undergo a board vetting.", "B7"),
    ("The tenant may need to undergo a board vetting.", None), ("Board vetting: not expected.", None),
    ("<h3>House rules:</h3>Board vetting", "B7"), ("<h3>Good to know:</h3>Board vetting", None),
    ("You must be a member of the village.", "B8"), ("Only village members apply.", "B8"), ("You must be a parish member.", "B8"),
    ("You must be a parish member or have a sponsor.", None), ("A house passport is asked for.", "B9"), ("A house passport is not asked for.", None),
    ("No house passport is asked for.", None), ("You must have a boiler licence.", "B10"), ("You must have a boiler licence. Lessons are given.", None),
    ("<h3>House rules:</h3>Boiler licence", "B10"), ("A chimney certificate is expected.", "B11"), ("A chimney certificate is optional.", None),
)
BLOCK_TITLES = ("Kiosk", "Caravan", "Dormitory", "Stable", "Houseboat", "Garage", "Allotment", "Barracks", "House swap", "Spanish-only flat")
N, NT = len(CASES), 24


def block_adverts(spark, sf) -> DataFrame:
    o = spread(table(spark, sf, "orders"), SHARE)
    C, K, _, UUID = selectors()
    title = pick(K % NT, *BLOCK_TITLES, *["Garden annex"] * 7, other="Room")
    return o.select(
        UUID.alias("uuid"), title.alias("title"), F.concat(F.lit("<p>"), pick(C % N, *[t for t, _ in CASES]), F.lit("</p>")).alias("description"),
        F.when(C % 13 == 0, "Far  Island").otherwise("Harbour").alias("municipal"),
        F.when(K % 5 == 0, "Inland").otherwise("coast").alias("county"), F.when(C % 2 == 0, 50).otherwise(80).alias("extent_percent"))


def _case(rule: str) -> str:
    idx = [str(i) for i, (_, r) in enumerate(CASES) if r == rule]
    return f"c % {N} IN ({', '.join(idx)})"


_BSQL = {
    "B1": ("c % 13 = 0", "'place on the deny list'"),
    "B2": (f"k % {NT} < {len(BLOCK_TITLES)}", f"CASE k % {NT} " + " ".join(f"WHEN {i} THEN '{r}'" for i, (r, _) in enumerate(DEMO_PACK.title_blocks)) + " END"),
    "B3": ("k % 5 = 0 AND c % 2 = 0", "'far from home and a low share of full time'"),
    "B4": (_case("B4"), "'authorisation required'"),
    "B5": (f"{_case('B5')} OR ({_case('B5t')} AND k % {NT} NOT BETWEEN 10 AND 16)",
           f"CASE WHEN {_case('B5')} THEN 'regulated letting' ELSE 'lodging licence required' END"),
    "B6": (_case("B6"), "'foreign language required'"), "B7": (_case("B7"), "'security clearance required'"),
    "B8": (_case("B8"), "'citizenship required'"), "B9": (_case("B9"), "'foreign passport required'"),
    "B10": (_case("B10"), "'certificate required without training'"), "B11": (_case("B11"), "'second certificate required'"),
}
_BL = "WITH s AS (SELECT concat('ord-', lpad(cast(o_orderkey AS string), 9, '0')) AS uuid, o_custkey AS c, o_orderkey AS k FROM orders), b AS (SELECT uuid, " + ", ".join(
    f"CASE WHEN {cond} THEN {why} END AS {r}" for r, (cond, why) in _BSQL.items()) + " FROM s) "
_BNAMES = {"B1": "denied_place", "B2": "title_category", "B3": "far_low_extent", "B4": "authorisation", "B5": "regulated_licence", "B6": "foreign_language",
           "B7": "clearance", "B8": "citizenship", "B9": "passport", "B10": "certificate", "B11": "second_certificate"}


def _block(rule: str, name: str):
    @query(f"{rule.lower()}_{name}", _BL + f"SELECT uuid, {rule} AS reason FROM b")
    def run(spark, sf):
        return blocks.rule_reasons(block_adverts(spark, sf), DEMO_PACK, rules=(rule,)).select("uuid", F.col(rule).alias("reason"))
    return run


for _r, _n in _BNAMES.items():
    _block(_r, _n)


@query("b_first_reason", _BL + "SELECT uuid, coalesce(" + ", ".join(_BSQL) + ") AS reason FROM b")
def b_first(spark, sf):
    return blocks.with_blocks(block_adverts(spark, sf), DEMO_PACK).select("uuid", F.col("exclusion_reason").alias("reason"))
