"""F: column functions over documents, pages, orders, lineitem, parts, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import clauses as C
from ...functions import dates, figures, identity, keywords, text
from ...operators.pack import DEMO_WORDS
from ...operators.scoring import display_breakdown
from ...session import SHARE, spread
from .base import TAGS_SQL, decoded_sql, flag, query, table, ts


def heavy(spark, sf, name):
    """A table ahead of regex-heavy work: small files are dealt out over all cores, large inputs stay as they are."""
    return spread(table(spark, sf, name))


@query("f1_normalize_text", r"SELECT doc_id, regexp_replace(nfc_normalize(concat(replace(text, ' ', concat(chr(9), chr(160))), ' e', chr(769), ' ', chr(8491))), '[ \t\x{A0}]+', ' ', 'g') AS text FROM documents")
def f1(spark, sf):
    raw = F.concat(F.replace("text", F.lit(" "), F.lit("\t ")), F.lit(" é Å"))
    return heavy(spark, sf, "documents").select("doc_id", text.normalize_text(raw).alias("text"))


@query("f2_strip_html", f"WITH u AS (SELECT page_id, {TAGS_SQL.format('html')} AS text FROM pages), " + decoded_sql("t", "u", "page_id", "text")
       + r" SELECT page_id, regexp_replace(nfc_normalize(coalesce(text, '')), '[ \t\x{A0}]+', ' ', 'g') AS text FROM t")
def f2(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("f3_entities", "WITH " + decoded_sql("t", "pages", "page_id", "html") + " SELECT page_id, html FROM t")
def f3(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.unescape(F.col("html")).alias("html"))


_SHAPES = """CASE o_custkey % 6 WHEN 0 THEN concat(cast(d AS string), 'T12:00:00') WHEN 1 THEN concat(cast(day(d) AS string), '.', cast(month(d) AS string), '.', cast(year(d) AS string))
WHEN 2 THEN concat(lpad(cast(day(d) AS string), 2, '0'), '-', lpad(cast(month(d) AS string), 2, '0'), '-', cast(year(d) AS string)) WHEN 3 THEN 'as soon as possible' WHEN 4 THEN '' ELSE cast(d AS string) END"""
_DUE = f"WITH b AS (SELECT o_orderkey, o_custkey, cast(o_orderdate AS date) AS d FROM orders), v AS (SELECT o_orderkey, o_custkey % 6 AS m, d, {_SHAPES} AS raw FROM b) "


def due_rows(spark, sf):
    b = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "cast(o_orderdate AS date) AS d")
    return b.withColumn("raw", F.expr(_SHAPES))


@query("f4_due_date", _DUE + "SELECT o_orderkey, CASE WHEN m NOT IN (3, 4) THEN d END AS due FROM v")
def f4(spark, sf):
    return due_rows(spark, sf).select("o_orderkey", dates.normalize_due_date(F.col("raw")).alias("due"))


@query("f5_format_due", _DUE + "SELECT o_orderkey, CASE WHEN m = 3 THEN raw WHEN m <> 4 THEN strftime(d, '%d.%m.%Y') END AS shown FROM v")
def f5(spark, sf):
    return due_rows(spark, sf).select("o_orderkey", dates.format_due(F.col("raw")).alias("shown"))


@query("f6_day_first_dates", """WITH v AS (SELECT o_orderkey, cast(o_orderdate AS date) AS d, CASE WHEN o_custkey % 3 = 0 THEN 'open' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN raw = 'open' THEN raw ELSE cast(d AS string) END AS passed, CASE WHEN raw <> 'open' THEN cast(d AS string) END AS strict FROM v""")
def f6(spark, sf):
    raw = F.when(F.col("o_custkey") % 3 == 0, "open").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", dates.iso_or_text(raw).alias("passed"), dates.iso_or_null(raw).alias("strict"))


@query("f7_days_until", _DUE + "SELECT o_orderkey, CASE WHEN m IN (0, 5) THEN cast(d - DATE '1998-08-02' AS int) END AS days FROM v")
def f7(spark, sf):
    return due_rows(spark, sf).select("o_orderkey", dates.days_until(F.col("raw"), F.lit("1998-08-02")).alias("days"))


def _vote_sql() -> str:
    tok = r"regexp_split_to_array(lower(text), '[^\p{L}]+')"
    cols = ", ".join(
        f"len([x for x in t if x IN ({', '.join(repr(w) for w in ws)})]) AS n_{tag}" for tag, ws in sorted(text.STOP_WORDS.items()))
    tags = sorted(text.STOP_WORDS)
    best = "greatest(" + ", ".join(f"n_{t}" for t in tags) + ")"
    pick = "CASE " + " ".join(f"WHEN n_{t} = m THEN '{t}'" for t in tags) + " END"
    return (f"WITH t AS (SELECT doc_id, length(trim(text)) AS len, {tok} AS t FROM documents), v AS (SELECT doc_id, len, {cols} FROM t), "
            f"b AS (SELECT *, {best} AS m FROM v) SELECT doc_id, CASE WHEN len >= 20 AND m > 0 THEN {pick} END AS language FROM b")


@query("f8_detect_language", _vote_sql())
def f8(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


# Line items as adverts: the discount is the share, the price is the pay, the line number picks the wording.
_LI = "l_orderkey, l_partkey, l_linenumber, l_extendedprice, cast(round(l_discount * 1000) AS int) AS pct, cast(floor(l_extendedprice) AS int) AS pay"


def line_rows(spark, sf):
    return spread(table(spark, sf, "lineitem"), SHARE).selectExpr(*_LI.split(", ", 4)[:4], "cast(round(l_discount * 1000) AS int) AS pct", "cast(floor(l_extendedprice) AS int) AS pay")


@query("f9_extent", f"""WITH v AS (SELECT {_LI} FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber = 1 THEN 100 WHEN l_linenumber IN (2, 3, 4) AND pct BETWEEN 1 AND 100 THEN pct END AS extent FROM v""")
def f9(spark, sf):
    n, pct = F.col("l_linenumber"), F.col("pct").cast("string")
    scope = F.when(n == 1, "Full time").otherwise("Part time")
    title = F.when(n == 2, F.concat(F.lit("Seller "), pct, F.lit(" %"))).otherwise("Seller")
    body = (F.when(n == 3, F.concat(F.lit("Good mood. A "), pct, F.lit("% position.")))
            .when(n == 4, F.concat(F.lit("The position is filled to "), pct, F.lit(" % now")))
            .otherwise(F.concat(pct, F.lit("% of customers are happy with our service and every position"))))
    e = figures.extent_percent(scope, title, body)
    return line_rows(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", e.alias("extent"))


_GROUPED = "replace(format('{:,}', cast(pay AS bigint)), ',', ' ')"


def pay_rows(spark, sf):
    """Pay written with blanks, dots or as a range, and sentences without pay."""
    n = F.col("l_linenumber")
    spaced = F.translate(F.format_number("pay", 0), ",", " ")
    dotted = F.translate(F.format_number("pay", 0), ",", ".")
    up = F.translate(F.format_number(F.col("pay") + 5000, 0), ",", " ")
    body = (F.when(n == 1, F.concat(F.lit("We pay usd "), spaced, F.lit(" per year.")))
            .when(n == 2, F.concat(F.lit("Salary between "), spaced, F.lit(" and "), up, F.lit(" usd")))
            .when(n == 3, F.concat(F.lit("Offer: $ "), dotted, F.lit(" – "), up, F.lit(". Good team")))
            .when(n == 4, F.concat(F.lit("Turnover of "), spaced, F.lit(" units last year")))
            .otherwise(F.concat(F.lit("wage from "), dotted, F.lit(" usd, paid monthly"))))
    return line_rows(spark, sf).withColumn("mention", figures.pay_mention(body))


_PAY = f"WITH v AS (SELECT {_LI} FROM lineitem), p AS (SELECT *, {_GROUPED} AS g, {_GROUPED.replace('pay', 'pay + 5000')} AS up FROM v) "
# No pay is stated, or the first figure is too short to be one (the range of line 2 is read from its second figure).
_UNSAID = "l_linenumber = 4 OR (pay < 1000 AND l_linenumber <> 2)"
_PAYKEY = "l_orderkey, l_partkey, l_linenumber, l_extendedprice"


@query("f10_pay_mention", _PAY + f"SELECT {_PAYKEY}, CASE WHEN {_UNSAID} THEN 0 ELSE 1 END AS found FROM p")
def f10(spark, sf):
    return pay_rows(spark, sf).select(*_PAYKEY.split(", "), flag(F.col("mention").isNotNull()).alias("found"))


@query("f11_pay_text", _PAY + f"""SELECT {_PAYKEY}, CASE WHEN {_UNSAID} THEN NULL WHEN l_linenumber IN (2, 3) THEN concat('usd ', g, ' – ', up) ELSE concat('usd ', g) END AS pay FROM p""")
def f11(spark, sf):
    return pay_rows(spark, sf).select(*_PAYKEY.split(", "), figures.pay_text(F.col("mention")).alias("pay"))


@query("f12_pay_min", _PAY + f"SELECT {_PAYKEY}, CASE WHEN NOT ({_UNSAID}) THEN pay END AS pay_min FROM p")
def f12(spark, sf):
    return pay_rows(spark, sf).select(*_PAYKEY.split(", "), figures.pay_min(figures.pay_text(F.col("mention"))).alias("pay_min"))


@query("f14_unicode_case", "SELECT doc_id, lower(text) AS low, upper(replace(text, 'ß', 's')) AS up FROM documents")
def f14(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"), F.upper(F.replace("text", F.lit("ß"), F.lit("s"))).alias("up"))


# Event properties as category tags; every seventh value breaks the JSON.
_TAGSRC = """CASE WHEN event_id % 7 = 3 THEN concat('[{', props) ELSE concat('[{"level1": "', event_type, '", "level2": "', cast(user_id % 3 AS string), '"}, {"level1": "', CASE WHEN value < 10 THEN 'IT' ELSE event_type END, '", "level2": "', props2, '"}]') END"""


def tag_rows(spark, sf):
    e = table(spark, sf, "events").withColumn("props2", F.translate("props", '"{}', ""))
    return e.select("event_id", F.expr(_TAGSRC).alias("raw"))


_TAGQ = "WITH e AS (SELECT *, event_id % 7 = 3 AS broken FROM events) "


@query("f15_category_set", _TAGQ + """SELECT event_id, CASE WHEN broken THEN '' WHEN value < 10 THEN concat(least('IT', event_type), ',', greatest('IT', event_type)) ELSE event_type END AS tags FROM e""")
def f15(spark, sf):
    tags = identity.level1_set(identity.parse_categories(F.col("raw")))
    return tag_rows(spark, sf).select("event_id", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query("f16_category_pair", _TAGQ + "SELECT event_id, CASE WHEN NOT broken AND event_type = 'click' AND user_id % 3 = 1 THEN 1 ELSE 0 END AS has FROM e")
def f16(spark, sf):
    has = identity.has_pair(identity.parse_categories(F.col("raw")), "click", "1")
    return tag_rows(spark, sf).select("event_id", flag(has).alias("has"))


@query("f17_cut_employer", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('Clerk ', cast(s_nationkey AS string)) ELSE concat('Clerk - ', s_name, 'x') END AS title
FROM (SELECT s_suppkey, s_nationkey, replace(s_name, 'Supplier', 'Store') AS s_name FROM supplier) s""")
def f17(spark, sf):
    even = F.col("s_suppkey") % 2 == 0
    title = F.when(even, F.concat(F.lit("Clerk "), F.col("s_nationkey"), F.lit(" - "), F.col("s_name"), F.lit(" - due soon"))).otherwise(
        F.concat(F.lit("Clerk - "), F.replace("s_name", F.lit("Supplier"), F.lit("Store")), F.lit("x")))
    return table(spark, sf, "supplier").select("s_suppkey", text.cut_at_employer(title, F.col("s_name")).alias("title"))


@query("f18_value_label", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'today' WHEN '5-LOW' THEN 'some day' ELSE o_orderpriority END AS label FROM orders")
def f18(spark, sf):
    labels = {"1-URGENT": "today", "5-LOW": "some day"}
    return table(spark, sf, "orders").select("o_orderkey", text.value_label(F.col("o_orderpriority"), labels).alias("label"))


@query("f19_duration_text", """SELECT p_partkey, CASE WHEN p_size * 7 >= 60 THEN concat(cast(p_size * 7 // 60 AS string), ' h ', cast(p_size * 7 % 60 AS string), ' min')
ELSE concat(cast(p_size * 7 AS string), ' min') END AS shown FROM part""")
def f19(spark, sf):
    return table(spark, sf, "part").select("p_partkey", figures.duration_text(F.col("p_size") * 7).alias("shown"))


@query("f20_breakdown_rows", """SELECT o_orderkey, 1 AS ord, 'Language of the listing' AS label, 10 AS points, '—' AS detail FROM orders
UNION ALL SELECT o_orderkey, 9, 'Remote work', cast(o_custkey % 16 AS int), concat('remote, ', o_orderpriority) FROM orders""")
def f20(spark, sf):
    raw = F.to_json(F.create_map(
        F.lit("remote_bonus"), F.struct((F.col("o_custkey") % 16).cast("int").alias("points"), F.array(F.lit("remote"), F.col("o_orderpriority")).alias("matched")),
        F.lit("language_bonus"), F.struct(F.lit(10).alias("points"), F.array().cast("array<string>").alias("matched")),
        F.lit("unlisted"), F.struct(F.lit(3).alias("points"), F.array().cast("array<string>").alias("matched"))))
    return display_breakdown(table(spark, sf, "orders").select("o_orderkey", raw.alias("b")), "b", "o_orderkey")


_KW = ("the of", "and ", "ation", "zebra", "que")


@query("f21_keyword_hits", "SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in _KW) + " AS n, concat_ws('|', "
       + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in _KW) + ") AS words FROM documents")
def f21(spark, sf):
    hits = keywords.keyword_hits(F.lower("text"), _KW)
    return heavy(spark, sf, "documents").select("doc_id", F.size(hits).alias("n"), F.array_join(hits, "|").alias("words"))


@query("f22_unnegated_keyword", "SELECT doc_id, CASE WHEN contains(replace(replace(lower(text), 'the with', '#'), 'of with', '#'), 'with') THEN 1 ELSE 0 END AS present FROM documents")
def f22(spark, sf):
    p = keywords.present_unnegated(F.lower("text"), ["with"], ["the ", "of "])
    return heavy(spark, sf, "documents").select("doc_id", flag(p).alias("present"))


# Clause counts without lookaround: a dot counts as a break unless digits stand on both sides.
@query("f23_clause_count", r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1_\2', 'g'), '([0-9])\.([0-9])', '\1_\2', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([0-9])\.([^\s])', '\1_\2', 'g'), '([^0-9]|^)\.([0-9])', '\1_\2', 'g') AS t FROM a),
c AS (SELECT doc_id, [x for x in regexp_split_to_array(t, '[.;!?' || chr(10) || ']') if trim(x) <> ''] AS l FROM b) SELECT doc_id, cast(len(l) AS int) AS n FROM c""")
def f23(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", F.size(C.clauses(F.col("text"), DEMO_WORDS)).alias("n"))


# Orders as one clause each, put together from fixed phrases; what is expected follows from the same choice.
_CLAUSES = (
    ("a crane permit would be lovely", 1, 1, 0), ("a crane permit or the like is expected", 1, 1, 0),
    ("you must hold a crane permit", 0, 0, 1), ("a crane permit (optional elsewhere) is expected", 0, 0, 1),
    ("crane permit, if possible from this year", 0, 0, 1), ("a car is optional, and a crane permit is expected", 1, 0, 1),
    ("a crane permit is not expected", 1, 1, 0), ("there is no call for a crane permit", 0, 0, 0),
    ("not just any crane permit", 0, 0, 0), ("we do not need your car but a crane permit", 0, 0, 1),
)


def _clause_sql(i: int) -> str:
    return "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {c[i]}" for k, c in enumerate(_CLAUSES)) + " END"


def clause_rows(spark, sf):
    pick = F.element_at(F.array(*[F.lit(c[0]) for c in _CLAUSES]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.concat(pick, F.lit(" ")).alias("c"))


@query("f24_softened_clause", f"SELECT o_orderkey, {_clause_sql(1)} AS soft FROM orders")
def f24(spark, sf):
    return clause_rows(spark, sf).select("o_orderkey", flag(C.softened(F.col("c"), DEMO_WORDS)).alias("soft"))


@query("f25_softened_segment", f"SELECT o_orderkey, {_clause_sql(2)} AS soft FROM orders")
def f25(spark, sf):
    near = F.exists(C.hits(F.col("c"), "crane permit"), lambda h: C.softened_near(h, DEMO_WORDS))
    return clause_rows(spark, sf).select("o_orderkey", flag(near).alias("soft"))


@query("f26_firm_match", f"SELECT o_orderkey, {_clause_sql(3)} AS firm FROM orders")
def f26(spark, sf):
    firm = F.exists(C.hits(F.col("c"), "crane permit"), lambda h: C.firm_in_segment(h, DEMO_WORDS))
    return clause_rows(spark, sf).select("o_orderkey", flag(firm).alias("firm"))


@query("f27_firm_patterns", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'alpha skill' WHEN 1 THEN '' WHEN 2 THEN 'alpha skill|beta skill' WHEN 3 THEN 'beta skill' ELSE '' END AS firm FROM orders""")
def f27(spark, sf):
    texts = ("You must have alpha skill; beta skill is optional", "No alpha skill needed. Beta skill not expected",
             "Alpha skill or the like. beta skill", "without alpha skill, yet it takes a long and winding sentence until beta skill", "nothing")
    pick = F.lower(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 5 + 1).cast("int")))
    rows = table(spark, sf, "orders").select("o_orderkey", pick.alias("t")).withColumn("cl", C.clauses(F.col("t"), DEMO_WORDS))
    found = [F.when(F.size(C.firm_hits(F.col("cl"), p, DEMO_WORDS)) > 0, F.lit(p)) for p in ("alpha skill", "beta skill")]
    return rows.select("o_orderkey", F.concat_ws("|", *found).alias("firm"))


@query("f28_score_band", "SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 55 THEN 'high' WHEN c_acctbal / 100 >= 25 THEN 'mid' ELSE 'low' END AS band FROM customer")
def f28(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", figures.score_band(F.col("c_acctbal") / 100).alias("band"))


@query("f29_new_mark", "SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 0 END AS is_new FROM events")
def f29(spark, sf):
    return table(spark, sf, "events").select("event_id", flag(figures.is_new(F.col("ts").cast("timestamp"), ts("2024-01-15 00:00:00"))).alias("is_new"))


@query("f30_link_id", r"SELECT page_id, CASE WHEN regexp_matches(url, '/(\d+)') THEN regexp_extract(url, '/(\d+)', 1) END AS id FROM pages")
def f30(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.link_id(F.col("url"), r"/(\d+)").alias("id"))


@query("f31_next_weekday", """SELECT o_orderkey, cast(o_orderdate AS date) + CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS day FROM orders""")
def f31(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.next_weekday(F.to_date("o_orderdate")).alias("day"))


# ---- headings carried down the lines of a document ---------------------------------------------------------

def sectioned(spark, sf):
    """Documents with headings: every line that starts with 'The' becomes a required heading, every line starting
    with 'On' an optional one."""
    t = F.regexp_replace(F.regexp_replace("text", r"(?dm)^The .*$", "House rules:"), r"(?dm)^On .*$", "Good to know:")
    return heavy(spark, sf, "documents").select("doc_id", F.lower(t).alias("t"))


_LINES = r"""WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '^The ') THEN 'req' WHEN regexp_matches(line, '^On ') THEN 'opt' END AS kind FROM ln WHERE trim(line) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM k),
s AS (SELECT *, max(kind) OVER (PARTITION BY doc_id, sec) AS section, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i) - CASE WHEN sec = 0 THEN 1 ELSE 2 END AS reach FROM o) """


@query("w9_section_state", _LINES + "SELECT doc_id, coalesce(section, 'none') AS section, count(*) AS n FROM s WHERE kind IS NULL GROUP BY 1, 2")
def w9(spark, sf):
    rows = sectioned(spark, sf).select("doc_id", F.explode(C.section_lines(F.col("t"), DEMO_WORDS)).alias("x"))
    return rows.groupBy("doc_id", F.coalesce(F.col("x")["section"], F.lit("none")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("w10_section_reach", _LINES + "SELECT doc_id, count(*) FILTER (WHERE reach <= 8 AND section IS NOT NULL) AS near, count(*) FILTER (WHERE reach > 8 AND section IS NOT NULL) AS far FROM s WHERE kind IS NULL GROUP BY doc_id")
def w10(spark, sf):
    rows = sectioned(spark, sf).select("doc_id", F.explode(C.section_lines(F.col("t"), DEMO_WORDS)).alias("x"))
    known, near = F.col("x")["section"].isNotNull(), F.col("x")["reach"] <= C.SECTION_REACH
    return rows.groupBy("doc_id").agg(F.count_if(known & near).alias("near"), F.count_if(known & ~near).alias("far"))


@query("w11_next_clause", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 1 END AS unmet FROM orders""")
def w11(spark, sf):
    texts = ("You must hold a forklift licence. We like fun", "You must hold a forklift licence. Training is given", "A forklift licence would be lovely",
             "House rules:\nForklift licence\nA good mood", "No mention", "You must hold a forklift licence. We like fun. Training is given")
    pick = F.lower(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 6 + 1).cast("int")))
    rows = table(spark, sf, "orders").select("o_orderkey", pick.alias("t")).withColumn("cl", C.clauses(F.col("t"), DEMO_WORDS))
    unmet = C.unmet_certificate(F.col("cl"), F.lit("driver"), "forklift licence", DEMO_WORDS, "training is given")
    return rows.select("o_orderkey", flag(unmet).alias("unmet"))


@query("a14_required_years", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN cast(o_custkey % 9 + 1 AS int) WHEN 1 THEN cast(o_custkey % 9 + 1 AS int) WHEN 2 THEN 6 END AS years FROM orders""")
def a14(spark, sf):
    from ...operators.pack import DEMO_PACK
    from ...operators.scoring import _years, required_years
    n = (F.col("o_custkey") % 9 + 1).cast("string")
    i = F.col("o_orderkey") % 5
    t = (F.when(i == 0, F.concat(F.lit("at least "), n, F.lit(" years of renting")))
         .when(i == 1, F.concat(n, F.lit("-12 years of renting with others")))
         .when(i == 2, F.lit("two years of renting here; six years of renting there"))
         .when(i == 3, F.lit("many years of renting")).otherwise(F.concat(F.lit("no more than "), n, F.lit(" years of renting"))))
    rows = table(spark, sf, "orders").select("o_orderkey", t.alias("t")).withColumn("_clauses", C.clauses(F.col("t"), DEMO_WORDS))
    return rows.withColumn("y", _years(DEMO_PACK)).select("o_orderkey", required_years(F.col("y"), DEMO_PACK).alias("years"))
