"""Registry of the queries with their SQL equivalents, and the views of the given tables as listing data.

The views are plain row-wise derivations; their expressions are valid in Spark SQL and in ANSI-style SQL alike,
so both sides start from the same input and only the operator under test differs."""

from __future__ import annotations

import html
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...schema import CATEGORY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {c}" for c, e in exprs.items()])


def cte(name: str, source: str, exprs: dict[str, str]) -> str:
    cols = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    return f"{name} AS (SELECT {cols} FROM {source})"


# The rule of `html.unescape`: what a reference is, and the numbers that do not stand for their own character.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_ODD = {n: html.unescape(f"&#{n};") for n in range(160) if html.unescape(f"&#{n};") != chr(n)}


# Tags of line elements become line breaks, every other tag a blank.
TAGS_SQL = r"regexp_replace(regexp_replace({}, '(?i)</?(?:li|p|br|div|tr|h[1-6]|ul|ol|table)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def decoded_sql(name: str, source: str, key: str, column: str) -> str:
    """CTEs up to `name` (key, column): `column` of `source` with all character references decoded as HTML5 says, once, the longest
    name first, with or without the closing semicolon."""
    names = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in html5.items())
    odd = " ".join(f"WHEN {n} THEN {quoted(v)}" for n, v in _ODD.items())
    digit = "strpos('0123456789abcdef', lower(substr(d, cast(i AS int), 1))) - 1"
    return f"""{name}_p0 AS (SELECT {key}, regexp_split_to_array({column}, '{_REFERENCE}') AS p, regexp_extract_all({column}, '{_REFERENCE}') AS r FROM {source}),
{name}_p AS (SELECT {key}, i, p[i] AS part, r[i] AS ref FROM (SELECT {key}, p, r, unnest(CASE WHEN p IS NULL THEN [1] ELSE range(1, len(p) + 1) END) AS i FROM {name}_p0)),
{name}_names(word, chars) AS (VALUES {names}),
{name}_r AS (SELECT DISTINCT ref FROM {name}_p WHERE ref IS NOT NULL),
{name}_d AS (SELECT ref, lower(substr(ref, 3, 1)) = 'x' AS hex, regexp_extract(ref, '^&#[xX]?0*([0-9a-fA-F]*)', 1) AS d FROM {name}_r WHERE substr(ref, 2, 1) = '#'),
{name}_n AS (SELECT ref, CASE WHEN length(d) > 7 THEN 9999999 WHEN d = '' THEN 0 WHEN hex THEN cast(list_sum([({digit}) * (16 ** (length(d) - i)) for i in range(1, length(d) + 1)]) AS bigint)
ELSE cast(d AS bigint) END AS n FROM {name}_d),
{name}_c AS (SELECT ref, CASE WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE CASE n {odd} ELSE chr(cast(n AS int)) END END AS chars FROM {name}_n
UNION ALL SELECT ref, arg_max(chars || substr(ref, length(word) + 2), length(word)) FROM {name}_r JOIN {name}_names ON starts_with(ref, '&' || word) GROUP BY ref),
{name} AS (SELECT {key}, string_agg(part || coalesce(chars, p.ref, ''), '' ORDER BY i) AS {column} FROM {name}_p p LEFT JOIN {name}_c c ON p.ref = c.ref GROUP BY {key})"""


# Orders as listings: activity from the order status, workflow state from the priority, figures from the price.
ORDER_EXPRS: dict[str, str] = {
    "uuid": "concat('ord-', lpad(cast(o_orderkey AS string), 9, '0'))",
    "status": "CASE WHEN o_orderstatus = 'F' THEN 'INACTIVE' ELSE 'ACTIVE' END",
    "user_status": "CASE o_orderpriority WHEN '2-HIGH' THEN 'interesting' WHEN '3-MEDIUM' THEN 'applied' "
                   "WHEN '4-NOT SPECIFIED' THEN 'archived' ELSE 'new' END",
    "title": "concat(o_orderpriority, ' Order ', cast(o_custkey AS string))",
    "business_name": "concat('Client ', cast(o_custkey % 97 AS string), ' AS')",
    "municipal": "concat('Place ', cast(o_custkey % 31 AS string))",
    "county": "concat('Region ', cast(o_custkey % 5 AS string))",
    "description": "concat('Order of client ', cast(o_custkey AS string), ' worth ', "
                   "cast(cast(floor(o_totalprice) AS bigint) AS string), ' usd')",
    "source": "concat('src', cast(o_custkey % 7 AS string))",
    "language": "CASE WHEN o_custkey % 3 = 0 THEN 'en' WHEN o_custkey % 3 = 1 THEN 'de' END",
    "published": "cast(cast(o_orderdate AS date) AS string)",
    "sector": "o_orderpriority",
    "score": "CASE WHEN o_custkey % 13 <> 0 THEN cast(floor(o_totalprice / 5000) AS int) % 101 END",
    "score_it": "cast(floor(o_totalprice / 3000) AS int) % 101",
    "excluded": "o_totalprice < 30000",
    "exclusion_reason": "CASE WHEN o_totalprice < 30000 THEN 'low value' END",
    "flagged_at": "CASE WHEN o_totalprice > 450000 THEN cast(o_orderdate AS timestamp) END",
    "notes": "CASE WHEN o_custkey % 11 = 0 THEN 'call back' WHEN o_custkey % 11 = 1 THEN '' END",
    "salary_min": "CASE WHEN o_custkey % 5 <> 0 THEN cast(floor(o_totalprice) AS int) END",
    "salary_text": "CASE WHEN o_custkey % 5 <> 0 THEN concat('usd ', cast(cast(floor(o_totalprice) AS int) AS string)) END",
    "extent_percent": "CASE WHEN o_custkey % 4 <> 0 THEN cast(20 + o_custkey % 81 AS int) END",
    "application_due_sort": "CASE WHEN o_custkey % 6 <> 0 THEN cast(o_orderdate AS date) + 30 END",
    "application_due": "CASE WHEN o_custkey % 6 <> 0 THEN cast(cast(o_orderdate AS date) + 30 AS string) ELSE 'running' END",
    "link": "concat('https://shop.example.com/order/', cast(o_orderkey AS string))",
    "application_url": "concat('https://shop.example.com/apply/', cast(o_orderkey AS string))",
    "first_seen_at": "cast(o_orderdate AS timestamp)",
    "applied_at": "CASE WHEN o_orderpriority = '3-MEDIUM' AND o_custkey % 4 <> 1 THEN cast(o_orderdate AS timestamp) END",
    "manually_added": "o_custkey % 10 = 0",
    "level1": "CASE o_orderstatus WHEN 'O' THEN 'Open work' WHEN 'P' THEN 'IT' ELSE 'Closed' END",
    "level2": "CASE WHEN o_custkey % 2 = 0 THEN 'Operations' ELSE 'Design' END",
}
ORDERS = "WITH " + cte("l", "orders", ORDER_EXPRS) + " "


def order_listings(spark: SparkSession, sf: str) -> DataFrame:
    df = view(table(spark, sf, "orders"), ORDER_EXPRS)
    pair = F.array(F.struct("level1", "level2")).cast(CATEGORY)
    return df.withColumn("occupation_categories", pair).drop("level1", "level2")


# Documents as listings: state and blocks from the labels, scores from the length.
DOC_EXPRS: dict[str, str] = {
    "uuid": "concat('doc-', lpad(cast(d.doc_id AS string), 9, '0'))",
    "status": "'ACTIVE'",
    "title": "split_part(text, chr(10), 1)",
    "description": "text",
    "source": "source",
    "language": "lang",
    "user_status": "CASE WHEN quality IS NULL THEN 'new' WHEN toxic = 1 THEN 'archived' WHEN quality = 1 THEN 'interesting' ELSE 'applied' END",
    "excluded": "coalesce(toxic, 0) = 1",
    "exclusion_reason": "CASE WHEN toxic = 1 THEN concat('toxic ', cast(d.doc_id AS string)) END",
    "score": "cast(least(n_chars / 50, 100) AS int)",
    "score_it": "cast(n_chars % 97 AS int)",
}
_DOCS_FROM = "documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id"
DOC_EXPRS["score"] = "cast(floor(least(n_chars / 50.0, 100)) AS int)"

# The name key in SQL: two passes remove neighbouring company forms, which share a separator.
_FORM = r"'(^|[^\p{L}\p{N}_])(?:as|asa|kf|ans)($|[^\p{L}\p{N}_])'"


def name_key_sql(c: str) -> str:
    once = f"regexp_replace(lower(coalesce({c}, '')), {_FORM}, '\\1 \\2', 'g')"
    twice = f"regexp_replace({once}, {_FORM}, '\\1 \\2', 'g')"
    return f"trim(regexp_replace({twice}, '[^a-z0-9æøå]+', ' ', 'g'))"


DOCS = "WITH " + cte("l0", _DOCS_FROM, DOC_EXPRS) + ", l AS (SELECT *, " + name_key_sql("description") + " AS k FROM l0) "


def document_listings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").alias("d")
    lb = table(spark, sf, "labels").select(F.col("doc_id").alias("_id"), "quality", "toxic")
    return view(d.join(lb, F.col("d.doc_id") == F.col("_id"), "left"), DOC_EXPRS)


# Groups of copies in the documents, in SQL.
GROUPS = DOCS + """, g AS (SELECT k, count(*) AS n, count(DISTINCT source) AS ns FROM l GROUP BY k),
u AS (SELECT l.* FROM l JOIN g USING (k) WHERE ns >= 2 AND n = ns) """
SOURCE_ORDER = ("src3", "src1", "src4", "src0", "src5")
RANK_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SOURCE_ORDER)) + " ELSE 99 END"

AS_OF = "1998-08-02 00:00:00"
AS_OF_EVENTS = "2024-02-01 00:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp")


def flag(c) -> "F.Column":
    """Booleans leave the queries as 0/1."""
    return (c if not isinstance(c, str) else F.col(c)).cast("int")
