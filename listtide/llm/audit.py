"""How filters act on each other: contingency tensors of pass and fail, contracted for every order in which the filters may run.

One pass over the documents gives each row's failures; rows are counted by part and combination of failures, and the counts of a
part, shaped 2 x 2 x ... x 2, answer every question about every order: along each axis a step selects pass, fail or all."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listtide.operators.skew import lookup

from .tables import table

#: What is counted in each cell: all documents, good ones, toxic ones.
MEASURES = ("n", "good", "toxic")
#: Orders grow with the factorial of the filters.
MOST_FILTERS = 6

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of the four filters that look at one text (null is the empty text)."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang", copies: str = "E") -> DataFrame:
    """(part, cell, n, good, toxic): counts of the rows of `docs` by part and failures.

    Bit k of `cell` is a failure of the k-th filter in the order of letters. The filter `copies` fails for a row whose text also
    stands in a row of smaller doc_id, anywhere in the table. A null text is the empty text, a null part is ''. A row without doc_id
    has no smaller id (and none is smaller than it) and has no label; repeated rows each count, and rows of one id do not make each
    other copies. Of several labels of an id one that says 1 is enough. Only the columns named here are read, so others may have any name.

    Rows of one text are counted before they meet: what is exchanged by text has at most one row for each text, id and task,
    and what meets there is one row for each text, part and label."""
    fails = text_filters(F.col("text"))
    names = sorted([*fails, copies])
    own = sum((F.when(fails[k], 1 << names.index(k)).otherwise(0) for k in fails), F.lit(0))
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own.alias("own"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"))
    marked = lookup(rows, marks, ["doc_id"], ["digest"]).select(
        "doc_id", "part", "own", "digest", F.coalesce("is_good", F.lit(0)).alias("is_good"), F.coalesce("is_toxic", F.lit(0)).alias("is_toxic"))
    kinds = ["digest", "own", "part", "is_good", "is_toxic"]
    # The first of a text: its smallest id, how many rows have it, and all others.
    ids = marked.groupBy(*kinds, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = ids.groupBy(*kinds).agg(
        F.min("doc_id").alias("first_id"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_plain"),
        F.min_by("n", "doc_id").alias("n_first"))
    least = firsts.groupBy(F.col("digest").alias("of")).agg(F.min("first_id").alias("least_id"))
    both = firsts.join(least, F.col("digest") == F.col("of"))
    unlike = F.col("n_plain") + F.when(F.col("first_id") == F.col("least_id"), F.col("n_first")).otherwise(0)
    bit = 1 << names.index(copies)
    split = both.select("part", "is_good", "is_toxic", F.explode(F.array(
        F.struct(F.col("own").alias("cell"), unlike.alias("n")), F.struct((F.col("own") + bit).alias("cell"), (F.col("n") - unlike).alias("n")))).alias("c"))
    n = F.col("c.n")
    return split.where(n > 0).groupBy("part", F.col("c.cell").alias("cell")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("is_good")).alias("good"), F.sum(n * F.col("is_toxic")).alias("toxic"))


def selectors(count: int, order: Sequence[int], step: int, keep: bool) -> list[tuple[int, int]]:
    """For each axis what `step` of `order` selects: earlier filters pass, later ones may do either, its own passes (keep) or fails."""
    out = [_ALL] * count
    for f in order[:step]:
        out[f] = _PASS
    out[order[step]] = _PASS if keep else _FAIL
    return out


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums of `tensor` (measure, then 2 for each filter) under each row of `chosen` (row, filter, 2): (row, measure)."""
    count = chosen.shape[1]
    operands: list = [tensor, [0, *range(2, count + 2)]]
    for f in range(count):
        operands += [chosen[:, f], [1, f + 2]]
    return np.einsum(*operands, [1, 0], optimize="greedy")


def report(tensor: np.ndarray, names: str) -> list[tuple]:
    """(order, step, counts...) of all orders of the filters `names` for one part's tensor."""
    count = len(names)
    steps = [(order, s) for order in itertools.permutations(range(count)) for s in range(count)]
    kept, removed = (np.array([selectors(count, o, s, keep) for o, s in steps], dtype=np.int64) for keep in (True, False))
    alone = np.array([[_FAIL if g == f else _PASS for g in range(count)] for f in range(count)], dtype=np.int64)
    any_fail = np.array([[_FAIL if g == f else _ALL for g in range(count)] for f in range(count)], dtype=np.int64)
    stays, goes = contract(tensor, kept)[:, 0], contract(tensor, removed)
    fails, only = contract(tensor, any_fail)[:, 0], contract(tensor, alone)[:, 0]
    filters = np.array([o[s] for o, s in steps])
    shapley = np.zeros(count, dtype=np.int64)
    np.add.at(shapley, filters, goes[:, 0])
    columns = [stays, goes[:, 0], fails[filters] - goes[:, 0], only[filters], goes[:, 1], goes[:, 2], shapley[filters]]
    return [("".join(names[f] for f in o), s + 1, *map(int, c)) for (o, s), *c in zip(steps, *columns, strict=True)]


def interactions(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """What each filter does at each step of each order, by part, from the rows of cells(). No rows give no parts.

    A part has at most 2 ** len(names) cells; its report has one row for each order and step."""
    if not 1 <= len(names) <= MOST_FILTERS or sorted(names) != list(names):
        raise ValueError(f"one to {MOST_FILTERS} filters in the order of their letters")
    shape = (2,) * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in zip(*(batch.column(c).to_pylist() for c in ("part", "cells")), strict=True):
                tensor = np.zeros((len(MEASURES), 2 ** len(names)), dtype=np.int64)
                for c in some:
                    tensor[:, c["cell"]] += [c[m] for m in MEASURES]
                # Bit k of a cell belongs to axis k: the last axis of the array is the lowest bit.
                tensor = tensor.reshape(len(MEASURES), *shape).transpose(0, *range(len(names), 0, -1))
                rows = report(tensor, names)
                fields = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.string()), pa.array(fields[0], pa.string()), pa.array(fields[1], pa.int32()),
                     *(pa.array(f, pa.int64()) for f in fields[2:])], names=["part", "filter_order", "step", *COUNTS])

    grouped = counted.groupBy("part").agg(F.collect_list(F.struct("cell", *MEASURES)).alias("cells"))
    return grouped.mapInArrow(run, REPORT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, by language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return interactions(cells(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic")))


_STEP_SQL = """
  SELECT part, filter_order, step,
         sum(n) FILTER (WHERE (cell & (before | bit)) = 0) AS kept,
         sum(n) FILTER (WHERE (cell & before) = 0 AND (cell & bit) > 0) AS removed,
         sum(n) FILTER (WHERE (cell & before) > 0 AND (cell & bit) > 0) AS redundant,
         sum(n) FILTER (WHERE cell = bit) AS unique_fails,
         sum(good) FILTER (WHERE (cell & before) = 0 AND (cell & bit) > 0) AS good_lost,
         sum(toxic) FILTER (WHERE (cell & before) = 0 AND (cell & bit) > 0) AS toxic_lost, bit
  FROM steps CROSS JOIN counted GROUP BY ALL
"""

OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_id AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN d.doc_id > first_id THEN 16 ELSE 0 END AS cell
  FROM d JOIN least_id USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
counted AS (SELECT part, cell, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
letters AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
given_steps AS (
  SELECT filter_order, step::INTEGER AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS given
  FROM letters),
steps AS (SELECT filter_order, step, bit, coalesce(given, 0)::INTEGER AS before FROM given_steps),
r AS ({_STEP_SQL})
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
