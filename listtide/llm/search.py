"""Ranked lexical search with a document FP-tree.

Documents are reduced to the terms that some item asks for, ordered by document frequency. A task sorts the vectors of its documents
into tries, in which documents with the same frequent terms share their path. Every node knows the largest frequency of each term and
the smallest length factor below it, which bounds what any document below can score; for each item a depth-first walk takes the most
promising branch first and cuts branches that cannot reach the k-th best score any more. Tasks send k rows an item, and k of these stay."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listtide.operators.skew import top_per_key

from .contamination import blocks
from .tables import table, written
from .words import ALNUM, chunks, words

TOP = 10
#: Text of items that are searched for in one pass over the documents, in bytes; more goes into further passes.
BLOCK_BYTES = 4 << 20
#: Documents of one tree, documents of one leaf, terms whose maxima are held at a time.
TREE_DOCS, LEAF_DOCS, TERMS_AT_ONCE = 16_384, 32, 8_192

_BITS = 20


@dataclass
class Items:
    """Items of one block: distinct term hashes, sorted, and each item's distinct terms as places in them."""

    vocabulary: np.ndarray
    lows: np.ndarray  # table of the low bits of the vocabulary
    terms: list[np.ndarray]

    @staticmethod
    def of(texts: list[str | None]) -> Items:
        found: list[np.ndarray] = []
        for _, _, data, offsets in chunks(pa.array(texts, type=pa.large_string())):
            w = words(data, offsets, ALNUM)
            found += [np.unique(w.hash[w.first[d]:w.first[d + 1]]) for d in range(len(offsets) - 1)]
        vocabulary = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
        lows = np.zeros(1 << _BITS, dtype=bool)
        lows[vocabulary & np.uint64((1 << _BITS) - 1)] = True
        return Items(vocabulary, lows, [np.searchsorted(vocabulary, f) for f in found])


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tfs) of the rows with a term: all their terms counted, and those of `items` with their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()),
                        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        mask, size = np.uint64((1 << _BITS) - 1), max(len(own.vocabulary), 1)
        for batch in batches:
            for row, stop, data, offsets in chunks(batch.column(1)):
                w = words(data, offsets, ALNUM)
                n = np.diff(w.first)
                at = np.flatnonzero(own.lows[w.hash & mask])
                place = np.searchsorted(own.vocabulary, w.hash[at])
                same = own.vocabulary[np.minimum(place, size - 1)] == w.hash[at] if len(own.vocabulary) else np.zeros(0, dtype=bool)
                at, place = at[same], place[same]
                doc = np.searchsorted(w.first, at, side="right") - 1
                key, tf = np.unique(doc * size + place, return_counts=True)
                first = np.searchsorted(key // size, np.arange(len(n) + 1))
                keep = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, stop - row), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array((key % size).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "tfs"]).filter(keep)

    return docs.select("doc_id", "text").mapInArrow(run, out)


@dataclass
class Weights:
    """What a task needs to score: totals, and of each term its place in the order by frequency and its weight."""

    docs: int
    words: int
    rank: np.ndarray  # term -> place in the order, most frequent first
    weight: np.ndarray  # place -> weight
    wanted: list[np.ndarray]  # item -> places of its terms, ascending


def weights(found: DataFrame, items: Items) -> Weights:
    """Totals over all documents; the frequencies brought to the driver are those of the block's terms."""
    docs, total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(items.vocabulary), dtype=np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect():
        df[term] = n
    order = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), dtype=np.int64)
    rank[order] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df[order].tolist()], dtype=np.int64)
    return Weights(docs, total or 0, rank, weight, [np.sort(rank[t[df[t] > 0]]) for t in items.terms])


class Tree:
    """Trie of the term vectors of some documents; nodes are numbered parents first.

    Documents are held in the order of their vectors, so a node is a range of them; of documents that agree in terms, frequencies
    and length factor only the `top` smallest ids are held, as no item can rank more of them. Branches of few documents are
    leaves, and neighbouring ones of a parent are put together up to LEAF_DOCS documents."""

    def __init__(self, ids: list, n: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, w: Weights, top: int):
        size = max(len(w.rank), 1)
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        place = w.rank[term]
        order = np.argsort(doc * size + place, kind="stable")
        place, tf = place[order], tf[order].astype(np.int64)
        m = 10 + (90 * n * w.docs) // max(w.words, 1)
        path, freq = (place + 1).astype(">u4").tobytes(), tf.astype(">u4").tobytes()
        keys = [(path[4 * a:4 * b], freq[4 * a:4 * b], x, i is None, 0 if i is None else i)
                for a, b, x, i in zip(first[:-1].tolist(), first[1:].tolist(), m.tolist(), ids, strict=True)]
        some, same, last = [], 0, None
        for d in sorted(range(len(ids)), key=keys.__getitem__):
            same = same + 1 if keys[d][:3] == last else 1
            last = keys[d][:3]
            if same <= top and keys[d][0]:
                some.append(d)
        pick = np.array(some, dtype=np.int64)
        lengths = (first[1:] - first[:-1])[pick]
        self.ids, self.m = [ids[d] for d in some], m[pick]
        self.first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        at = np.repeat(first[pick] - self.first[:-1], lengths) + np.arange(self.first[-1])
        self.place, self.tf = place[at], tf[at]
        self.value = (1_000_000_000 * self.tf) // (1000 * self.tf + 8 * np.repeat(self.m, lengths))
        self.parent: list[int] = []
        self.range: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._grow()
        self.least_m = np.array([self.m[a:b].min() for a, b in self.range], dtype=np.int64)
        leaf_of = np.zeros(len(some), dtype=np.int64)
        for k, (a, b) in enumerate(self.range):
            if not self.children[k]:
                leaf_of[a:b] = k
        self.leaf = np.repeat(leaf_of, lengths)

    def _grow(self) -> None:
        length = np.diff(self.first)
        waiting = [(0, len(length), 0, -1)] if len(length) else []
        while waiting:
            a, b, depth, parent = waiting.pop()
            node = len(self.range)
            self.parent.append(parent)
            self.range.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= LEAF_DOCS:
                continue
            # The order makes what first and last document share common to all: the path that they go together.
            left, right = (self.place[self.first[d] + depth:self.first[d + 1]] for d in (a, b - 1))
            shared = min(len(left), len(right))
            apart = np.flatnonzero(left[:shared] != right[:shared])
            depth += int(apart[0]) if len(apart) else shared
            longer = length[a:b] > depth
            if not longer.any():
                continue
            following = np.where(longer, self.place[np.minimum(self.first[a:b] + depth, len(self.place) - 1)], -1)
            edges = [0, *(np.flatnonzero(np.diff(following)) + 1).tolist(), b - a]
            start = 0
            for k in range(1, len(edges)):
                if k + 1 == len(edges) or edges[k + 1] - edges[start] > LEAF_DOCS:
                    waiting.append((a + edges[start], a + edges[k], depth, node))
                    start = k

    def maxima(self, places: np.ndarray) -> np.ndarray:
        """(node, one of `places`): the largest frequency of the term below the node."""
        column = np.searchsorted(places, self.place)
        known = np.flatnonzero(places[np.minimum(column, len(places) - 1)] == self.place)
        out = np.zeros((len(self.range), len(places)), dtype=np.int32)
        np.maximum.at(out, (self.leaf[known], column[known]), self.tf[known])
        for k in range(len(self.range) - 1, 0, -1):
            np.maximum(out[self.parent[k]], out[k], out=out[self.parent[k]])
        return out

    def bounds(self, most: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The most that any document below each node can score with terms of these maxima and weights."""
        tf = most.astype(np.int64)
        return ((1_000_000_000 * tf) // (1000 * tf + 8 * self.least_m[:, None])) @ weight

    def search(self, places: np.ndarray, limit: np.ndarray, weight: np.ndarray, best: list[tuple], top: int) -> list[tuple]:
        """The `top` best of `best` and of this tree's documents, as (-score, id is null, id); `weight` is by place, 0 elsewhere."""
        waiting = [0] if self.range else []
        while waiting:
            node = waiting.pop()
            least = -best[-1][0] if len(best) == top else 1
            if limit[node] < least:
                continue
            if self.children[node]:
                waiting += sorted(self.children[node], key=limit.__getitem__)
                continue
            a, b = self.range[node]
            e = slice(self.first[a], self.first[b])
            score = np.add.reduceat(weight[self.place[e]] * self.value[e], self.first[a:b] - self.first[a])
            good = np.flatnonzero(score >= least)
            if len(good):
                best = sorted([*best, *((-int(score[g]), (i := self.ids[a + g]) is None, 0 if i is None else i) for g in good)])[:top]
        return best

    def answer(self, w: Weights, best: list[list[tuple]], top: int) -> None:
        """Bring the best of all items up to date with this tree's documents."""
        weight = np.zeros(len(w.weight), dtype=np.int64)
        for some in _groups(w.wanted):
            places = np.unique(np.concatenate([w.wanted[i] for i in some]))
            most = self.maxima(places) if len(places) <= TERMS_AT_ONCE else None
            for i in some:
                mine = w.wanted[i]
                if most is not None:
                    limit = self.bounds(most[:, np.searchsorted(places, mine)], w.weight[mine])
                else:
                    parts = [mine[k:k + TERMS_AT_ONCE] for k in range(0, len(mine), TERMS_AT_ONCE)]
                    limit = sum(self.bounds(self.maxima(p), w.weight[p]) for p in parts)
                weight[mine] = w.weight[mine]
                best[i] = self.search(mine, limit, weight, best[i], top)
                weight[mine] = 0


def _groups(wanted: list[np.ndarray]) -> Iterator[list[int]]:
    """Items in runs that have together at most TERMS_AT_ONCE terms (or one item with more); items without known terms are left out."""
    some: list[int] = []
    total = 0
    for i, terms in enumerate(wanted):
        if not len(terms):
            continue
        if some and total + len(terms) > TERMS_AT_ONCE:
            yield some
            some, total = [], 0
        some.append(i)
        total += len(terms)
    if some:
        yield some


def ranked(found: DataFrame, w: Weights, top: int) -> DataFrame:
    """(item, doc_id, score) of the best `top` documents of each task for each item, from the rows of vectors()."""
    shared = found.sparkSession.sparkContext.broadcast(w)
    kind = found.schema["doc_id"].dataType
    out = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best: list[list[tuple]] = [[] for _ in own.wanted]
        waiting: list[pa.RecordBatch] = []
        kinds = None

        def build() -> None:
            if not waiting:
                return
            rows = pa.Table.from_batches(waiting).combine_chunks()
            terms, tfs = (pa.concat_arrays(rows.column(c).chunks) for c in ("terms", "tfs"))
            first = terms.offsets.to_numpy().astype(np.int64)
            tree = Tree(rows.column("doc_id").to_pylist(), rows.column("n").to_numpy(), first - first[0],
                        terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(), own, top)
            tree.answer(own, best, top)
            waiting.clear()

        for batch in batches:
            kinds = batch.schema.field("doc_id").type
            for k in range(0, batch.num_rows, TREE_DOCS):
                part = batch.slice(k, TREE_DOCS)
                if sum(b.num_rows for b in waiting) + part.num_rows > TREE_DOCS:
                    build()
                waiting.append(part)
        build()
        rows = [(i, None if null else doc, -score) for i, some in enumerate(best) for score, null, doc in some]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, kinds), pa.array(score, pa.int64())],
                                             names=["item", "doc_id", "score"])

    return found.mapInArrow(run, out)


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of `benchmark` its `top` documents of highest score above 0.

    Terms, weights and scores are whole numbers as the formulas of weights() and Tree say; equal scores rank by ascending doc_id,
    rows without doc_id behind them. Null or empty texts hold no term: such documents are counted nowhere, such items have no rows.
    Repeated rows of either table count and answer each for itself. Other columns are not read. No documents give no rows."""
    spark = docs.sparkSession
    kinds = (benchmark.schema["item_id"], docs.schema["doc_id"])
    out = T.StructType([kinds[0], T.StructField("rank", T.IntegerType()), kinds[1], T.StructField("score", T.LongType())])
    parts = []
    for rows in blocks(benchmark, block_bytes):
        items = Items.of([r[1] for r in rows])
        if not len(items.vocabulary):
            continue
        found = written(vectors(docs, items), "search_vectors")
        best = top_per_key(ranked(found, weights(found, items), top), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], top, "doc_id")
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), kinds[0]]))
        # The list of names is one block's, so its size is bounded.
        part = best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        parts.append(part)
    if len(parts) > 1:
        parts = [written(p, "search_found") for p in parts]
    result = parts[0] if parts else spark.createDataFrame([], out)
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
d AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
it AS (SELECT q, unnest(w) AS term FROM i),
dt AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM dt GROUP BY term),
wt AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, totals),
s AS (
  SELECT q, d.r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM it JOIN wt USING (term) JOIN dt USING (term) JOIN d ON d.r = dt.r, totals GROUP BY ALL),
best AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best JOIN i USING (q) WHERE rank <= 10
"""
