"""Ranked search against scoring of every document."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from listtide.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def score_all(docs, items, top=10):
    terms = [WORD.findall((t or "").translate(LOWER)) for _, t in docs]
    alive = [k for k, t in enumerate(terms) if t]
    n_docs, n_words = len(alive), sum(len(terms[k]) for k in alive)
    df = {}
    for k in alive:
        for w in set(terms[k]):
            df[w] = df.get(w, 0) + 1
    out = []
    for item_id, text in items:
        asked = set(WORD.findall((text or "").translate(LOWER))) & df.keys()
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in asked}
        scored = []
        for k in alive:
            m = 10 + (90 * len(terms[k]) * n_docs) // n_words
            s = sum(weight[w] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)) for w in asked if (tf := terms[k].count(w)))
            if s > 0:
                scored.append((-s, docs[k][0] is None, docs[k][0] or 0))
        out += [(item_id, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "score": F.lit(1), "item_id": F.lit(2)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(0), "doc_id": F.lit(1)})
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(d, b, **options).collect()], key=repr)


def corpus(rng, n):
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünder", "Straße", "x1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 80])))) for i in range(n)]


@pytest.mark.parametrize("tree,leaf,terms", [(16_384, 32, 8192), (50, 4, 7), (7, 1, 3)])
def test_against_all_documents(spark, monkeypatch, tree, leaf, terms):
    monkeypatch.setattr(search, "TREE_DOCS", tree)
    monkeypatch.setattr(search, "LEAF_DOCS", leaf)
    monkeypatch.setattr(search, "TERMS_AT_ONCE", terms)
    rng = random.Random(tree)
    docs = corpus(rng, 300)
    docs += [(1000 + k, docs[5][1]) for k in range(80)] + [(None, docs[5][1])] * 3 + [docs[9]] * 4  # copies, null ids, repeated rows
    docs += [(2000, None), (2001, ""), (2002, "?!"), (2003, "w0 " * 5000 + "w59"), (2004, "W0, w1")]
    items = [(k, t) for k, t in corpus(rng, 25)] + [(3, "w2 w2 W2"), (None, "w5"), (30, None), (31, ""), (32, "unknown"), (33, "unknown w3"), (34, docs[5][1])]
    assert found(spark, docs, items) == score_all(docs, items)


def test_blocks_of_items(spark):
    rng = random.Random(1)
    docs, items = corpus(rng, 60), corpus(rng, 12)
    assert found(spark, docs, items, block_bytes=300) == score_all(docs, items)
    assert found(spark, docs, items, top=3) == score_all(docs, items, top=3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, "!")], [(1, "a")]) == []


def test_bounds_hold_and_branches_are_cut():
    import numpy as np

    rng = random.Random(2)
    docs = corpus(rng, 2000)
    terms = [WORD.findall(t.translate(LOWER)) for _, t in docs]
    items = search.Items.of([t for _, t in corpus(rng, 5)])
    by_hash = {w: int(search.Items.of([w]).vocabulary[0]) for w in {w for t in terms for w in t}}
    place = {int(h): k for k, h in enumerate(items.vocabulary)}
    vectors = [sorted({place[by_hash[w]] for w in t if by_hash[w] in place}) for t in terms]
    df = np.bincount([x for v in vectors for x in v], minlength=len(place))
    order = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), dtype=np.int64)
    rank[order] = np.arange(len(df))
    w = search.Weights(len(docs), sum(map(len, terms)), rank, np.full(len(df), 100), [np.sort(rank[t]) for t in items.terms])
    inverse = {v: k for k, v in place.items()}
    names = {v: k for k, v in by_hash.items()}
    tf = [t.count(names[inverse[x]]) for t, v in zip(terms, vectors) for x in v]
    first = np.cumsum([0, *map(len, vectors)])
    tree = search.Tree([d for d, _ in docs], np.array([len(t) for t in terms]), first, np.array([x for v in vectors for x in v]), np.array(tf), w, 10)
    assert len(tree.range) > 20 and all(p < k for k, p in enumerate(tree.parent))
    mine = w.wanted[0]
    limit = tree.bounds(tree.maxima(mine), w.weight[mine])
    weight = np.zeros(len(rank), dtype=np.int64)
    weight[mine] = 100
    each = np.add.reduceat(weight[tree.place] * tree.value, tree.first[:-1])
    assert all(each[a:b].max() <= limit[k] for k, (a, b) in enumerate(tree.range))
    visited = []
    watched = type("Watched", (list,), {"__getitem__": lambda self, k: visited.append(k) or list.__getitem__(self, k)})
    tree.range = watched(tree.range)
    best = tree.search(mine, limit, weight, [], 10)
    assert [-s for s, _, _ in best] == sorted(each.tolist(), reverse=True)[:10]
    leaves = sum(not c for c in tree.children)
    assert len(visited) < leaves
