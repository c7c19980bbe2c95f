"""N-gram Jaccard join against all pairs, with every branch forced by small limits."""

import random
import re

import pytest

from listtide.llm import jaccard


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)] = min(doc, groups.get(find(i), doc))
    return sorted(((doc, len(sets[i]), groups.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4, 9])):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                near += [rng.choice(vocabulary) for _ in range(rng.randint(1, max(1, len(base) // 4)))]
            texts.append(" ".join(near))
    hub = [rng.choice(vocabulary) for _ in range(50)]
    for k in range(60):
        near = list(hub)
        near[rng.randrange(50)] = f"x{k}"
        texts.append(" ".join(near))
    for k in range(40):
        texts.append(" ".join(passage + [f"y{k}_{i}" for i in range(rng.randint(5, 60))]))
    texts += ["The Same TEXT of many words, twice.", "the same text of many words, twice.", "a b", "A  b", "a b c", None, "", " \n\t", "x", "x"]
    rng.shuffle(texts)
    return list(enumerate(texts, start=100))


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"TREE_SETS": 6, "LEADS": 1}), (3, {"TREE_SETS": 10, "HOT": 1})])
def test_components_match_all_pairs(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = made(seed)
    rows += [(None, rows[3][1]), (rows[5][0], rows[5][1]), (rows[5][0], rows[6][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_second_round_alone_finds_every_link(spark, monkeypatch):
    """Without any link from the first round, the second one still connects all that is linked."""
    rows = made(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real, calls = jaccard._links, []

    def later(docs, groups):
        calls.append(1)
        return real(docs, groups) if len(calls) > 1 else spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(jaccard, "_links", later)
    monkeypatch.setattr(jaccard, "TREE_SETS", 8)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, key long, n string")
    assert jaccard.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "z"), (2, "a b c d e f", 6, None)], "doc_id long, text string, key long, n string")
    assert sorted(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_tree_yields_linked_pairs_only():
    import numpy as np
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
    sets = [np.sort(np.unique(np.concatenate([rng.choice(base, 190, replace=False), rng.integers(0, 1 << 63, 6).astype(np.uint64)]))) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(40)]
    tree = jaccard.Tree(sets, np.arange(len(sets)))
    pairs = list(tree.links())
    assert len(pairs) == 39
    assert all(len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j])) for i, j in pairs)
