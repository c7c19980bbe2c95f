"""Filter audit: every order replayed row by row, and odd rows."""

import itertools
import random

from pyspark.sql import functions as F

from listtide.llm import audit

FILTERS = "ABCDE"


def replay(docs, labels):
    """Brute force: each document goes through each order of the filters."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)}
        rows.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys(FILTERS, 0)
        for order in itertools.permutations(FILTERS):
            alive = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if r[1][f]]
                dead_before = len([r for r in mine if r[1][f]]) - len(gone)
                alive = [r for r in alive if not r[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), dead_before, sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "part": F.lit("x"), "digest": F.lit(2), "cell": F.lit(3)}),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")))


def found(spark, docs, labels):
    rows = audit.interactions(audit.cells(*frames(spark, docs, labels))).collect()
    out = {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in rows}
    assert len(out) == len(rows)
    return out


def test_all_orders_against_replay(spark, no_broadcast):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "Two", "THREE", "4", "five$", "six"]) for _ in range(rng.choice([0, 3, 120]))) for _ in range(12)]
    texts += [" ".join(f"w{k}" for k in range(n)) + end for n in (99, 100, 130) for end in ("", " |", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 9)]
    texts += [None, "", " \t", "é" * 10 + "A", "x " * 5000]
    docs = [(rng.choice([i, i, i % 7]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), docs[3], docs[3]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(90)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    assert found(spark, docs, labels) == replay(docs, labels)


def test_hot_text(spark, no_broadcast):
    docs = [(i, "the same words", "en" if i % 3 else None) for i in range(400)]
    assert found(spark, docs, [(0, 1, 0), (7, 1, 1)]) == replay(docs, [(0, 1, 0), (7, 1, 1)])


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "a", "en")], [])["en", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
