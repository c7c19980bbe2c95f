"""Fitted operators, sharding and the pipeline: held-out accuracy, invariants, odd rows."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listtide.llm import bpe, jaccard, langid, secrets, sharding, toxicity

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n", "a", "12345 !!", "word " * 3000]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# ---- language -------------------------------------------------------------------------------------------------

def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs.select("doc_id", "text").withColumn("score", F.lit("clash")), langid.fit(docs))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(out) > 30 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(frame(spark, ODD), model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, 4)] == ["und"] * 4 and got[0].score == 0.0
    assert got[3].lang_pred in model.languages and got[5].lang_pred in model.languages
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(frame(spark, ["some text"]), empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 9, 40])
def test_codewords_lie_apart(n):
    codes = langid.codewords(n)
    far = min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i))
    assert far >= (1 if n == 2 else 2 if n < 5 else 4)
    wrong = np.where(np.arange(codes.shape[1]) == 0, -1, 1) * codes[n - 1] if n > 4 else codes[n - 1]
    model = langid.Model([str(k) for k in range(n)], codes, np.zeros((1, codes.shape[1])), np.full(codes.shape[1], 1 / codes.shape[1]))
    assert langid.decode(wrong[None, :], model)[0][0] == n - 1  # one wrong bit is corrected


# ---- toxicity -------------------------------------------------------------------------------------------------

def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(out) > 80 and np.mean([r.predicted == r.toxic for r in out]) > 0.93
    assert np.mean([r.predicted for r in out if not r.toxic]) < 0.03
    odd = {r.doc_id: r for r in toxicity.score(frame(spark, [*ODD, "you id1ot"]).withColumn("raw", F.lit(1)), model).collect()}
    assert len(odd) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd.values())
    assert odd[0].score == odd[1].score


def test_toxicity_without_labels(spark):
    docs = frame(spark, [*ODD, "plain words"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_features_find_hidden_words_and_nearness():
    import pyarrow as pa
    from listtide.llm.words import chunks
    lexicon, none = toxicity._hashes(["idiot"]), np.zeros(0, dtype=np.uint64)
    (_, _, data, offsets), = chunks(pa.array(["you are an Idiot!", "an 1d10t here", "calm words", None]))
    f = toxicity.features(data, offsets, lexicon, none, toxicity._hashes(["you"]))
    at = {name: k for k, name in enumerate(toxicity.FEATURES)}
    assert f[:, at["hits"]].tolist() == [1, 0, 0, 0] and f[:, at["near_address"]].tolist() == [1, 0, 0, 0]
    assert f[:, at["swapped_hits"]].tolist() == [0, 1, 0, 0]


# ---- secrets --------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_secrets_go_and_the_rest_stays(spark, forest):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [*ODD, f'before token = "{key}" after', f'password: "{key[:20]}Zz" and password: "{key[:20]}Zz"', "see https://host.example/docs/session/page12.html now",
             "number 4736962573099581 stays", "secret = maybe later", f"commit {key} done", "AKIA" + "Q7X2M9K4P1Z8W3R6"]
    docs = frame(spark, texts).withColumn("findings", F.lit("clash"))
    got = {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()}
    n = len(ODD)
    assert all(got[k] == texts[k] for k in (*range(n), n + 2, n + 3, n + 4, n + 5))
    assert got[n] == 'before token = "[SECRET]" after' and got[n + 1].count("[SECRET]") == 2 and key[:20] not in got[n + 1]
    assert got[n + 6] == "[SECRET]"
    assert secrets.redact(docs.limit(0), forest).count() == 0


def test_forest_as_an_expression(spark):
    text = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 1 <= 2.5)\n     Predict: 0.0\n    Else (feature 1 > 2.5)\n     If (feature 0 <= 0.5)\n      Predict: 1.0\n     Else (feature 0 > 0.5)\n      Predict: 0.0\n  Tree 1 (weight 1.0):\n    Predict: 1.0\n"
    trees = secrets.read_trees(text)
    assert trees == [[1, 2.5, [0.0], [0, 0.5, [1.0], [0.0]]], [1.0]]
    f = F.array(F.lit(0.0), F.lit(3.0))
    assert spark.range(1).select(secrets._vote(trees[0], f)).first()[0] == 1.0


def test_training_needs_no_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.redact(frame(spark, ['token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"']), secrets.train(empty)).first().text == 'token = "[SECRET]"'


# ---- sharding -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shards", [24, 5])
def test_shards_are_even_gapless_and_keep_groups(spark, shards):
    rng = random.Random(2)
    texts = [f"text {k}" for k in range(300) for _ in range(rng.choice([1, 1, 1, 2, 5]))] + ["hot"] * 400 + ODD
    rows = list(enumerate(texts)) + [(None, "text 1"), (7, "text 1"), (7, "text 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(5)
    out = sharding.assign(docs, shards).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(shards)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    text = dict(enumerate(texts))
    where, count = {}, {}
    for r in out:
        if r.doc_id is not None and r.doc_id != 7:
            assert r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
            where.setdefault(text[r.doc_id], set()).add(r.shard)
            count[text[r.doc_id]] = count.get(text[r.doc_id], 0) + 1
    hot = len(where.pop("hot"))
    assert hot <= shards and sum(len(s) - 1 for s in where.values()) <= 2 * shards  # a cut of the order splits a group at most


def test_shards_of_few_and_no_rows(spark):
    assert sharding.assign(frame(spark, []), 24).count() == 0
    out = sharding.assign(frame(spark, ["a", "a", None]), 24).collect()
    assert len(out) == 3 and {r.slot for r in out} == {0} and len({r.shard for r in out}) == 3


def test_quotas_bind_and_targets_follow_the_current_counts(spark):
    flow = np.zeros((3, 3, 4))
    flow[0, 2], flow[1, 2], flow[2, 0] = 10, 10, 5
    now = np.array([40.0, 40.0, 40.0])
    limit = sharding.admitted(flow, now, np.full(3, 50.0))
    sent = np.array([[flow[s, t, :limit[t]].sum() for t in range(3)] for s in range(3)])
    assert (now + sent.sum(axis=0) - sent.sum(axis=1) <= 50).all() and sent.sum() > 20
    rows = [(k, 0, s) for k in range(60) for s in (0, 0, 0, 1 + k % 3)]  # all would go to shard 0, which has room for a part of them
    at = spark.createDataFrame(rows, "group long, part int, shard int")
    units = sharding.propagate(at, np.full(4, 200.0), 3).collect()
    held = [sum(h.n for u in units for h in u.holds if h.shard == s) for s in range(4)]
    together = {u.holds[0].shard for u in units if len(u.holds) == 1}
    assert sum(held) == 240 and max(held) <= 200 and together > {0}
    assert sharding.propagate(at, np.full(4, 200.0), 0).where("size(holds) = 1").count() == 0


def test_a_hot_text_leaves_small_groups_whole(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"text {k // 6}") for k in range(9000)] + [(None, "hot")] * 600
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 24)
    sizes = [r[1] for r in out.groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 1 and out.select("shard", "slot").distinct().count() == len(rows)
    cut = sharding.cut_links(out.where(F.col("text_crc32") != zlib.crc32(b"hot"))).first()
    assert cut.links == 4500 and cut.cut <= 2 * 24


# ---- pipeline -------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in kept.collect()}
        path = str(tmp_path / name)
        stage(spark, kept, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == columns
        after = {(r.doc_id, r.text) for r in kept.collect()}
        if name == "secret_scan":
            assert {d for d, _ in after} == {d for d, _ in before}
        else:
            assert after <= before
        if name == "near_duplicates":
            pairs = jaccard.near_duplicates(spark.createDataFrame(sorted(before), "doc_id long, text string")).collect()
            assert {d for d, _ in after} == {r.component_id for r in pairs}
    final = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    coder = bpe.Coder(*bpe.public_vocabulary())
    want = {d: len(coder.texts(pa.array([t], pa.string()))[0][0]) // 4 for d, t in ((r.doc_id, r.text) for r in kept.collect())}
    assert {r.doc_id: r.n_tokens for r in final} == want
    if os.path.isdir(SF):
        assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(want)


def test_pipeline_stages_on_odd_rows(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(ODD)] + [(None, "no id", "en", "s", 1), (3, "a", None, None, None), (3, "a", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.where("doc_id IS NULL").count() == 1
        assert {r.doc_id for r in out.collect()} >= {0, 1, 2, 4, 5}
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF).where("doc_id = 3").count() == 1


def test_one_row_of_each_group_stays(spark):
    """Against brute force over all rows: different texts of one id, copies without ids, equal rows, rows that differ in other columns."""
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, "A a a a a a", "en"), (2, "A a a a a a", "en"), (2, "B b b b b b c", "en"), (None, long, "en"), (None, long + " x", "de"), (None, "only here", None),
            (7, "C", "en"), (7, "C", "de"), (7, "C", "de"), (8, None, "en"), (8, None, "en"), (9, "", None), (-3, "D d", "en"), (4, "D d", "en"), (None, "D d", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n_shingles": F.lit(1), "_worded": F.lit("x"), "component_id": F.lit(2)})
    out = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.lang) for r in out.collect()), key=repr)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    assert len(got) == len(set(group))
    kept_groups = [next(g for g, r in zip(group, rows) if r == k) for k in got if k[1]]
    assert sorted(kept_groups) == sorted({g for g, s in zip(group, sets) if s})
    for k in got:
        ids = [r[0] for g, r in zip(group, rows) if g == next(g for g, r in zip(group, rows) if r == k) and r[0] is not None]
        assert k[0] == (min(ids) if ids else None)
