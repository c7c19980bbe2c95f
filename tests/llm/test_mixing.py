"""Language-model scores: base by brute force, bit counts by brute force, codes that add up to one, odd rows."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listtide.llm import mixing

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def check_base(docs, rows):
    count = Counter(t for i, x in docs if not out(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, x in docs:
        ts = tokens(x)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        want[i, out(i), len(ts), sum(count[t] > 0 for t in ts), n, round(base, 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want


def test_base_and_model_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = mixing.score(docs).collect()
    check_base([tuple(r) for r in docs.collect()], rows)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) * math.log2(10) / -sum(r.n_bytes for r in held) < 3.2  # bits a byte


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 2000)
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab  cd\nef"), (4, "Ab  cd\nef"), (None, "ab"), (None, None), (5, "é ñ Ñ"), (6, "ab cd " * 3000), (7, "x" * 5000),
            (8, "\x00 \x01"), *[(10 + k, "the same text") for k in range(60)]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "chunk": F.lit(7), "blob": F.lit("b"), "rest": F.lit(1)})
    rows = mixing.score(frame).collect()
    check_base(docs, rows)
    assert mixing.score(frame).select(*rows[0].asDict()).count() == len(docs)
    assert {r.chunk for r in rows} == {7} and {r.blob for r in rows} == {"b"}
    same = {r.score for r in rows if r.doc_id is not None and r.doc_id >= 10}
    assert len(same) == 1 and all(math.isfinite(r.score) for r in rows)
    assert [r.n_bytes for r in rows if r.doc_id == 2] == [1]


def test_no_rows_and_no_training_rows(spark):
    assert mixing.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = [i for i in range(40) if out(i)][:3]
    rows = mixing.score(spark.createDataFrame([(i, "ab c") for i in only], "doc_id long, text string")).collect()
    assert [r.base_score for r in rows] == [0.0] * 3 and {r.n_known for r in rows} == {0}
    assert all(abs(r.bits_per_byte - 8) < 1.5 for r in rows)


def test_streams_and_keys():
    texts = ["", " ", "Ab  cd\nef", "x", None, "é ñ", " lead trail ", "aaa bbb aaa"]
    s = mixing.stream(pa.array(texts, pa.string()))
    words = [[w.encode() for w in tokens(t)[:-1]] for t in texts]
    assert s.data.tobytes() == b"\xff" * 4 + b"".join(b"".join(w + b" " for w in ws) + b"\xff" * 4 for ws in words)
    dictionary, number = mixing.stream_words(s)
    assert [dictionary[i].as_py() for i in number] == [x for ws in words for x in (*(w + b" " for w in ws), b"\xff" * 4)]
    places = mixing.scored_places(s)
    keys, entry = mixing.context_entries(s.data, places)
    assert keys[entry].tolist() == [int.from_bytes(s.data[i - 4:i + 1].tobytes(), "big") for i in places]
    assert (np.diff(keys) > 0).all()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_bit_counts_against_counting(order):
    rng = np.random.default_rng(order)
    keys = np.unique(sum(rng.choice([97, 98, 101, 226], 400).astype(np.int64) << (8 * k) for k in range(5)))
    n = rng.integers(0, 9, len(keys)).astype(float)
    got = mixing.bit_counts(keys, n, order)
    mask = (1 << (8 * order)) - 1
    for i in range(0, len(keys), 17):
        for bit in range(8):
            same = (((keys >> 8) & mask) == ((keys[i] >> 8) & mask)) & ((keys & 255) >> (8 - bit) == (keys[i] & 255) >> (8 - bit))
            ones = (keys >> (7 - bit)) & 1
            want = [n[same & (ones == v)].sum() for v in (0, 1)]
            for a, b in zip(mixing._COUNT[got[i, bit]], want, strict=True):  # half a step of a sixteenth of a doubling, and rounding
                assert a == b if b <= 10 else abs(a - b) <= (2 ** (1 / 16) - 1) * (b + 1) + 0.5


def test_probabilities_of_a_byte_add_up_to_one():
    """Whatever came before, the 256 next bytes share a probability of one: all bits are predicted from what is behind them."""
    rng = np.random.default_rng(5)
    context = 97 << 24 | 98 << 16 | 99 << 8 | 100
    keys = (context << 8) | np.arange(256, dtype=np.int64)
    counts = rng.integers(0, 50, 256) * (rng.random(256) < 0.2)
    stats = np.stack([mixing.bit_counts(keys, counts.astype(float), o) for o in range(1, 5)], axis=1)
    mixer = rng.normal(0.3, 0.2, (mixing._GATES, mixing._INPUTS))
    parts = mixing.quantised_parts(stats, keys, mixer).transpose(1, 2, 0)
    lengths = mixing.code_lengths(np.arange(256), np.arange(257), parts)
    assert abs(np.exp(lengths.astype(float)).sum() - 1) < 1e-3


def test_model_grows_with_the_corpus(spark):
    """More training text means more contexts and fewer bits for held-out texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    few = mixing.score(docs.where("doc_id % 10 = 0 OR crc32(cast(doc_id AS string)) % 5 = 1")).where("held_out").agg(F.sum("score")).first()[0]
    sums = {r[0]: r[1:] for r in mixing.score(docs).groupBy("held_out").agg(F.sum("score"), F.sum("base_score")).collect()}
    assert sums[True][0] > few and sums[False][0] > sums[False][1]


def test_weights_come_from_all_training_texts(spark):
    """The sums that Spark adds up are those over every occurrence in every training text, however many and however long they are."""
    texts = [f"room {k} with a garden and a piano, number {k * k}" for k in range(400)] + ["a long text about rooms " * 500]
    s = mixing.stream(pa.array(texts, pa.string()))
    keys, entry = mixing.context_entries(s.data, mixing.scored_places(s))
    n = np.bincount(entry, minlength=len(keys))
    counts = spark.createDataFrame(pa.table({"key": keys, "n": n})).repartition(5)
    mixer = mixing.start_mixer()
    got = mixing._error_sums(mixing._statistics(counts), mixer)
    stats = np.stack([mixing.bit_counts(keys, n.astype(float), o) for o in range(1, mixing.ORDERS + 1)], axis=1)[entry]
    bits = mixing.bits_of(keys[entry])
    want = mixing.error_sums(*mixing.evidence(stats, bits), bits, np.ones(len(entry), dtype=np.float32), mixer)
    assert np.allclose(got, want, rtol=1e-3, atol=0.05)


def test_long_training_texts_are_learned_from(spark):
    """Texts of more than 8,000 bytes are all that there is to learn from."""
    docs = spark.createDataFrame([(k, "we let a room with a garden " * 400 + str(k)) for k in range(12)], "doc_id long, text string")
    rows = mixing.score(docs).collect()
    assert all(r.bits_per_byte < 0.05 for r in rows if not r.held_out)


def test_steps_lower_the_coding_error():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(97, 103, (600, 5)) @ (1 << 8 * np.arange(5)))
    n = rng.integers(1, 60, len(keys)).astype(np.float32)
    bits = mixing.bits_of(keys)
    inputs, gates = mixing.evidence(np.stack([mixing.bit_counts(keys, n.astype(float), o) for o in range(1, 5)], axis=1), bits)

    def error(mixer):
        margin = (inputs * mixer[gates]).sum(axis=2) * (2 * bits - 1)
        return float((n[:, None] * np.logaddexp(0, -margin)).sum())

    mixers = [mixing.start_mixer()]
    for _ in range(3):
        mixers.append(mixing.next_mixer(mixers[-1], mixing.error_sums(inputs, gates, bits, n, mixers[-1])))
    errors = [error(m) for m in mixers]
    assert errors[0] > errors[1] > errors[2] >= errors[3] - 1e-3


def plain_lengths(entry, parts):
    share, seen, out, done, block = np.ones(5), np.ones(5), [], 0, mixing.FIRST_BLOCK
    while done < len(entry):
        x = parts[:, :, entry[done:done + block]].astype(float)
        odds = np.exp(-np.clip((share[:, None, None] / 8 * x).sum(axis=0), -25, 25))
        out.append(-np.log1p(odds).sum(axis=0))
        gradient = (odds / (1 + odds) * x).sum(axis=(1, 2)) / 8
        seen += gradient * gradient
        share = np.clip(share + 0.1 * gradient / np.sqrt(seen), 0.3, 2.0)
        done, block = done + block, min(2 * block, mixing.LONGEST_BLOCK)
    return np.concatenate(out)


def test_code_lengths_hold_few_numbers_at_a_time():
    """Working numbers are those of some blocks, however much text there is; values are the same wherever a text stands."""
    rng = np.random.default_rng(8)
    parts = rng.integers(-40, 60, (5, 8, 700)).astype(np.int8)
    length = np.concatenate([[1, 31, 32, 33, 60_000], rng.integers(1, 6000, 400)])
    at = np.concatenate([[0], np.cumsum(length)])
    entry = rng.integers(0, 700, at[-1])
    tracemalloc.start()
    got = mixing.code_lengths(entry, at, parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(entry) + 12e6
    for i in (0, 1, 2, 3, 4, 17):
        assert np.allclose(got[at[i]:at[i + 1]], plain_lengths(entry[at[i]:at[i + 1]], parts), rtol=1e-3, atol=1e-4)
    back = mixing.code_lengths(np.concatenate([entry[a:b] for a, b in zip(at[-2::-1], at[:0:-1], strict=True)]), np.concatenate([[0], np.cumsum(length[::-1])]), parts)
    stop = np.cumsum(length[::-1])[::-1]
    assert all(np.array_equal(got[at[i]:at[i + 1]], back[stop[i] - length[i]:stop[i]]) for i in range(len(length)))


def test_scores_are_the_same_however_texts_are_sliced(monkeypatch):
    """Words are looked up for several slices at once; each slice gets the counts of its own words."""
    texts = pa.array([f"a room {k} with {k * k} gardens " * (k % 7) for k in range(150)], pa.binary())
    asked = mixing.Wanted()
    asked.add(texts.cast(pa.string()), np.arange(150) % 5 != 1)
    _, words, keys = asked.rows(0)
    key, n = keys.column(2), keys.column(3).to_numpy().astype(float)
    mixer = mixing.start_mixer()
    parts = mixing.quantised_parts(np.stack([mixing.bit_counts(key.to_numpy(), n, o) for o in range(1, 5)], axis=1), key.to_numpy(), mixer)
    rows = []
    for size, lookup in ((2 << 20, 8 << 20), (300, 1000), (1, 300)):
        monkeypatch.setattr(mixing, "SLICE", size)
        own = mixing.Answers()
        own.add_words(words.column(4), 2 * words.column(3).to_numpy())
        own.add_keys(key.to_numpy(), pa.array([p.tobytes() for p in parts], pa.binary()))
        table = pa.Table.from_batches([b for a, z, _, _ in mixing.chunks(texts, lookup)
                                       for b in own.score(texts.slice(a, z - a), pa.array(range(a, z)), mixing.Weights(mixer, int(n.sum())))])
        rows.append(table.to_pylist())
    assert rows[0] == rows[1] == rows[2] and [r["rest"] for r in rows[0]] == list(range(150))
