"""Suffixes, rules, windows, tokens and pseudonyms against brute force on hand-made texts."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listtide.llm import bpe, contamination, pseudonyms, quality, repeats, words

ODD = [None, "", " ", "\n", "a", "A a", "word " * 3000, "é ü", "x\x1cy   z", "same text twice here", "same text twice here", " ", "ab" * 700]


def frame(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def split(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_word_hashes_follow_the_bytes():
    import pyarrow as pa
    texts = pa.array(["One two", None, "two  ONE\ttwo", ""])
    (_, _, data, offsets), = words.chunks(texts)
    w = words.words(data, offsets)
    assert w.first.tolist() == [0, 2, 2, 5, 5]
    one, two = w.hash[0], w.hash[1]
    assert w.hash.tolist() == [one, two, two, one, two] and one != two
    assert w.stems(2)[0] != w.hash[0] and w.stems(9)[0] == w.hash[0]


# ---- contamination --------------------------------------------------------------------------------------------

def hits(docs, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wanted = collections.defaultdict(set)
    for item, text in items:
        w = split(text, pattern)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[p:p + n])].add(item)
    out = []
    for doc, text in docs:
        w = split(text, pattern)
        hit, found = set(), set()
        for n in {len(k) for k in wanted}:
            for p in range(len(w) - n + 1):
                if (own := wanted.get(tuple(w[p:p + n]))):
                    hit |= set(range(p, p + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination_matches_all_windows(spark, block_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta", "épsilon", "7"])
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 25)))) for k in range(12)] + [(3, "one more text of item three here"), (90, None), (91, "?!"), (None, "nobody owns this")]
    texts = list(ODD)
    for _ in range(40):
        base = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            base[5:5] = re.sub("[^ \\w]", "", rng.choice(items)[1] or "").split()
        texts.append(", ".join(base))
    docs = frame(spark, texts).withColumn("items", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    got = contamination.find(docs, benchmark, block_bytes=block_bytes)
    rows = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.hit_spans), list(r["items"])) for r in got.collect()), key=str)
    assert rows == hits(list(enumerate(texts)), items)


def test_longest_match_and_removal(spark):
    text = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"
    docs = frame(spark, ["x y " + text + " z", "clean words only"])
    benchmark = spark.createDataFrame([(1, "q " + text)], "item_id long, text string")
    found = {r.doc_id: r.matches for r in contamination.find(docs, benchmark).collect()}
    assert [tuple(m) for m in found[0]] == [("1", 2, 1, 13)] and found[1] == []
    assert [r.doc_id for r in contamination.decontaminate(docs, benchmark).collect()] == [1]
    assert contamination.decontaminate(docs, benchmark.limit(0)).count() == 2
    assert contamination.find(docs.limit(0), benchmark).count() == 0


# ---- repeats --------------------------------------------------------------------------------------------------

def spans(docs, length=50):
    holders = collections.defaultdict(set)
    for doc, text in docs:
        w = split(text)
        for p in range(len(w) - length + 1):
            holders[tuple(w[p:p + length])].add(doc)
    out = set()
    for doc, text in docs:
        w = split(text)
        hit = [p for p in range(len(w) - length + 1) if len(holders[tuple(w[p:p + length])]) > 1]
        for k, p in enumerate(hit):
            if k == 0 or p - hit[k - 1] > length:
                start = p
            if k + 1 == len(hit) or hit[k + 1] - p > length:
                out.add((doc, start, p + length))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_all_windows(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(50)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 130, 200)]
    texts = list(ODD)
    for _ in range(60):
        parts = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += p[a:] if rng.random() < 0.5 else p[:len(p) - a]
            parts += [word() for _ in range(rng.randint(0, 4))]
        texts.append(" ".join(parts))
    texts += [texts[-1], ("q " * 200), " ".join(passages[5]).upper()]
    docs = list(enumerate(texts)) + [(None, " ".join(passages[4])), (None, " ".join(passages[4]))]
    got = repeats.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert sorted({(r.doc_id, r.start, r.stop) for r in got.collect()}, key=str) == spans(docs)


def test_repeats_of_nothing(spark):
    assert repeats.repeated_spans(frame(spark, ["x"]).limit(0)).count() == 0
    assert repeats.repeated_spans(frame(spark, ["word " * 300])).count() == 0  # inside one document only


# ---- quality --------------------------------------------------------------------------------------------------

def test_base_counts_and_divergence(spark):
    rng = random.Random(3)
    common = ["the", "of", "and", "to", "in"]
    plain = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else "w" + rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(n))
    texts = [plain(rng.randint(250, 400)) for _ in range(60)] + ODD + [" ".join(w + "$#%" for w in plain(200).split()), " ".join(f"{rng.random():.6f}" for _ in range(200)),
                                                                 "line one\nline two\n\nline one\n \nline one\nline two "]
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 60, "xx")).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        count = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        rep = set()
        for i in range(len(w) - 7):
            if count[tuple(w[i:i + 8])] > 1:
                rep |= set(range(i, i + 8))
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(rep)), t
        assert r.base_failed == (len(w) < 20 or 100 * len(rep) > 30 * len(w))
    assert all(got[k].kept for k in range(60)) and not got[60 + len(ODD)].kept and not got[61 + len(ODD)].kept
    assert quality.judge(docs.limit(0)).count() == 0


def test_distance_of_histograms():
    p = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]])
    d = quality.js_distance(p, np.array([0.0, 1.0]))
    assert d[0] == 1.0 and 0 < d[1] < 1 and d[2] == 0.0


# ---- tokens ---------------------------------------------------------------------------------------------------

def test_tokens_equal_the_library(spark):
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["  lead", "trail  ", "a  b", "a\n b", "it's we'll 'd", "1234 ½", "aaa " * 50, "日本語 テスト", "😀 😀😀", "<|endoftext|>", "a" * 2000, "é́ x", "x\r\n y"]
    texts += ["".join(rng.choice("ab c\n  é'sé\t.1½") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = frame(spark, texts).withColumn("ids", F.lit(1))
    coded = {r.doc_id: r for r in bpe.encode_decode(docs, *bpe.public_vocabulary()).collect()}
    digests = {r.doc_id: r for r in bpe.digest(bpe.encode_decode(docs, *bpe.public_vocabulary())).collect()}
    for k, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert np.frombuffer(bytes(coded[k].ids), dtype="<u4").tolist() == want, t
        assert bytes(coded[k].decoded) == (t or "").encode()
        assert digests[k].n_tokens == len(want) and digests[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), *bpe.public_vocabulary()).count() == 0


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    coder = bpe.Coder(*bpe.public_vocabulary())
    texts = ["one two three four five", "five four three", "six seven", "one two"]
    alone = [coder.texts(pa.array([t])) for t in texts]
    assert [a[0][0] for a in alone] == bpe.Coder(*bpe.public_vocabulary()).texts(pa.array(texts))[0]


def test_decoding_reads_the_ids(monkeypatch):
    coder = bpe.Coder(*bpe.public_vocabulary())
    monkeypatch.setattr(bpe, "SLICE_IDS", 3)
    single = coder.single.astype("<u4").tobytes()
    assert coder.decode([single, b"", single[:8]]) == [bytes(range(256)), b"", b"\x00\x01"] and coder.decode([]) == []
    assert coder.texts(pa.array(["one two é", None, "one three"]))[1] == ["one two é".encode(), b"", b"one three"]
    coder.recent[b" two"] = coder.recent[b" three"]  # a wrong entry of the word memory shows in what comes back
    assert coder.texts(pa.array(["one two"]))[1] == [b"one three"]


# ---- pseudonyms -----------------------------------------------------------------------------------------------

def luhn(digits):
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    texts = ODD + [f"pay {card}, again 4111-1111-1111-1111.", f"to {iban}", "born 2024-02-29 or 31.12.1999", "no day 2023-02-30", "call +1 (017) 555-7713 now",
                   "from 97.51.17.173 not 300.1.1.1", "mail john.Smith-99@mail.example.com", "id 123-45-6789, bad 666-45-6789", "version 2.0 of 4"]
    docs = frame(spark, texts).withColumn("pseudonyms", F.lit("clash"))
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    n = len(ODD)
    assert all(got[k].text == texts[k] and not got[k].pseudonyms for k in (*range(n), n + 3, n + 8))
    a, b = re.findall(r"\d{4}(?:[ -]\d{4}){3}", got[n].text)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != re.sub(r"\D", "", card) and luhn(re.sub(r"\D", "", a)) and "-" in b
    bare = re.sub(" ", "", got[n + 1].text[3:])
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 and bare.startswith("DE")
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d or \d\d\.\d\d\.\d{4}", got[n + 2].text) and "2024-02-29" not in got[n + 2].text
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} now", got[n + 4].text)
    assert got[n + 5].text.endswith("not 300.1.1.1") and "97.51.17.173" not in got[n + 5].text
    assert re.fullmatch(r"mail [a-z]{4}\.[A-Z][a-z]{4}-\d\d@mail\.example\.com", got[n + 6].text)
    assert got[n + 7].text.endswith("bad 666-45-6789") and [p.kind for p in got[n + 7].pseudonyms] == ["ssn"]
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs, "other").collect()}
    assert other[n] != got[n].text and pseudonyms.pseudonymise(docs.limit(0), "k").count() == 0


def test_unchecked_numbers_stay_and_phones_and_dates_keep_links(spark):
    stay = ["isbn 9780306406158 here", "rows 1 2 3 4 5 6 7 8 9 10 11 12 13", "at 1700000000000000001", "sum +5 10-20", "bad 25/13/2001"]
    phones = ["555-123-4567", "555.123.4567", "(555) 123-4567", "+1 555-123-4567", "+1555 123 4567", "+44 20 7183 8750", "+442071838750", "+44-20-7183-8750", "+33 1 23 45 67 89"]
    dates = [f"{y}-{m:02}-{d:02}" for y in range(1990, 2000) for m in range(1, 13) for d in range(13, 29)]
    turned = [f"{t[8:]}/{t[5:7]}/{t[:4]}" for t in dates]
    got = [r.text for r in pseudonyms.pseudonymise(frame(spark, stay + phones + dates + turned).coalesce(1), "k").orderBy("doc_id").collect()]
    assert got[:len(stay)] == stay
    new = got[len(stay):len(stay) + len(phones)]
    shape = lambda t: re.sub("[0-9]", "9", t)
    digits = [re.sub("[^0-9]", "", t) for t in new]
    assert list(map(shape, new)) == list(map(shape, phones)) and all(a != b for a, b in zip(new, phones, strict=True))
    assert len({d[-10:] for d in digits[:5]}) == 1 and digits[3][0] == digits[4][0] == "1"
    assert len(set(digits[5:8])) == 1 and digits[5][:2] == "44" and digits[8][:2] == "33"
    iso, slash = got[-2 * len(dates):-len(dates)], got[-len(dates):]
    read = lambda t: f"{t[6:]}-{t[3:5]}-{t[:2]}" if t[:2] > "12" else f"{t[6:]}-{t[:2]}-{t[3:5]}"
    assert list(map(read, slash)) == iso and len(set(slash)) == len(dates)


def test_networks_are_permutations(spark):
    days = spark.range(pseudonyms.DAYS).select(F.date_format(F.date_add(F.lit(pseudonyms.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = pseudonyms.pseudonymise(days, "k")
    assert out.select("text").distinct().count() == pseudonyms.DAYS == out.where(F.size("pseudonyms") == 1).count()
    codes = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert codes.select(pseudonyms.permuted(F.col("v"), "k", "t").alias("v")).distinct().count() == 10_000
