"""Quality rules: base counts, and the divergence of a document from its language's references.

Two passes over the texts. The first counts character classes and words per language over all documents that pass the base
rules; the most frequent words of each language and its class counts are its references. The second compares each document with
the references of its language (or the nearest one, where it has none) by Jensen-Shannon distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import small_batches, table, written
from .words import SPACED, chunks, grams, mix, signed, words

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Words in a language's reference; each must make up at least COMMON_SHARE of its words, so a language has at most 1 / COMMON_SHARE candidates.
COMMON_WORDS, COMMON_SHARE = 50, 1 / 2000
#: The most languages that can have references; more are an error, as none may silently be judged by others'.
LANGUAGES = 2000
#: Largest distances of a kept document: a base and a part that falls with the square root of its words, as the histograms of
#: short texts scatter; and the lengths below which a histogram says too little to judge by.
CLASS_DISTANCE, CLASS_SCATTER, MIN_CHARS = 0.2, 1.0, 200
WORD_DISTANCE, WORD_SCATTER, MIN_COMPARED_WORDS = 0.36, 0.6, 50
#: Distinct words that a task gathers before it passes them on.
FLUSH = 500_000

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "beyond_ascii")
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    """Class of each byte; continuation bytes of UTF-8 have none (8)."""
    c = np.full(256, CLASSES.index("other"), dtype=np.int64)
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    c[[9, 10, 11, 12, 13, 32]] = CLASSES.index("space")
    c[list(b".,;:!?'\"()-")] = CLASSES.index("stop")
    c[list(SYMBOLS)] = CLASSES.index("symbol")
    c[128:192], c[192:] = len(CLASSES), CLASSES.index("beyond_ascii")
    return c


CLASS_OF = _classes()
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def measure(data: np.ndarray, offsets: np.ndarray):
    """Words of a chunk, and per document: word_chars, n_symbols, n_dup_lines, n_repeat_words and the class counts."""
    w = words(data, offsets, SPACED, lower=False)
    docs = len(offsets) - 1
    byte_doc = np.repeat(np.arange(docs), np.diff(offsets))
    kinds = np.bincount(byte_doc * 9 + CLASS_OF[data], minlength=docs * 9).reshape(docs, 9)[:, :8]
    word_chars = kinds.sum(axis=1) - kinds[:, CLASSES.index("space")]
    lines = words(data, offsets, _LINE, lower=False)
    full = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    dup_lines = np.zeros(docs, dtype=np.int64)
    if full.any():
        of = lines.doc()[full]
        key = mix(lines.hash[full] ^ mix(of.astype(np.uint64)))
        dup_lines = np.bincount(of, minlength=docs) - np.bincount(of[np.unique(key, return_index=True)[1]], minlength=docs)
    repeated = np.zeros(len(w.hash) + 1, dtype=np.int64)
    at, run = grams(w, REPEAT_WINDOW)
    if len(at):
        of = np.searchsorted(w.first, at, side="right") - 1
        _, inverse, counts = np.unique(mix(run ^ mix(of.astype(np.uint64))), return_inverse=True, return_counts=True)
        twice = at[counts[inverse] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + REPEAT_WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(repeated[:-1]) > 0)])
    return w, word_chars, kinds[:, CLASSES.index("symbol")], dup_lines, np.diff(inside[w.first]), kinds


def base_fails(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, class number or null, n): words by hash and classes by number, summed over what a task has read."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    classes: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, some in held.items():
            keys, n = _sum(some)
            yield _rows(lang, signed(keys), None, n)
        for lang, n in classes.items():
            yield _rows(lang, np.arange(len(n)), np.arange(len(n), dtype=np.int32), n)
        held.clear()
        classes.clear()

    for batch in batches:
        langs = np.array(["" if x is None else x for x in batch.column(1).to_pylist()], dtype=object)
        used = np.array([x is not None for x in batch.column(1).to_pylist()], dtype=bool)
        for row, stop, data, offsets in chunks(batch.column(0)):
            w, _, _, _, repeat, kinds = measure(data, offsets)
            fit = used[row:stop] & ~base_fails(np.diff(w.first), repeat)
            of = w.doc()
            for lang in set(langs[row:stop][fit].tolist()):
                mine = fit & (langs[row:stop] == lang)
                held.setdefault(lang, []).append(np.unique(w.hash[mine[of]], return_counts=True))
                classes[lang] = classes.get(lang, 0) + kinds[mine].sum(axis=0)
                if len(held[lang]) > 16:
                    held[lang] = [_sum(held[lang])]
            if sum(len(k) for some in held.values() for k, _ in some) > 4 * FLUSH:
                held.update({lang: [_sum(some)] for lang, some in held.items()})
                if sum(len(some[0][0]) for some in held.values()) > FLUSH:
                    yield from flush()
    yield from flush()


def _sum(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in some])).astype(np.int64)


def _rows(lang: str, key: np.ndarray, kind: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    kinds = pa.nulls(len(key), pa.int32()) if kind is None else pa.array(kind, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key, pa.int64()), kinds, pa.array(n, pa.int64())],
                                      names=["lang", "key", "kind", "n"])


@dataclass
class References:
    """Per language: class shares, and hashes and shares of its common words (the last share is that of all other words)."""

    languages: list[str]
    classes: np.ndarray
    hashes: list[np.ndarray]
    shares: list[np.ndarray]


def references(docs: DataFrame) -> References:
    """Counted over all rows of `docs` (text, lang) whose language is known and that pass the base rules; at most
    LANGUAGES * (COMMON_WORDS + classes) numbers."""
    small_batches(docs.sparkSession)
    counts = docs.select("text", "lang").mapInArrow(_count, "lang string, key long, kind int, n long")
    total = written(counts.groupBy("lang", "key", "kind").agg(F.sum("n").alias("n")), "quality_counts")
    size = total.where("kind IS NULL").groupBy("lang").agg(F.sum("n").alias("words"))
    top = {r[0]: r[1] for r in size.limit(LANGUAGES + 1).collect()}
    if len(top) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in column lang")
    if not top:
        return References([], np.zeros((0, len(CLASSES))), [], [])
    common = total.where("kind IS NULL").join(F.broadcast(size), "lang").where(F.col("n") >= F.col("words") * COMMON_SHARE)
    first = common.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= COMMON_WORDS)
    listed: dict[str, list[tuple[int, int]]] = {x: [] for x in top}
    for r in first.select("lang", "key", "n").orderBy("lang", "rank").collect():
        listed[r[0]].append((r[1], r[2]))
    kinds = {x: np.zeros(len(CLASSES)) for x in top}
    for r in total.where("kind IS NOT NULL").join(F.broadcast(size), "lang").select("lang", "kind", "n").collect():
        kinds[r[0]][r[1]] += r[2]
    names = sorted(top)
    shares = []
    for x in names:
        n = np.array([n for _, n in listed[x]], dtype=float)
        shares.append(np.append(n, top[x] - n.sum()) / top[x])
    return References(names, np.array([kinds[x] / kinds[x].sum() for x in names]),
                      [np.array([k for k, _ in listed[x]], dtype=np.int64).view(np.uint64) for x in names], shares)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of p from q; a row without mass is at 0."""
    total = p.sum(axis=1, keepdims=True)
    p = np.divide(p, total, out=np.tile(q, (len(p), 1)).astype(float), where=total > 0)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1), np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _judge(refs: References):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(refs.languages)}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for row, stop, data, offsets in chunks(batch.column(0)):
                w, chars, symbols, dup, repeat, kinds = measure(data, offsets)
                n, docs = np.diff(w.first), stop - row
                of = w.doc()
                own = np.array([number.get(x, -1) if x is not None else -1 for x in langs[row:stop]])
                class_at, word_at = np.full(docs, np.inf), np.full(docs, np.inf)
                for k, q in enumerate(refs.classes):
                    some = np.flatnonzero((own == k) | (own == -1))
                    if not len(some):
                        continue
                    class_at[some] = np.minimum(class_at[some], js_distance(kinds[some].astype(float), q))
                    listed = np.sort(refs.hashes[k])
                    bins = len(listed) + 1
                    spot = np.searchsorted(listed, w.hash)
                    spot = np.where(np.append(listed, 0)[spot] == w.hash, spot, bins - 1)
                    table = np.bincount(of * bins + spot, minlength=docs * bins).reshape(docs, bins)
                    share = np.append(refs.shares[k][:-1][np.argsort(refs.hashes[k])], refs.shares[k][-1])
                    word_at[some] = np.minimum(word_at[some], js_distance(table[some].astype(float), share))
                class_at[np.isinf(class_at)], word_at[np.isinf(word_at)] = 0, 0
                failed = base_fails(n, repeat)
                scatter = 1 / np.sqrt(np.maximum(n, 1))
                strange = ((class_at > CLASS_DISTANCE + CLASS_SCATTER * scatter) & (kinds.sum(axis=1) >= MIN_CHARS)) | (
                    (word_at > WORD_DISTANCE + WORD_SCATTER * scatter) & (n >= MIN_COMPARED_WORDS))
                out = [n, chars, symbols, dup, repeat]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, docs) for i in range(2, batch.num_columns)), *(pa.array(x, pa.int64()) for x in out),
                     pa.array(failed), pa.array(~failed & ~strange), pa.array(class_at), pa.array(word_at)],
                    names=[*batch.schema.names[2:], *MEASURES])

    return run


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def judge(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """The columns of `docs` other than its text, with MEASURES; `refs` are counted over `docs` itself by default.

    A null text counts as empty: no words, base_failed. A null or unlearned lang is compared with all references and the
    nearest one counts; without any reference both distances are 0. Columns of these names are replaced."""
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    refs = refs if refs is not None else references(docs)
    rest = [c for c in docs.columns if c not in ("text", *MEASURES)]
    frame = docs.select("text", F.col("lang").alias("_lang"), *rest)
    small_batches(docs.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*rest).schema)
    return frame.mapInArrow(_judge(refs), f"{kept}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                          "base_failed boolean, kept boolean, class_distance double, word_distance double")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("lang")
