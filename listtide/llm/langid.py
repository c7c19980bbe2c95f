"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. For each bit a binary classifier on character trigrams says which half of the
languages a text belongs to; its weights are the log-odds of the trigrams' shares in the two halves. Decoding adds up each
bit's logistic loss against every codeword, weighted by how reliable the bit is, and takes the nearest codeword; a close second
one marks the answer as ambiguous. Trigram counts come from a bounded sample per language, predictions from whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import held_out, small_batches, table
from .words import LOWER, chunks

#: Rows of each language that train, chosen by a hash of their id (about so many; all if there are fewer), and the most languages that
#: one model takes; more are an error, as none may silently be left out.
SAMPLE_ROWS, MAX_LANGUAGES = 4000, 2000
SLOTS = 1 << 15
SMOOTHING = 0.5
#: Steepness of the loss, and the least lead over the second codeword of a clear answer.
STEEPNESS, CLEAR_LEAD = 4.0, 0.2
UNDETERMINED = "und"

_SPACE = 32
_LETTER = np.full(256, _SPACE, dtype=np.uint8)
_LETTER[65:91] = LOWER[65:91]
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of each letter trigram; documents are set apart by a space that no trigram reaches across."""
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded = np.full(len(data) + len(offsets), _SPACE, dtype=np.uint8)
    padded[np.arange(len(data)) + docs + 1] = _LETTER[data]
    of = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), np.arange(1, len(padded) - 1), side="left") if len(data) else np.zeros(0, dtype=np.int64)
    if len(padded) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    edge = np.zeros(len(padded), dtype=bool)
    edge[offsets + np.arange(len(offsets))] = True
    good = ~edge[1:-1] & ((a != _SPACE) | (b != _SPACE) | (c != _SPACE))
    mixed = a[good].astype(np.uint32) * np.uint32(0x9E3779B1) + b[good].astype(np.uint32) * np.uint32(0x85EBCA6B) + c[good].astype(np.uint32) * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return of[good], (mixed >> np.uint32(17)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # slots x bits, scaled so that a typical text of a learned language is at about 1
    trust: np.ndarray  # per bit


def codewords(n: int) -> np.ndarray:
    """n distinct rows of -1 and 1 whose bits each split the languages: all splits for up to four languages, else the best of
    repeatable random codes by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 4:
        splits = [[1 if k == 0 or (s >> (k - 1)) & 1 else -1 for k in range(n)] for s in range((1 << (n - 1)) - 1)]
        return np.array(splits).T.astype(float)
    bits = 4 * int(np.ceil(np.log2(n))) + 7
    rng, best, found = np.random.default_rng(11), -1, None
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        gram = code @ code.T
        least = (bits - (gram - np.diag(np.full(n, np.inf))).max()) / 2
        if least > best:
            best, found = least, code
    return found


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """From text and non-null lang of the rows that are not held out; without such rows the model has no language."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column lang")
    if not sizes:
        return Model([], np.zeros((0, 1)), np.zeros((SLOTS, 1)), np.ones(1))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_rows / n))])[F.col("lang")]
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < share * (1 << 30)
    names = sorted(sizes)
    place = {x: k for k, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), SLOTS), dtype=np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for row, stop, data, offsets in chunks(batch.column(0)):
                of, slot = trigrams(data, offsets)
                total += np.bincount(lang[row:stop][of] * SLOTS + slot, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "n"])

    counts = rows.where(part).select("text", "lang").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(len(names) * SLOTS)
    for r in counts.toLocalIterator():  # at most languages * slots rows
        total[r[0]] = r[1]
    p = total.reshape(len(names), SLOTS) + SMOOTHING
    p /= p.sum(axis=1, keepdims=True)
    codes = codewords(len(names))
    weights, trust = np.zeros((SLOTS, codes.shape[1])), np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        yes, no = codes[:, b] > 0, codes[:, b] < 0
        if not no.any():
            continue
        weights[:, b] = np.log(p[yes].mean(axis=0)) - np.log(p[no].mean(axis=0))
        margin = codes[:, b] * (p @ weights[:, b])  # the mean margin of each language
        weights[:, b] /= max(np.abs(margin).mean(), 1e-9)
        trust[b] = max(float(margin.min() / max(np.abs(margin).mean(), 1e-9)), 0.05)
    return Model(names, codes, weights.astype(np.float32), trust / trust.sum())


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its score (0 to 1), and whether the answer is ambiguous."""
    loss = np.logaddexp(0, -STEEPNESS * model.codes[None, :, :] * np.clip(margins, -3, 3)[:, None, :])
    gain = -(loss * model.trust).sum(axis=2)
    best = gain.argmax(axis=1)
    odds = np.exp(STEEPNESS * (gain - gain.max(axis=1, keepdims=True)))
    odds /= odds.sum(axis=1, keepdims=True)
    top = np.sort(odds, axis=1)
    return best, top[:, -1], (top[:, -1] - top[:, -2] < CLEAR_LEAD) if odds.shape[1] > 1 else np.zeros(len(best), dtype=bool)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` other than its text, with lang_pred, score and ambiguous.

    `und` with score 0 stands for a null text, one without a letter, or a model without languages. Only the text is looked at;
    columns of the result's names are replaced."""
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "ambiguous")]
    frame = docs.select("text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"), *rest)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, stop, data, offsets in chunks(batch.column(0)):
                n = stop - row
                names, scores, doubt = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, dtype=bool)
                if model.languages:
                    of, slot = trigrams(data, offsets)
                    margins, count = np.zeros((n, model.codes.shape[1])), np.bincount(of, minlength=n)
                    some = np.flatnonzero(count)
                    if len(some):
                        margins[some] = np.add.reduceat(model.weights[slot], np.searchsorted(of, some), axis=0) / count[some, None]
                    best, p, unsure = decode(margins, model)
                    letters = batch.column(1).slice(row, n).to_numpy(zero_copy_only=False)
                    names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters, strict=True)]
                    scores, doubt = np.where(letters, p, 0.0), letters & unsure
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, n) for i in range(2, batch.num_columns)), pa.array(names, pa.string()),
                                                  pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())],
                                                 names=[*batch.schema.names[2:], "lang_pred", "score", "ambiguous"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.select(*rest).schema)
    return frame.mapInArrow(run, f"{kept}lang_pred string, score double, ambiguous boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the rows that are not held out, predict all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
