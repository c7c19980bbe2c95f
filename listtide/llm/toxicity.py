"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of lexicon words (plain, and after undoing common letter swaps), their nearness to words
of address, and rates of capitals, punctuation and obfuscation. The lexicon is a short public base list and the words that
labelled training rows mark as toxic. Trees and calibration are fitted on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import held_out, released, share_of, small_batches, table, written
from .words import ALNUM, SPACED, chunks, signed, words

#: Labelled rows that train, chosen by a hash of their id (about so many; all if there are fewer); one in CALIBRATION of them calibrates.
SAMPLE_ROWS, CALIBRATION = 20_000, 4
#: A learned lexicon word stands in at least so many toxic rows and share of them, and so many times more often than in others.
LEAST_ROWS, LEAST_SHARE, LEAST_RATIO, LEARNED_WORDS = 5, 0.01, 8.0, 2000
#: Leading bytes of words that are learned beside whole words, as other languages bend and join theirs.
STEMS = (4, 6, 8)
TREES, DEPTH, STEP = 20, 3, 0.3
THRESHOLD = 0.7
#: Text that is worked on at a time: its features take many times its size.
CHUNK_BYTES = 1 << 18
#: Words between a lexicon word and a word of address that still count as near.
NEAR = 5

BASE_LEXICON = ("idiot moron stupid dumb trash garbage loser clown pathetic worthless disgusting scum fool jerk pig vermin filth "
                "creep imbecile retard bastard bitch asshole fuck fucking shit cunt slut whore kill die hate ugly").split()
ADDRESS = "you your yours yourself u ur youre tu te toi vous votre vos du dich dir dein deine ihr euch usted ustedes ti su".split()

#: Digits and signs that stand for letters.
_SWAP = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"0134578@$!", b"oieastbasi", strict=True):
    _SWAP[_a] = _b
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[65:91] = _PLAIN[97:123] = True

FEATURES = ("stem_hits", "stem_density", "stem_words", "hits", "swapped_hits", "distinct", "density", "near_address", "near_density", "address", "capitals", "capital_words",
            "exclaims", "marks", "obfuscated", "log_words")


def _hashes(some: list[str]) -> np.ndarray:
    rows = pa.array(some, pa.string())
    return np.unique(np.concatenate([words(d, o, ALNUM).hash for _, _, d, o in chunks(rows)])) if some else np.zeros(0, dtype=np.uint64)


def _listed(hashes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(hashes), dtype=bool)
    return listed[np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)] == hashes


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, stems: np.ndarray, address: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document of a chunk."""
    docs = len(offsets) - 1
    w = words(data, offsets, ALNUM)
    of, n = w.doc(), np.diff(w.first)
    hit, you = _listed(w.hash, lexicon), _listed(w.hash, address)
    stem = np.zeros(len(hit), dtype=bool)
    for size in STEMS if len(stems) else ():
        stem |= _listed(w.stems(size), stems)
    per = lambda mask, own=of: np.bincount(own[mask], minlength=docs).astype(float)
    reach = np.zeros(len(hit) + 1)
    at = np.flatnonzero(you)
    np.add.at(reach, np.maximum(at - NEAR, w.first[of[at]]), 1)
    np.add.at(reach, np.minimum(at + NEAR + 1, w.first[of[at] + 1]), -1)
    near = hit & (np.cumsum(reach[:-1]) > 0)
    spaced = words(data, offsets, SPACED)
    inner = spaced.doc()
    begin = spaced.start
    letters = np.concatenate([[0], np.cumsum(_PLAIN[data])])
    odd = np.concatenate([[0], np.cumsum(_SWAP[data] != np.arange(256, dtype=np.uint8)[data])])
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    size = spaced.end - begin
    n_letters, n_odd, n_upper = letters[spaced.end] - letters[begin], odd[spaced.end] - odd[begin], upper[spaced.end] - upper[begin]
    masked = (n_letters > 0) & (n_odd > 0) & (n_letters + n_odd >= size - 2)
    swapped = np.zeros(len(begin), dtype=bool)
    if masked.any():  # swaps undone, in words that mix letters and signs
        turned = words(_SWAP[data], offsets, ALNUM)
        marked = np.concatenate([[0], np.cumsum(_listed(turned.hash, lexicon))])
        inside = marked[np.searchsorted(turned.start, spaced.end)] - marked[np.searchsorted(turned.start, begin)]
        plain = np.concatenate([[0], np.cumsum(hit)])
        swapped = masked & (inside > 0) & (plain[np.searchsorted(w.start, spaced.end)] == plain[np.searchsorted(w.start, begin)])
    byte_doc = np.repeat(np.arange(docs), np.diff(offsets))
    chars, alphas = np.maximum(np.diff(offsets), 1), np.maximum(per(_PLAIN[data], byte_doc), 1)
    hits = per(hit)
    many, spread = np.maximum(n, 1), np.maximum(np.diff(spaced.first), 1)
    return np.stack([per(stem), 100 * per(stem) / many, _distinct(of[stem], w.hash[stem], docs), hits, per(swapped, inner), _distinct(of[hit], w.hash[hit], docs), 100 * hits / many, per(near), 100 * per(near) / many,
                     100 * per(you) / many, per((data >= 65) & (data <= 90), byte_doc) / alphas, per((n_upper > 1) & (n_upper == n_letters), inner) / spread,
                     per(data == 33, byte_doc) / chars, per((data == 33) | (data == 63) | ((data >= 35) & (data <= 38)) | (data == 42), byte_doc) / chars,
                     per(masked, inner) / spread, np.log1p(n)], axis=1)


def _distinct(of: np.ndarray, hashes: np.ndarray, docs: int) -> np.ndarray:
    """Different hashes of each document."""
    if not len(of):
        return np.zeros(docs)
    pairs = np.unique(np.stack([of.astype(np.uint64), hashes]), axis=1)[0]
    return np.bincount(pairs.astype(np.int64), minlength=docs).astype(float)


def with_features(docs: DataFrame, lexicon: np.ndarray, stems: np.ndarray, keep_text: bool = False) -> DataFrame:
    """The columns of `docs`, its text only if asked for, with `features` (an array of doubles); a null text counts as empty."""
    rest = [c for c in docs.columns if c not in ("text", "features")]
    frame = docs.select("text", *rest)
    small_batches(docs.sparkSession)
    first = 0 if keep_text else 1
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, stems, _hashes(ADDRESS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, stems, address = shared.value
        for batch in batches:
            for row, stop, data, offsets in chunks(batch.column(0), CHUNK_BYTES):
                found = features(data, offsets, listed, stems, address)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(stop - row + 1) * len(FEATURES), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, stop - row) for i in range(first, batch.num_columns)), lists],
                                                 names=[*batch.schema.names[first:], "features"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[first:])
    return frame.mapInArrow(released(run), f"{kept}features array<double>")


@dataclass
class Model:
    lexicon: np.ndarray
    stems: np.ndarray
    trees: GBTClassificationModel | None  # None where the labels hold one class only
    calibration: IsotonicRegressionModel | None
    always: float


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic, part) of labelled rows that are not held out; several labels of one row count by their majority."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    n = marked.count()
    some = marked.where(share_of(F.col("doc_id"), min(1.0, sample_rows / max(n, 1))))
    one = some.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(CALIBRATION))
    # About sample_rows rows of two numbers, whatever the size of the tables.
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(one), "doc_id").select("text", "toxic", part.alias("part"))


def learn_lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the base words and of those words, and of those stems, that set toxic rows of `rows` (text, toxic) apart."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for row, stop, data, offsets in chunks(batch.column(0), CHUNK_BYTES):
                w = words(data, offsets, ALNUM)
                for size in (0, *STEMS):
                    pairs = np.unique(np.stack([w.doc().astype(np.uint64), w.stems(size) if size else w.hash]), axis=1)
                    keys, inverse = np.unique(pairs[1], return_inverse=True)
                    bad = np.bincount(inverse, weights=toxic[row:stop][pairs[0].astype(np.int64)], minlength=len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size > 0)), pa.array(signed(keys)), pa.array(bad),
                                                      pa.array(np.bincount(inverse, minlength=len(keys)))], names=["stem", "key", "bad", "n"])

    sizes = rows.agg(F.count("*"), F.sum("toxic")).first()
    bad, good = sizes[1] or 0, sizes[0] - (sizes[1] or 0)
    base = _hashes(BASE_LEXICON)
    if not bad or not good:
        return base, base[:0]
    counts = rows.select("text", "toxic").mapInArrow(released(count), "stem boolean, key long, bad long, n long").groupBy("stem", "key").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    ratio = (F.col("bad") / bad) / ((F.col("n") - F.col("bad") + 0.5) / good)
    marked = counts.where((F.col("bad") >= max(LEAST_ROWS, LEAST_SHARE * bad)) & (ratio >= LEAST_RATIO)).orderBy(ratio.desc(), "key").limit(LEARNED_WORDS)
    found = marked.select("stem", "key").collect()
    whole, stems = (np.array(sorted({r[1] for r in found if r[0] == kind}), dtype=np.int64).view(np.uint64) for kind in (False, True))
    return np.union1d(base, whole), np.sort(stems)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = written(training_rows(docs, labels, sample_rows), "toxicity_sample")
    lexicon, stems = learn_lexicon(rows)
    data = written(with_features(rows, lexicon, stems), "toxicity_features")
    sizes = {r[0]: r[1:] for r in data.groupBy("toxic").agg(F.count_if(F.col("part") > 0), F.count_if(F.col("part") == 0)).collect()}
    if set(sizes) != {0, 1} or not all(min(x) for x in sizes.values()):
        return Model(lexicon, stems, None, None, 1.0 if set(sizes) == {1} else 0.0)
    points = data.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), "part")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=5).fit(points.where("part > 0").coalesce(4))
    raw = trees.transform(points.where("part = 0")).select(vector_to_array("probability")[1].alias("raw"), "label")
    return Model(lexicon, stems, trees, IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw.coalesce(4)), 0.0)


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """The columns of `docs`, its text only if asked for, with score (0 to 1) and predicted (1 from THRESHOLD on).

    Only the text is looked at; a null or empty one gets the score of empty features. Where the labels hold no or one class,
    every score is that class. Columns of these names are replaced."""
    docs = docs.drop("score", "predicted", "features", "raw")
    if model.trees is None:
        out = (docs if keep_text else docs.drop("text")).withColumn("score", F.lit(float(model.always)))
    else:
        points = with_features(docs, model.lexicon, model.stems, keep_text).withColumn("features", array_to_vector("features"))
        raw = model.trees.transform(points).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        out = model.calibration.setPredictionCol("score").transform(raw).drop("raw")
        out = out.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labelled rows that are not held out, score all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
