"""Passages that repeat across documents, by sparse suffix arrays.

A suffix is kept where its first GRAM words are the minimiser of some window of LENGTH words: chosen by content, so equal passages
keep the same places. Every window of LENGTH words belongs to exactly one kept suffix. The suffixes are brought together by their first
words and the text that their windows cover; neighbours that are equal in all of it repeat as a whole. Where texts part before that,
at the edges of a passage, the match is extended left and right word by word: the single windows of such suffixes are compared.
Touching and overlapping matches join to maximal spans. All grouping is by digests with partial aggregation, so a passage in a third of
all documents shrinks to a row per task before it is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import small_batches, table, written
from .words import SPACED, Words, chunks, mix, run_hash, signed, words

LENGTH, GRAM = 50, 8
#: Bits of the tables of shared and of parting suffixes that are sent to the tasks, whatever the size of the input.
ASKED_BITS = 23

_U = np.uint64
_WORD = _U(0xC6A4A7935BD1E995)
_WORD_INV = _U(pow(0xC6A4A7935BD1E995, -1, 1 << 64))


def suffixes(w: Words, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Kept suffixes of a chunk: key (hash of the first words), region (hash of all covered text), at (word), low and high (first and
    last window that belongs to it), and `windows` (hash of each window by its first word)."""
    none = np.zeros(0, dtype=np.int64)
    count = len(w.hash) - length + 1
    if count <= 0:
        return {"key": none.view(np.uint64), "region": none.view(np.uint64), "at": none, "low": none, "high": none, "windows": none.view(np.uint64)}
    grams = run_hash(w.hash, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    bits = _U(max(20, int(len(grams)).bit_length()))
    least = (grams >> bits << bits) | place  # ties go to the left
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    chosen = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)[:count]
    doc = w.doc()
    inside = doc[:count] == doc[length - 1:length - 1 + count]
    new = np.ones(count, dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:count] != doc[:count - 1]) | ~inside[:-1]
    low = np.flatnonzero(new & inside)
    stop = np.append(np.flatnonzero(new | ~inside), count)
    high = stop[np.searchsorted(stop, low, side="right")] - 1
    power = np.full(len(w.hash) + 1, _WORD, dtype=np.uint64)
    power[0] = 1
    inverse = np.full(len(w.hash) + 1, _WORD_INV, dtype=np.uint64)
    inverse[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(len(w.hash) + 1, dtype=np.uint64)
    np.cumsum(w.hash * power[:-1], out=sums[1:])
    part = lambda a, b: mix((sums[b] - sums[a]) * inverse[a])
    at = chosen[low]
    first = np.arange(count)
    region = mix(part(low, high + length) + (high - low).astype(np.uint64) * _U(64) + (at - low).astype(np.uint64))
    return {"key": grams[at], "region": region, "at": at, "low": low, "high": high, "windows": part(first, first + length)}


def _doc_hash(column: pa.Array) -> np.ndarray:
    """Hash of each id as text; null is one id of its own."""
    ids = column.cast(pa.string())
    out = np.zeros(len(ids), dtype=np.uint64)
    for row, stop, data, offsets in chunks(ids):
        docs = words(data, offsets, np.ones(256, dtype=bool), lower=False)
        out[row:stop][docs.doc()] = docs.hash
    return out


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, region, doc) of all kept suffixes; (key, region) once per document and chunk."""
    for batch in batches:
        docs = _doc_hash(batch.column(1))
        for row, _, data, offsets in chunks(batch.column(0)):
            w = words(data, offsets, SPACED)
            s = suffixes(w)
            if len(s["at"]):
                doc = docs[row + np.searchsorted(w.first, s["low"], side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(signed(s["key"])), pa.array(signed(s["region"])), pa.array(signed(doc))], names=["key", "region", "doc"])


def _bits(keys: DataFrame) -> np.ndarray:
    slots = keys.select(F.col("key").bitwiseAND((1 << ASKED_BITS) - 1).alias("slot")).distinct()
    out = np.zeros(1 << ASKED_BITS, dtype=bool)
    for part in slots.toArrow().to_batches():
        out[part.column(0).to_numpy()] = True
    return np.packbits(out)


def _revisit(shared):
    """(doc_id, text_key, doc, key, region, low, high, windows) of the suffixes whose key some other document may hold; the windows only
    where texts may part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, parting = (np.unpackbits(x).astype(bool) for x in shared.value)
        for batch in batches:
            docs = _doc_hash(batch.column(1))
            for row, stop, data, offsets in chunks(batch.column(0)):
                w = words(data, offsets, SPACED)
                s = suffixes(w)
                slot = (s["key"] & _U((1 << ASKED_BITS) - 1)).astype(np.int64)  # the leading bits of minima are mostly 0
                some = np.flatnonzero(asked[slot])
                if not len(some):
                    continue
                full = words(data, offsets, np.ones(256, dtype=bool), lower=False)
                text = np.zeros(stop - row, dtype=np.uint64)
                text[full.doc()] = full.hash
                low, high = s["low"][some], s["high"][some]
                at = np.searchsorted(w.first, low, side="right") - 1
                raw = [s["windows"][a:b + 1].tobytes() if p else None for a, b, p in zip(low.tolist(), high.tolist(), parting[slot[some]].tolist(), strict=True)]
                begin = w.first[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(row + at)), pa.array(signed(text[at])), pa.array(signed(docs[row + at])), pa.array(signed(s["key"][some])),
                     pa.array(signed(s["region"][some])), pa.array(low - begin), pa.array(high - begin), pa.array(raw, pa.binary())],
                    names=["doc_id", "text_key", "doc", "key", "region", "low", "high", "windows"])

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the suffixes (doc_id, text_key, doc, whole, low, windows)."""
    for batch in batches:
        packed = batch.column(5)
        counts = pc.fill_null(pc.binary_length(packed), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        row = np.repeat(np.arange(batch.num_rows), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = np.frombuffer(b"".join(x for x in packed.to_pylist() if x is not None), dtype=np.int64)
        low = batch.column(4).to_numpy()
        taken = [batch.column(i).take(pa.array(row)) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(low[row] + inside), pa.array(flat)], names=["doc_id", "text_key", "doc", "whole", "start", "window"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, stop): the maximal runs of words, each word in a run of LENGTH words that another document holds too.

    Words are lower-cased and set apart by ASCII white space; positions count from 0. Documents differ by their ids (null is one id),
    so a repetition inside one document is none. Null, empty and short texts have no span; equal rows give one result; text_key
    is a digest that tells rows of one id apart."""
    docs = docs.select("text", "doc_id")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    small_batches(spark)
    found = docs.mapInArrow(_collect, "key long, region long, doc long")
    regions = written(found.groupBy("key", "region").agg(F.min("doc").alias("low_doc"), F.max("doc").alias("high_doc")), "repeat_regions")
    keys = regions.groupBy("key").agg(F.min("low_doc").alias("a"), F.max("high_doc").alias("b"), F.count("*").alias("n")).where("a <> b")
    keys = written(keys.select("key", (F.col("n") > 1).alias("parts")), "repeat_keys")
    shared = spark.sparkContext.broadcast((_bits(keys), _bits(keys.where("parts"))))
    again = docs.mapInArrow(_revisit(shared), f"doc_id {kind}, text_key long, doc long, key long, region long, low long, high long, windows binary")
    known = regions.join(keys, "key").select("key", "region", "low_doc", "high_doc", "parts", (F.col("low_doc") != F.col("high_doc")).alias("whole"))
    rows = written(again.join(known, ["key", "region"]), "repeat_suffixes")
    whole = rows.where("whole").select("doc_id", "text_key", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("stop"))
    # Windows of suffixes that part, against each other and against two documents of each region that repeats as a whole.
    parting = rows.where(F.col("parts") & (~F.col("whole") | (F.col("doc") == F.col("low_doc")) | (F.col("doc") == F.col("high_doc"))))
    each = parting.select("doc_id", "text_key", "doc", "whole", "low", "windows").mapInArrow(
        _single, f"doc_id {kind}, text_key long, doc long, whole boolean, start long, window long")
    twice = each.groupBy("window").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("window")
    single = each.where("NOT whole").join(twice, "window").select("doc_id", "text_key", "start", (F.col("start") + LENGTH).alias("stop"))
    spans = whole.unionByName(single)
    order = W.partitionBy("doc_id", "text_key").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "text_key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents that repeat in another document."""
    spans = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select("doc_id", F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s + 1, s + 50), ' ')) AS x
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
twice AS (SELECT x FROM g GROUP BY x HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, s FROM g WHERE x IN (SELECT x FROM twice)),
cut AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
isle AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM cut)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) + 50 - min(s) AS BIGINT) AS n_words FROM isle GROUP BY doc_id, i
"""
