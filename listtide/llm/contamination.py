"""Benchmark decontamination with suffix arrays of the training texts.

The documents of a chunk form one shard. Its suffix array is sparse: it keeps the suffixes that begin like some benchmark
window, as no other can take part in a match. The kept suffixes are sorted by their first `window` words, every benchmark
suffix is looked up by binary search, and neighbouring matches on one diagonal join to the longest verbatim match with
its place in document and item. Nothing is shuffled: a shard lives inside one task, and the benchmark goes to all tasks in
blocks of bounded size, so a benchmark of any size is matched against all documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import small_batches, table
from .words import ALNUM, chunks, grams, run_hash, words

WINDOW = 10
#: Benchmark text in one broadcast, in bytes; more goes into further blocks.
BLOCK_BYTES = 8 << 20
#: Leading words by which suffixes enter the sparse array (fewer where some window is shorter).
LEAD = 4

_BITS = 20
MATCH = "struct<item:string,doc_start:int,item_start:int,words:int>"
FOUND = f"n_words long, hit_spans array<struct<start:int,stop:int>>, items array<string>, matches array<{MATCH}>"


@dataclass
class Block:
    """Windows of some benchmark items: sorted keys, and for each key its (item, word position) list."""

    window: int
    vocabulary: np.ndarray  # sorted word hashes
    low: np.ndarray  # sorted distinct window keys, padded with 0
    high: np.ndarray  # the same, padded with the largest number
    length: np.ndarray
    first: np.ndarray  # offsets into item and place
    item: np.ndarray
    place: np.ndarray
    names: list[str | None]
    lead: int
    leads: np.ndarray  # table of the low bits of hashes of leading words


def block_of(rows: list[tuple[object, str | None]], window: int = WINDOW) -> Block | None:
    """None if no item has a word."""
    texts = pa.array([r[1] for r in rows], type=pa.large_string())
    keys, lengths, items, places, hashes = [], [], [], [], []
    names = [None if r[0] is None else str(r[0]) for r in rows]
    runs: list[tuple[int, np.ndarray]] = []
    for row, _, data, offsets in chunks(texts, limit=1 << 62):
        w = words(data, offsets, ALNUM)
        for d in range(len(offsets) - 1):
            own = w.hash[w.first[d]:w.first[d + 1]]
            if len(own):
                runs.append((row + d, own))
    if not runs:
        return None
    vocabulary = np.unique(np.concatenate([r for _, r in runs]))
    for item, own in runs:
        ids = np.searchsorted(vocabulary, own).astype(np.int64) + 1
        n = min(window, len(ids))
        for p in range(len(ids) - n + 1):
            keys.append(np.pad(ids[p:p + n], (0, window - n)))
            lengths.append(n)
            items.append(item)
            places.append(p)
            hashes.append(own[p:p + n])
    lead = min(LEAD, min(lengths))
    leads = np.zeros(1 << _BITS, dtype=bool)
    for n in {len(h) for h in hashes}:
        some = np.array([h[:lead] for h in hashes if len(h) == n])
        leads[np.concatenate([run_hash(h, lead) for h in some]) & np.uint64((1 << _BITS) - 1)] = True
    matrix = np.array(keys, dtype=np.int64)
    packed = pack(matrix)
    distinct, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    counts = np.bincount(inverse, minlength=len(distinct))
    top = matrix[first].copy()
    top[top == 0] = 0xFFFFFFFF
    return Block(window, vocabulary, distinct, pack(top), np.array(lengths)[first], np.concatenate([[0], np.cumsum(counts)]),
                 np.array(items)[order], np.array(places)[order], names, lead, leads)


def pack(matrix: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    wide = np.ascontiguousarray(matrix.astype(">u4"))
    return wide.view(f"S{4 * matrix.shape[1]}").ravel()


def shard_matches(data: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, dict[int, tuple]]:
    """Word counts of the shard's documents, and for those with matches: ([start, stop) word spans, item numbers, longest matches)."""
    w = words(data, offsets, ALNUM)
    counts = np.diff(w.first)
    at, lead = grams(w, block.lead)
    at = at[block.leads[lead & np.uint64((1 << _BITS) - 1)]]
    if not len(at):
        return counts, {}
    doc = np.searchsorted(w.first, at, side="right") - 1
    reach = at[:, None] + np.arange(block.window)
    inside = reach < w.first[doc + 1][:, None]
    hashes = w.hash[np.minimum(reach, len(w.hash) - 1)]
    ids = np.searchsorted(block.vocabulary, hashes)
    known = inside & (block.vocabulary[np.minimum(ids, len(block.vocabulary) - 1)] == hashes)
    suffixes = pack(np.where(known, ids + 1, np.where(inside, len(block.vocabulary) + 1, 0)))
    order = np.argsort(suffixes, kind="stable")
    array = suffixes[order]
    low, high = np.searchsorted(array, block.low, side="left"), np.searchsorted(array, block.high, side="right")
    some = np.flatnonzero(high > low)
    if not len(some):
        return counts, {}
    n = (high - low)[some]
    key = np.repeat(some, n)
    place = at[order[np.repeat(low[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]]
    found_doc = np.searchsorted(w.first, place, side="right") - 1
    # Each found window, once per item and place of the item that holds it.
    uses = (block.first[1:] - block.first[:-1])[key]
    use = np.repeat(block.first[key] - np.concatenate([[0], np.cumsum(uses)[:-1]]), uses) + np.arange(uses.sum())
    item, item_at, doc_at = block.item[use], block.place[use], np.repeat(place, uses)
    of, size = np.repeat(found_doc, uses), np.repeat(block.length[key], uses)
    order = np.lexsort((doc_at, doc_at - item_at, item, of))
    of, item, item_at, doc_at, size = of[order], item[order], item_at[order], doc_at[order], size[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (item[1:] != item[:-1]) | ((doc_at - item_at)[1:] != (doc_at - item_at)[:-1]) | (doc_at[1:] != doc_at[:-1] + 1)
    begin = np.flatnonzero(new)
    stop = np.concatenate([begin[1:], [len(of)]]) - 1
    out = {}
    for d in np.unique(found_doc):
        mine = found_doc == d
        order = np.argsort(place[mine], kind="stable")
        starts, stops = place[mine][order] - w.first[d], (place[mine] + block.length[key[mine]])[order] - w.first[d]
        run = (of[begin] == d).nonzero()[0]
        matches = [(int(item[begin[r]]), int(doc_at[begin[r]] - w.first[d]), int(item_at[begin[r]]),
                    int(doc_at[stop[r]] - doc_at[begin[r]] + size[stop[r]])) for r in run]
        out[int(d)] = (join_spans(starts, stops), sorted({m[0] for m in matches}), matches)
    return counts, out


def join_spans(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Sorted spans with touching and overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The items in lists of about `block_bytes` of text each, one list at a time in the driver."""
    items = benchmark.select(F.col("item_id"), F.col("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        some = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in some.collect()]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of `docs`, with n_words, hit_spans, items (sorted strings) and matches (longest verbatim ones).

    A null or empty text has no words and no match; an item of fewer than `window` words matches as a whole, one without
    words never. Equal item ids count once; an item without id hits words but is not listed. Result columns replace columns of
    the same name; repeated rows stay as they are."""
    spark = docs.sparkSession
    added = [c.strip().split(" ")[0] for c in ("n_words", "hit_spans", "items", "matches")]
    docs = docs.drop(*added)
    plain = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast("array<struct<start:int,stop:int>>"),
        "items": F.lit(None).cast("array<string>"), "matches": F.lit(None).cast(f"array<{MATCH}>")})
    out = plain
    small_batches(spark)
    parts = list(blocks(benchmark, block_bytes)) or [[]]
    for rows in parts:
        out = out.mapInArrow(_matcher(spark, block_of(rows, window), plain.columns.index("text")), plain.schema)
    empty = {c: F.coalesce(F.col(c), F.array().cast(plain.schema[c].dataType)) for c in added[1:]}
    return out.withColumns(empty)


def _matcher(spark: SparkSession, block: Block | None, text_at: int):
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            n = batch.num_rows
            names = batch.schema.names
            counts = np.zeros(n, dtype=np.int64)
            spans, items, matches = ([list(x) if x else [] for x in batch.column(names.index(c)).to_pylist()] if batch.column(names.index(c)).null_count < n
                                     else [None] * n for c in ("hit_spans", "items", "matches"))
            for row, _, data, offsets in chunks(batch.column(text_at)):
                if block is None:
                    w = words(data, offsets, ALNUM)
                    counts[row:row + len(offsets) - 1] = np.diff(w.first)
                    continue
                own, found = shard_matches(data, offsets, block)
                counts[row:row + len(own)] = own
                for d, (spot, which, longest) in found.items():
                    r = row + d
                    old = [(x["start"], x["stop"]) for x in spans[r] or []]
                    both = np.array(sorted(old + spot))
                    spans[r] = [{"start": a, "stop": b} for a, b in join_spans(both[:, 0], both[:, 1])]
                    items[r] = sorted({*(items[r] or []), *(block.names[i] for i in which if block.names[i] is not None)})
                    matches[r] = (matches[r] or []) + [{"item": block.names[i], "doc_start": a, "item_start": b, "words": c} for i, a, b, c in longest]
            new = {"n_words": counts, "hit_spans": spans, "items": items, "matches": matches}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], type=f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the documents that hold a benchmark window."""
    found = find(docs.select("*"), benchmark, window)
    return found.where(F.size("hit_spans") == 0).select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, hit words, and a digest of the items whose windows occur."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark")).drop("text")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
m AS (SELECT r, dw.n, p, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hits AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, n, p FROM m)) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
