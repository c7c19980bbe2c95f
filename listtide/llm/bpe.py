"""Byte-level BPE: encoding by recursive queries in an in-process DuckDB of each task, decoding by ordered aggregation of all ids.

Every task splits its texts into pieces, and only pieces that its worker has not met lately are encoded: their bytes become
token-position rows, which join the merge table; each round contracts the leftmost pair of least rank of every piece, until no
pair is left. Pieces over `LONG_PIECE` bytes would take one round per byte, so they are contracted in the same order with a heap."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import released, small_batches, table
from .words import chunks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG_PIECE = 256
#: Words and pieces that a task remembers; those not met lately go first.
KEPT = 300_000
PIECES_PER_QUERY = 20_000
#: Bytes of text handled at a time (a longer text by itself), and ids decoded at a time.
SLICE_BYTES, SLICE_IDS = 2_000_000, 400_000

_POS = 1 << 20

_ENCODE = f"""
WITH RECURSIVE step AS (
  SELECT word, list(tok ORDER BY pos) AS ids, false AS done FROM seed GROUP BY word
  UNION ALL
  SELECT s.word, CASE WHEN k IS NULL THEN s.ids ELSE s.ids[:(k % {_POS}) - 1] || [(k // {_POS})::INTEGER] || s.ids[(k % {_POS}) + 2:] END, k IS NULL
  FROM (SELECT * FROM step WHERE NOT done) s LEFT JOIN (
    SELECT word, min(m.rank::BIGINT * {_POS} + a.pos) AS k
    FROM (SELECT word, unnest(range(1, len(ids))) AS pos, unnest(ids[:-2]) AS tok, unnest(ids[2:]) AS right_tok FROM step WHERE NOT done AND len(ids) > 1) a
    JOIN merges m ON m.l = a.tok AND m.r = a.right_tok
    GROUP BY word) b ON s.word = b.word)
SELECT word, ids FROM step WHERE done
"""

#: Byte n is the character n here.
_DECODE = "SELECT doc, string_agg(v.chars, '' ORDER BY t.pos) AS chars FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY doc"


_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SEEN = np.array([32 < b < 127 for b in range(256)])
#: An apostrophe may begin a contraction.
_SIGN = _SEEN & ~np.array([chr(b).isalnum() or b == 39 for b in range(256)])


class Coder:
    """One worker's database, merge table and memory of pieces."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.loose = regex.compile(r"\A (?:\s|\z)|\A\s\s|\s\z").search
        pairs = np.array([(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                          for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self.db.register("given", pa.table({"l": pairs[:, 0], "r": pairs[:, 1], "rank": pairs[:, 2]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "chars": [t.decode("latin-1") for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def known(self, raw: list[bytes]) -> list[bytes | None]:
        """The remembered ids of words or pieces."""
        out = list(map(self.recent.get, raw))
        for k, found in enumerate(out):
            if found is None and (found := self.older.get(raw[k])) is not None:
                out[k] = self.recent[raw[k]] = found
        return out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces; those not remembered are encoded."""
        raw = {p: p.encode() for p in pieces}
        out = dict(zip(raw, self.known(list(raw.values())), strict=True))
        new = [p for p, found in out.items() if found is None]
        short = [p for p in new if len(raw[p]) <= LONG_PIECE]
        for k in range(0, len(short), PIECES_PER_QUERY):
            some = short[k:k + PIECES_PER_QUERY]
            out.update(zip(some, self._query([raw[p] for p in some]), strict=True))
        for p in new:
            if len(raw[p]) > LONG_PIECE:
                out[p] = np.array(self.contract(raw[p]), dtype="<u4").tobytes()
            else:
                self.recent[raw[p]] = out[p]
        return out

    def _query(self, some: list[bytes]) -> list[bytes]:
        length = np.array([len(b) for b in some], dtype=np.int64)
        raw = np.frombuffer(b"".join(some), dtype=np.uint8)
        pos = np.arange(len(raw)) - np.repeat(np.cumsum(length) - length, length)
        self.db.register("seed", pa.table({"word": np.repeat(np.arange(len(some), dtype=np.int32), length), "pos": pos.astype(np.int32), "tok": self.single[raw]}))
        ids = self.db.sql(f"SELECT word, ids FROM ({_ENCODE}) ORDER BY word").to_arrow_table().column("ids")
        whole = pa.concat_arrays(ids.chunks)
        packed = whole.flatten().to_numpy().astype("<u4").tobytes()
        edge = 4 * np.concatenate([[0], np.cumsum(pc.list_value_length(whole).to_numpy())])
        return [packed[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def contract(self, data: bytes) -> list[int]:
        """The same contraction for one long piece: always the leftmost pair of least rank."""
        n = len(data)
        parts: list[bytes | None] = [data[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[p] for p in parts if p is not None]

    def texts(self, texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded bytes of each text.

        A piece never runs over the end of a word, and a space before a word belongs to it. So a text splits before single spaces,
        between an ASCII letter and a sign, and before a line break behind a sign or letter, into parts that are encoded alike
        wherever they stand; texts with more white space together are split whole."""
        ids: list[bytes] = []
        for _, _, data, offsets in chunks(texts, SLICE_BYTES):
            ids += self._chunk(data, offsets)
        return ids, self.decode(ids)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        begins = data == 32
        begins[1:] |= (_SIGN[data[1:]] & _LETTER[data[:-1]]) | ((data[1:] == 10) & _SEEN[data[:-1]])
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.append(np.flatnonzero(begins), len(data))
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        coded = every.dictionary_encode()
        distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.recent) > KEPT // 2:
            self.recent, self.older = {}, self.recent
        known = self.known(distinct)
        new = {k: self.split(t) for k, found in enumerate(known) if found is None and not self.loose(t := distinct[k].decode())}
        learned = self.learn({p for pieces in new.values() for p in pieces})
        for k, pieces in new.items():
            known[k] = b"".join([learned[p] for p in pieces])
            if len(distinct[k]) <= LONG_PIECE:
                self.recent[distinct[k]] = known[k]
        known = [k or b"" for k in known]  # nothing: not to be encoded by itself
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        length = np.array(list(map(len, known)), dtype=np.int64) // 4
        whole = (length == 0)[code]
        n, stop = length[code], np.cumsum(length[code])
        from_ = np.repeat((np.cumsum(length) - length)[code] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)
        packed = flat[from_].tobytes()
        first = np.searchsorted(at[:-1], offsets)  # words of documents
        edge = np.concatenate([[0], stop])[first] * 4
        out = [packed[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        loose = np.concatenate([[0], np.cumsum(whole)])[first]
        some = np.flatnonzero(loose[1:] > loose[:-1])
        if len(some):
            split = {d: self.split(data[offsets[d]:offsets[d + 1]].tobytes().decode()) for d in some.tolist()}
            learned = self.learn({p for pieces in split.values() for p in pieces})
            for d, pieces in split.items():
                out[d] = b"".join([learned[p] for p in pieces])
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each document's ids stand for, by the vocabulary alone; a document may go over several slices."""
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) // 4 for i in ids])
        out: list[list[bytes]] = [[] for _ in ids]
        for k in range(0, len(flat), SLICE_IDS):
            some = flat[k:k + SLICE_IDS]
            self.db.register("given", pa.table({"doc": doc[k:k + SLICE_IDS], "pos": np.arange(len(some), dtype=np.int32), "id": some}))
            self.db.execute("CREATE OR REPLACE TEMP TABLE tokens AS SELECT * FROM given")
            back = self.db.sql(_DECODE).to_arrow_table()
            for d, chars in zip(back.column("doc").to_pylist(), back.column("chars").to_pylist(), strict=True):
                out[d].append(chars.encode("latin-1"))
        return [b"".join(parts) for parts in out]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All rows and columns of `docs`, with `ids` (binary, little-endian unsigned 32-bit) and `decoded` (binary).

    A null or empty text has no ids and decodes to nothing. No special token is ever made. Every machine reads the vocabulary
    at `path`. Columns of the same names are replaced; repeated rows stay."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    out = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(path, pattern)  # a task's own: a worker holds none of it afterwards
        for batch in batches:
            for part in _slices(batch, at):
                ids, back = own.texts(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
                                                 names=[*part.schema.names, "ids", "decoded"])

    return docs.mapInArrow(released(run), out)


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch of about SLICE_BYTES bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        total += n
        if total >= SLICE_BYTES:
            yield batch.slice(start, k + 1 - start)
            start, total = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def digest(docs: DataFrame) -> DataFrame:
    """Token count and digests of what encode_decode() gave."""
    return docs.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def public_vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """Path and split pattern of a public tokenizer's vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(encode_decode(docs, *public_vocabulary()))
