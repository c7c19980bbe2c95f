"""Language-model scores by online logistic mixing of hashed-context bit predictors.

What is scored are the words of a text in lower case, each with a closing space, and an end. Their bytes are predicted bit by bit
in the contexts of the last one, two, three and four bytes. How often a bit was 0 or 1 in a context is counted over all training
texts: documents are dealt into chunks, a chunk asks for the contexts and words that occur in it, the counts are summed up and joined
by Spark, and each chunk gets its answers back, so that no task ever holds more of the model than its chunk needs and the model grows
with the corpus. The predictions of a bit are combined by weights that the bit's place and the evidence in the longest contexts select
(the gate); they minimise the coding error of all bits of all training texts, by Newton steps over sums that Spark adds up. Inside a document each predictor's share is refined block
by block from the bits just seen. Word by word, the product is mixed with the word's own frequency under a share that is refined as well."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listtide.session import scratch_dir

from .tables import table, written
from .words import LOWER, SPACED, chunks

FOLDS, HELD_OUT = 5, 1
ORDERS = 4
#: Text of one chunk, in bytes (and at most one text more).
CHUNK = 32 << 20
#: Newton steps of the weights (each one pass over all keys), what holds the weights of a rare gate back, and the longest step.
STEPS, RIDGE, LONGEST_STEP = 2, 4.0, 0.5
#: The share of its own frequency in a word's probability, before the document's words are seen; fixed, not learned.
WORD_SHARE = 0.2
#: Bytes of the first block of a document and of the longest: every block is twice as long as the one before.
FIRST_BLOCK, LONGEST_BLOCK = 32, 16_384
#: Bytes of text that are worked on at a time (a longer text by itself).
SLICE = 2 << 20
#: Bytes of text whose words are looked up at a time: each look-up goes through all words of the chunk once.
LOOKUP = 8 << 20
#: Bytes of text whose numbers are worked on together when codes are measured (one text's block by itself, if longer).
_TILE = 1 << 14

_INPUTS = ORDERS + 1  # a constant input besides the predictors
_LEVELS = 4  # evidence: none, one or two, up to 16, more
_GATES = 8 * _LEVELS * _LEVELS
_END = 0xFF  # never a byte of UTF-8
_UNIT = 8.0  # steps of quantised counts: doubling a count adds as many

_FINE = float(1 << 20)
_STEPS = 8.0  # steps of a weighted input that are told apart

_MARK, _WORDS, _KEYS, _DOCS = 0, 1, 2, 3

_CODED = np.where(SPACED, LOWER, 32).astype(np.uint8)


def held_out(doc_id: Column) -> Column:
    """Is the row outside the training set? A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


# ---- texts as streams of bytes ----------------------------------------------------------------------------------

@dataclass
class Stream:
    """Normalised bytes of some texts: ORDERS end marks, then each text's words with closing spaces and ORDERS end marks."""

    data: np.ndarray
    word_at: np.ndarray  # where words begin; a text's end counts as one, and one more entry closes the list
    first_word: np.ndarray  # offsets of texts into word_at


def stream(texts: pa.Array) -> Stream:
    parts, at, counts = [np.full(ORDERS, _END, dtype=np.uint8)], [], []
    base = ORDERS
    for _, _, data, offsets in chunks(texts):
        docs = len(offsets) - 1
        inside = SPACED[data]
        # A word's bytes are kept, and the space behind it: white space that follows a word, or room at the end of a text.
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        kept[first] = inside[first]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        open_end = np.zeros(docs, dtype=np.int64)
        open_end[full] = inside[offsets[1:][full] - 1]
        place = np.flatnonzero(kept)
        n_kept = np.diff(np.searchsorted(place, offsets))
        size = n_kept + open_end + ORDERS
        stop = np.cumsum(size)
        begin = stop - size
        out = np.full(int(stop[-1]), _END, dtype=np.uint8)
        out[np.repeat(begin - (np.cumsum(n_kept) - n_kept), n_kept) + np.arange(len(place))] = _CODED[data[place]]
        out[(begin + n_kept)[open_end > 0]] = 32
        # Words begin where their text begins and behind every space; what stands behind a text's last space is its end.
        starts = np.zeros(len(out), dtype=bool)
        starts[1:] = out[:-1] == 32
        starts[begin] = True
        starts = np.flatnonzero(starts)
        at.append(starts + base)
        counts.append(np.diff(np.searchsorted(starts, np.append(begin, stop[-1]))))
        parts.append(out)
        base += len(out)
    starts = np.concatenate([*at, [base]]) if at else np.array([base])
    return Stream(np.concatenate(parts), starts.astype(np.int64), np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, dtype=np.int64))


def scored_places(s: Stream) -> np.ndarray:
    """Places of the bytes that are predicted: all but the end marks that only separate texts."""
    ends = s.word_at[s.first_word[1:] - 1]
    keep = np.ones(len(s.data), dtype=bool)
    keep[:ORDERS] = False
    for k in range(1, ORDERS):
        keep[ends + k] = False
    return np.flatnonzero(keep)


def context_entries(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (context, byte) keys at `places`, sorted, and for each place the number of its key.

    A key holds the four bytes before and the byte itself: the first five of the eight bytes that begin four before the place."""
    padded = np.concatenate([data, np.zeros(7, dtype=np.uint8)])
    every = np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (7 - ORDERS))
    coded = pa.array(every.view(np.int64)[places - ORDERS]).dictionary_encode()
    keys = coded.dictionary.to_numpy()
    order = np.argsort(keys)
    number = np.empty(len(keys), dtype=np.int32)
    number[order] = np.arange(len(keys), dtype=np.int32)
    return keys[order], number[coded.indices.to_numpy()]


def stream_words(s: Stream) -> tuple[pa.Array, np.ndarray]:
    """The distinct words (bytes with their closing space; the end as end marks) and for each word of the stream its number."""
    base = int(s.word_at[0])
    offsets = pa.py_buffer((s.word_at - base).astype(np.int64))
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s.word_at) - 1, [None, offsets, pa.py_buffer(s.data[base:])])
    coded = every.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


# ---- what chunks ask for ----------------------------------------------------------------------------------------

def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows) of a task's rows, whose first columns are the text and the number of the table's part that the task reads.

    A row's chunk depends on that number and the bytes of the rows before it alone, so two readings of a table agree."""
    before = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(1)[0].as_py() << 32
        size = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
        stop = before + np.cumsum(size)
        number = (stop - size) // CHUNK
        before = int(stop[-1])
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield task + int(number[a]), batch.slice(a, b - a)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for row, stop, _, _ in chunks(batch.column(column), SLICE):
        yield batch.slice(row, stop - row)


def _mark(texts: pa.Array) -> int:
    """By adding up these numbers two readings of a chunk are compared."""
    return sum(int(data.sum(dtype=np.int64)) + 257 * len(data) + 65_537 * (stop - row) for row, stop, data, _ in chunks(texts))


class Wanted:
    """Words and keys of one chunk with their counts in training texts."""

    def __init__(self):
        self.mark = 0
        self.words: list[tuple[pa.Array, np.ndarray]] = []
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, texts: pa.Array, train: np.ndarray) -> None:
        s = stream(texts)
        self.mark += _mark(texts)
        trained = np.repeat(train, np.diff(s.first_word))
        dictionary, number = stream_words(s)
        self.words.append((dictionary, np.bincount(number[trained], minlength=len(dictionary))))
        places = scored_places(s)
        keys, entry = context_entries(s.data, places)
        begins = np.zeros(len(s.data) + 1, dtype=bool)
        begins[s.word_at] = True
        counted = trained[np.cumsum(begins[:-1])[places] - 1]
        n = np.bincount(entry[counted], minlength=len(keys))
        both, of = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(of, weights=np.concatenate([self.counts, n]), minlength=len(both)).astype(np.int64)
        self.keys = both

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """What the chunk asks for, by kind."""
        words = pa.concat_arrays([blob for blob, _ in self.words]).dictionary_encode()
        blob = words.dictionary
        counts = np.bincount(words.indices.to_numpy(), weights=np.concatenate([n for _, n in self.words]), minlength=len(blob)).astype(np.int64)
        for kind, n, columns in (
                (_MARK, 1, (pa.nulls(1, pa.int64()), pa.array([self.mark]), pa.nulls(1, pa.binary()))),
                (_WORDS, len(blob), (pa.nulls(len(blob), pa.int64()), pa.array(counts), blob.cast(pa.binary()))),
                (_KEYS, len(self.keys), (pa.array(self.keys), pa.array(self.counts), pa.nulls(len(self.keys), pa.binary())))):
            fixed = (pa.array(np.full(n, kind, dtype=np.int32)), pa.array(np.full(n, chunk, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([*fixed, *columns], names=["kind", "chunk", "key", "n", "blob"])


def _asked(given: DataFrame, path: str) -> None:
    """Write what the chunks of `given` (text, held_out) ask for, by kind. A chunk lies inside one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, Wanted()
        for chunk, rows in _in_chunks(batches):
            if now is not None and chunk != now:
                yield from own.rows(now)
                own = Wanted()
            now = chunk
            for part in _slices(rows, 0):
                own.add(part.column(0), ~part.column(2).to_numpy(zero_copy_only=False))
        if now is not None:
            yield from own.rows(now)

    given.select("text", F.spark_partition_id().alias("task"), "held_out").mapInArrow(run, "kind int, chunk long, key long, n long, blob binary").write.partitionBy("kind").parquet(path)


# ---- the model --------------------------------------------------------------------------------------------------

def _quantised(n: np.ndarray) -> np.ndarray:
    """Counts in 256 steps of a logarithm; counts up to ten are exact."""
    return np.minimum(np.rint(_UNIT * np.log2(1.0 + n)), 255).astype(np.uint8)


_COUNT = np.rint(2.0 ** (np.arange(256) / _UNIT) - 1.0)


def bit_counts(keys: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """(key, bit, 0 or 1): quantised counts of the bit in the key's context of `order` bytes, after the bits before it.

    All training counts of a context must be among the rows: keys sharing its last bytes belong together."""
    short = keys & ((1 << (8 * (order + 1))) - 1)
    distinct, of = np.unique(short, return_inverse=True)
    total = np.concatenate([[0], np.cumsum(np.bincount(of, weights=n, minlength=len(distinct)))])
    out = np.empty((len(distinct), 8, 2), dtype=np.uint8)
    for bit in range(8):
        left = 7 - bit  # bits behind this one
        low = (distinct >> (left + 1)) << (left + 1)
        edges = [total[np.searchsorted(distinct, low + (k << left))] for k in range(3)]
        out[:, bit, 0], out[:, bit, 1] = _quantised(edges[1] - edges[0]), _quantised(edges[2] - edges[1])
    return out[of]


def _statistics(counts: DataFrame) -> DataFrame:
    """(key, n, stats) from (key, n): quantised bit counts of all orders. Contexts that share their last two bytes are worked on together.

    The shortest contexts are counted over all keys first: at most 65,536 rows, which go to all tasks."""
    low = {int(r[0]): int(r[1]) for r in counts.groupBy((F.col("key").bitwiseAND(0xFFFF)).alias("low")).agg(F.sum("n")).collect()}
    low_keys = np.array(sorted(low), dtype=np.int64)
    low_stats = bit_counts(low_keys, np.array([low[k] for k in low_keys.tolist()], dtype=np.float64), 1)
    shared = counts.sparkSession.sparkContext.broadcast((low_keys, low_stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_keys, first_stats = shared.value

        def finished(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            stats = np.empty((len(keys), ORDERS, 8, 2), dtype=np.uint8)
            stats[:, 0] = first_stats[np.searchsorted(first_keys, keys & 0xFFFF)]
            for order in range(2, ORDERS + 1):
                stats[:, order - 1] = bit_counts(keys, n, order)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ORDERS * 16), len(keys), [None, pa.py_buffer(stats.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64)), packed.cast(pa.binary())], names=["key", "n", "stats"])

        keys, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            n = np.concatenate([n, batch.column(1).to_numpy().astype(np.float64)])
            # Rows come ordered by their last two context bytes: those in front of the last such group are complete.
            tail = (keys >> 8) & 0xFFFF
            stop = int(np.searchsorted(tail, tail[-1], side="left")) if len(tail) else 0
            if stop:
                yield finished(keys[:stop], n[:stop])
                keys, n = keys[stop:], n[stop:]
        if len(keys):
            yield finished(keys, n)

    tail = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    return counts.select("key", "n", tail.alias("tail")).repartition("tail").sortWithinPartitions("tail").select("key", "n").mapInArrow(
        run, "key long, n long, stats binary")


@dataclass
class Weights:
    """What was learned from the training texts, and how many tokens the training texts have."""

    mixer: np.ndarray  # (gate, input)
    tokens: int


def evidence(stats: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the mixer (entry, bit, input) and gates (entry, bit) of quantised counts (entry, order, bit, 2).

    `seen` (entry, bit: the bit itself) takes each entry's own occurrence out of the counts, for learning from counted texts."""
    count = _COUNT[stats]
    if seen is not None:
        for value in (0, 1):
            count[..., value] = np.maximum(count[..., value] - (seen == value)[:, None, :], 0)
    total = count.sum(axis=3)
    inputs = np.empty((len(stats), 8, _INPUTS), dtype=np.float32)
    odds = np.log((count[..., 1] + 0.1) / (count[..., 0] + 0.1))
    inputs[:, :, :ORDERS] = odds.transpose(0, 2, 1)
    inputs[:, :, ORDERS] = 0.3
    level = np.searchsorted([0.5, 2.5, 16.5], total[:, ORDERS - 2:])
    gates = (np.arange(8) * _LEVELS + level[:, 0]) * _LEVELS + level[:, 1]
    return inputs, gates


def bits_of(keys: np.ndarray) -> np.ndarray:
    return ((keys[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float32)


def start_mixer() -> np.ndarray:
    """Weights of all gates before anything is learned: longer contexts weigh more."""
    mixer = np.zeros((_GATES, _INPUTS))
    mixer[:, :ORDERS] = [0.1, 0.15, 0.25, 0.5]
    return mixer


#: What a step needs of each gate: the slope of the coding error by each weight, then its curvature by each pair of weights.
_PAIRS = [(i, j) for i in range(_INPUTS) for j in range(i, _INPUTS)]
_SUMS = _INPUTS + len(_PAIRS)


def error_sums(inputs: np.ndarray, gates: np.ndarray, bits: np.ndarray, n: np.ndarray, mixer: np.ndarray) -> np.ndarray:
    """(gate, sum): slopes and curvatures of the coding error of some keys' bits, a key counted `n` times."""
    x, g = inputs.reshape(-1, _INPUTS), gates.ravel()
    p = _sigmoid(np.einsum("ij,ij->i", x, mixer.astype(np.float32)[g]))
    times = np.repeat(n, 8)
    slope, curve = (times * (p - bits.ravel())).astype(np.float64), (times * p * (1 - p)).astype(np.float64)
    columns = [x[:, i].astype(np.float64) for i in range(_INPUTS)]
    bent = [curve * c for c in columns]
    return np.stack([np.bincount(g, weights=w, minlength=_GATES) for w in (
        *[slope * c for c in columns], *[bent[i] * columns[j] for i, j in _PAIRS])], axis=1)


def next_mixer(mixer: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The weights after one Newton step, rounded so that the order in which sums were added up leaves no trace."""
    curve = np.zeros((_GATES, _INPUTS, _INPUTS))
    for k, (i, j) in enumerate(_PAIRS):
        curve[:, i, j] = curve[:, j, i] = sums[:, _INPUTS + k]
    step = np.linalg.solve(curve + RIDGE * np.eye(_INPUTS), sums[:, :_INPUTS, None])[:, :, 0]
    return np.round(mixer - np.clip(step, -LONGEST_STEP, LONGEST_STEP), 5)


def flat(values: pa.Array, width: int) -> np.ndarray:
    """The bytes of binary values of one width, none of them null, without a copy of each."""
    first = np.frombuffer(values.buffers()[1], dtype=np.int32, count=1, offset=4 * values.offset)[0] if len(values) else 0
    return np.frombuffer(values.buffers()[2], dtype=np.uint8, count=len(values) * width, offset=int(first)) if len(values) else np.zeros(0, dtype=np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def quantised_parts(stats: np.ndarray, keys: np.ndarray, mixer: np.ndarray) -> np.ndarray:
    """(key, input, bit): weighted inputs in steps, their sign turned so that more speaks for the key's own bit."""
    inputs, gates = evidence(stats)
    own = inputs * mixer[gates] * (2 * bits_of(keys) - 1)[:, :, None]
    return np.clip(np.rint(_STEPS * own), -127, 127).astype(np.int8).transpose(0, 2, 1)


def code_lengths(entry: np.ndarray, text_at: np.ndarray, parts: np.ndarray, rate: float = 0.1) -> np.ndarray:
    """Natural log probability of each byte; `parts` (input, bit, key) are those of quantised_parts(), best with a key's numbers side by side.

    A text starts with all inputs' shares at 1 and refines them after each of its blocks; all texts' blocks are worked on together, so
    many at a time that their numbers stay in the processor's cache."""
    out = np.empty(len(entry), dtype=np.float32)
    packed = np.ascontiguousarray(parts.transpose(2, 0, 1)).view(np.int64)[:, :, 0]  # (key, input): eight bits in one number
    length = np.diff(text_at)
    order = np.argsort(-length, kind="stable")
    share = np.ones((_INPUTS, len(length)), dtype=np.float32)
    seen = np.full((_INPUTS, len(length)), 1.0, dtype=np.float32)  # squared gradients so far: the steps become smaller
    done, block = 0, FIRST_BLOCK
    while len(order) and length[order[0]] > done:
        order = order[:int(np.searchsorted(-length[order], -done, side="left"))]
        n = np.minimum(length[order] - done, block)
        stop = np.cumsum(n)
        a = 0
        while a < len(order):
            b = max(int(np.searchsorted(stop, (stop[a - 1] if a else 0) + _TILE, side="right")), a + 1)
            some, m = order[a:b], n[a:b]
            first = np.cumsum(m) - m
            place = np.repeat(text_at[some] + done - first, m)
            place += np.arange(len(place))
            out[place], slope = _block_lengths(packed.take(entry[place], axis=0), share[:, some] / np.float32(_STEPS), m, first)
            gradient = slope / np.float32(_STEPS)
            seen[:, some] += gradient * gradient
            share[:, some] = np.clip(share[:, some] + rate * gradient / np.sqrt(seen[:, some]), 0.3, 2.0)
            a = b
        done += block
        block = min(2 * block, LONGEST_BLOCK)
    return out


def _block_lengths(rows: np.ndarray, scale: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each byte of some blocks of `n` bytes that begin at `first`, and (input, block) slopes by the inputs' shares.

    `rows` (byte, input) are packed inputs; the eight bits of a byte stay side by side."""
    x = np.ascontiguousarray(rows.T).view(np.int8).astype(np.float32)
    margin = np.repeat(scale[0], 8 * n)
    margin *= x[0]
    for k in range(1, _INPUTS):
        term = np.repeat(scale[k], 8 * n)
        term *= x[k]
        margin += term
    np.clip(margin, -25, 25, out=margin)
    odds = np.exp(np.negative(margin, out=margin), out=margin)
    one = 1 + odds
    bits = one.reshape(-1, 8)
    chance = np.empty((3, len(rows)), dtype=np.float32)  # one logarithm for up to three bits: their product stays below e ** 76
    for k in range(3):
        np.multiply(bits[:, 3 * k], bits[:, 3 * k + 1], out=chance[k])
        if k < 2:
            chance[k] *= bits[:, 3 * k + 2]
    np.log(chance, out=chance)
    odds /= one
    slope = np.stack([np.add.reduceat(np.multiply(odds, x[k], out=one), 8 * first) for k in range(_INPUTS)])
    return -(chance[0] + chance[1] + chance[2]), slope


def word_lengths(by_bytes: np.ndarray, by_word: np.ndarray, first_word: np.ndarray, share: float, trust: float = 50.0) -> np.ndarray:
    """Natural log probability of each text: the words' log probabilities by bytes and by their own frequency (-inf: unknown), mixed
    under a share that starts at `share` and follows, inside a text, how often the words so far spoke for the frequency."""
    with np.errstate(divide="ignore"):
        spoke = np.exp(by_word + np.log(share) - np.logaddexp(by_word + np.log(share), by_bytes + np.log1p(-share)))
    spoke = np.rint(spoke * _FINE) / _FINE  # sums of these are exact, so a text scores alike wherever it stands
    before = np.cumsum(spoke) - spoke
    words = np.diff(first_word)
    begin = np.repeat(first_word[:-1], words)
    so_far = before - before[begin]
    place = np.arange(len(spoke)) - begin
    now = np.clip((trust * share + so_far) / (trust + place), 1e-4, 1 - 1e-4)
    mixed = np.logaddexp(by_word + np.log(now), by_bytes + np.log1p(-now))
    return np.add.reduceat(mixed, first_word[:-1])


def _fit(statistics: DataFrame, tokens: int) -> Weights:
    """Learn the mixer from all training texts: every key stands for all its occurrences in them, and each occurrence is taken
    out of the counts before it is predicted, as the counts hold these texts too."""
    if not tokens:
        return Weights(np.full((_GATES, _INPUTS), 1 / ORDERS), tokens)
    mixer = start_mixer()
    trained = statistics.where("n > 0").select("key", "n", "stats")
    for _ in range(STEPS):
        mixer = next_mixer(mixer, _error_sums(trained, mixer))
    return Weights(mixer, tokens)


def _error_sums(trained: DataFrame, mixer: np.ndarray) -> np.ndarray:
    """The sums of all keys; a task hands on one row for each gate and sum, and as many rows reach the driver."""
    shared = trained.sparkSession.sparkContext.broadcast(mixer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_GATES, _SUMS))
        for batch in batches:
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.float32)
            bits = bits_of(keys)
            inputs, gates = evidence(flat(batch.column(2), ORDERS * 16).reshape(-1, ORDERS, 8, 2), bits)
            total += error_sums(inputs, gates, bits, n, shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "total"])

    out = np.zeros(_GATES * _SUMS)
    for slot, total in trained.mapInArrow(run, "slot long, total double").groupBy("slot").agg(F.sum("total")).collect():
        out[slot] = total
    return out.reshape(_GATES, _SUMS)


def _text_places(s: Stream) -> np.ndarray:
    """Offsets of texts into the scored places."""
    ends = s.word_at[s.first_word[1:] - 1] + 1
    return np.concatenate([[0], ends - ORDERS - (ORDERS - 1) * np.arange(len(ends))])


def _word_places(s: Stream) -> np.ndarray:
    """Where words begin among the scored places."""
    text = np.repeat(np.arange(len(s.first_word) - 1), np.diff(s.first_word))
    return s.word_at[:-1] - ORDERS - (ORDERS - 1) * text


SCORES = (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("n_bytes", "long"),
          ("bits_per_byte", "double"))


def score(docs: DataFrame, stable: bool = False) -> DataFrame:
    """All rows and columns of `docs` but the text, with held_out and SCORES; learned from the rows that are not held out.

    `score` is the base-10 logarithm of the model's probability of the words and the end of a text, `bits_per_byte` the same in bits
    for each of its `n_bytes` coded bytes. A null or empty text is just its end. Repeated rows stay, equal texts score alike whatever
    stands around them. Columns of the same names are replaced. Without training rows every bit costs one bit, and base_score is 0.

    `docs` is read several times. `stable` says that every reading deals the same rows to the same tasks in the same order, as a
    table that is read from files does; other rows are written first. A chunk that changes between readings is an error."""
    spark = docs.sparkSession
    given = docs.drop("held_out", *[c for c, _ in SCORES]).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("held_out", held_out(F.col("doc_id")))
    if not stable:
        given = written(given, "mixing_texts")
    path = scratch_dir(spark, "mixing_asked")
    _asked(given, path)
    asked = {k: spark.read.schema("chunk long, key long, n long, blob binary").parquet(f"{path}/kind={k}") for k in (_MARK, _WORDS, _KEYS)} if _any(
        spark, path) else None
    rest = T.StructType([f for f in given.schema.fields if f.name != "text"])
    if asked is None:
        return spark.createDataFrame([], T.StructType([*rest.fields, *_score_fields()]))

    words = asked[_WORDS]
    tokens = int(words.agg(F.sum("n")).first()[0])
    statistics = written(_statistics(written(asked[_KEYS].groupBy("key").agg(F.sum("n").alias("n")), "mixing_counts")), "mixing_statistics")
    weights = _fit(statistics, tokens)
    parts = written(_weighted(statistics, weights), "mixing_parts")

    # A word's total and whether this is its first chunk, in one number.
    same = Window.partitionBy("blob").orderBy("chunk")
    total = F.sum("n").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = (F.row_number().over(same) == 1).cast("long")
    nothing = F.lit(None).cast(rest).alias("rest")

    def rows(df: DataFrame, kind: int, n: Column, blob: Column) -> DataFrame:
        return df.select("chunk", F.lit(kind).alias("kind"), n.cast("long").alias("n"), blob.cast("binary").alias("blob"), nothing)

    # A key has one row of parts and is asked for by many chunks: the parts are hashed, so that the many rows need no sorting.
    answers = rows(asked[_MARK], _MARK, F.col("n"), F.lit(None)).unionByName(rows(words, _WORDS, 2 * total + first, F.col("blob"))).unionByName(
        rows(asked[_KEYS].join(parts.hint("shuffle_hash"), "key"), _KEYS, F.col("key"), F.col("parts"))).unionByName(_documents(given, rest))
    out = T.StructType([T.StructField("rest", rest), T.StructField("new_words", T.LongType()), *_score_fields()])
    # As many partitions as chunks, so that a task's share does not grow with the table.
    dealt = answers.repartition(max(asked[_MARK].count(), 1), "chunk")
    found = written(dealt.sortWithinPartitions("chunk", "kind").mapInArrow(_scorer(spark, weights), out), "mixing_scores")
    distinct = found.agg(F.sum("new_words")).first()[0] or 0
    base = F.col("base_score") - F.col("n_tokens") * math.log10(tokens + 0.5 * (distinct + 1))
    return found.where("new_words IS NULL").withColumn("base_score", base).select("rest.*", *[c for c, _ in SCORES])


def _any(spark: SparkSession, path: str) -> bool:
    """Did any chunk ask for anything? A table without rows has no partitions."""
    return bool(spark.read.schema("kind int, chunk long").parquet(path).limit(1).count())


def _score_fields() -> list[T.StructField]:
    return [T.StructField(c, T.LongType() if k == "long" else T.DoubleType()) for c, k in SCORES]


def _documents(given: DataFrame, rest: T.StructType) -> DataFrame:
    """The documents with their chunks, in the columns of the answers."""
    wanted = given.select("text", F.spark_partition_id().alias("task"), F.struct(*[F.col(f"`{f.name}`") for f in rest.fields]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in _in_chunks(batches):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, chunk, dtype=np.int64)), pa.array(np.full(n, _DOCS, dtype=np.int32)), pa.nulls(n, pa.int64()),
                 part.column(0).cast(pa.binary()), part.column(2)], names=["chunk", "kind", "n", "blob", "rest"])

    return wanted.mapInArrow(run, T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("blob", T.BinaryType()), T.StructField("rest", rest)]))


def _weighted(statistics: DataFrame, weights: Weights) -> DataFrame:
    """(key, parts) of all keys."""
    shared = statistics.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            stats = flat(batch.column(1), ORDERS * 16).reshape(-1, ORDERS, 8, 2)
            parts = quantised_parts(stats, keys, shared.value.mixer)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_INPUTS * 8), len(keys), [None, pa.py_buffer(parts.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed.cast(pa.binary())], names=["key", "parts"])

    return statistics.select("key", "stats").mapInArrow(run, "key long, parts binary")


def _scorer(spark: SparkSession, weights: Weights):
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        now, model, kinds = None, Answers(), None
        for batch in batches:
            kinds = batch.schema.field("rest").type
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(chunk)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b == a:
                    continue
                if chunk[a] != now:
                    if now is not None:
                        yield model.closing(now, kinds)
                    now, model = chunk[a], Answers()
                n, blob, rest = (batch.column(c).slice(a, b - a) for c in (2, 3, 4))
                if kind[a] == _MARK:
                    model.mark += n[0].as_py()
                elif kind[a] == _WORDS:
                    model.add_words(blob, n.to_numpy())
                elif kind[a] == _KEYS:
                    model.add_keys(n.to_numpy(), blob)
                else:
                    for row, stop, _, _ in chunks(blob, LOOKUP):
                        yield from model.score(blob.slice(row, stop - row), rest.slice(row, stop - row), own)
        if now is not None:
            yield model.closing(now, kinds)

    return run


class Answers:
    """What a chunk got back: counts of its words, weighted inputs of its keys."""

    def __init__(self):
        self.mark = self.new_words = 0
        self.words: list = []
        self.counts: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []
        self.ready = False

    def add_words(self, blob: pa.Array, n: np.ndarray) -> None:
        self.words.append(blob)
        self.counts.append(n >> 1)
        self.new_words += int(((n & 1 == 1) & (n > 1)).sum())

    def add_keys(self, keys: np.ndarray, parts: pa.Array) -> None:
        self.keys.append(keys.copy())
        self.parts.append(flat(parts, _INPUTS * 8).view(np.int8).reshape(-1, _INPUTS, 8).copy())

    def prepare(self) -> None:
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        self.sorted_keys = keys[order]
        self.sorted_parts = np.concatenate(self.parts)[order].transpose(1, 2, 0)
        self.word_set, self.word_count = pa.concat_arrays(self.words), np.concatenate(self.counts)
        self.keys, self.parts, self.words, self.counts = [], [], [], []
        self.ready = True

    def score(self, texts: pa.Array, rest: pa.Array, weights: Weights) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.prepare()
        self.mark -= _mark(texts)
        slices = [(row, stream(texts.slice(row, stop - row))) for row, stop, _, _ in chunks(texts, SLICE)]
        words = [stream_words(s) for _, s in slices]
        place = pc.index_in(pa.concat_arrays([d for d, _ in words]).cast(pa.binary()), value_set=self.word_set).to_numpy(zero_copy_only=False)
        counts = np.split(self.word_count[place.astype(np.int64)].astype(np.float64), np.cumsum([len(d) for d, _ in words])[:-1])
        for (row, s), (_, number), count in zip(slices, words, counts, strict=True):
            yield self.score_slice(s, rest.slice(row, len(s.first_word) - 1), number, count, weights)

    def score_slice(self, s: Stream, rest: pa.Array, number: np.ndarray, count: np.ndarray, weights: Weights) -> pa.RecordBatch:
        """`number`: the word's number at each place for a word, `count`: how often each of these words is in the training texts."""
        keys, entry = context_entries(s.data, scored_places(s))
        entry = np.searchsorted(self.sorted_keys, keys)[entry]
        at = _text_places(s)
        by_bytes = np.add.reduceat(code_lengths(entry, at, self.sorted_parts).astype(np.float64), _word_places(s))
        with np.errstate(divide="ignore"):
            own = np.log(count / max(weights.tokens, 1))
        first = s.first_word
        tokens, n_bytes = np.diff(first), np.diff(at)
        score = word_lengths(by_bytes, own[number], first, WORD_SHARE)
        columns = [tokens, np.add.reduceat((count > 0)[number].astype(np.int64), first[:-1]), np.full(len(tokens), weights.tokens, dtype=np.int64),
                   np.add.reduceat(np.log10(count + 0.5)[number], first[:-1]), score / np.log(10), n_bytes, -score / np.log(2) / n_bytes]
        return pa.RecordBatch.from_arrays(
            [rest, pa.nulls(len(tokens), pa.int64()), *(pa.array(c, pa.int64() if k == "long" else pa.float64()) for c, (_, k) in zip(columns, SCORES, strict=True))],
            names=["rest", "new_words", *[c for c, _ in SCORES]])

    def closing(self, chunk: int, kinds: pa.DataType) -> pa.RecordBatch:
        """A row with the number of words that no earlier chunk has."""
        if self.mark:
            raise RuntimeError(f"chunk {chunk} has other texts than when it asked for its words: write the table first")
        return pa.RecordBatch.from_arrays(
            [pa.nulls(1, kinds), pa.array([self.new_words]), *(pa.nulls(1, pa.int64() if k == "long" else pa.float64()) for _, k in SCORES)],
            names=["rest", "new_words", *[c for c, _ in SCORES]])


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by the base and by the mixing model."""
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), stable=True)
    return scored.select("doc_id", "held_out", *[c for c, _ in SCORES])
