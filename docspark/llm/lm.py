"""Language-model scores by online logistic mixing of context predictors.

A text is a row of words and an end. A word is told by its class and by which
word of the class it is. Classes are cuts of the training words, in order of
groups by their last two bytes (which tell much of the language) and then of
hashes, into like shares of the training tokens, so a frequent word has one to
itself or nearly so; words seen once or never are a class of their own.
The bits of the classes of running texts are predicted by mixed contexts that
reach across words (`running.py`). Within a class a word seen c times has the
share c of the class's tokens. Within the class of rare words a text is spelt:
a word in bytes with a stop, a byte in the bits of a Huffman code, each bit
predicted by hashed contexts of the bytes before it, whose log-odds a mixer adds
with weights that a gate selects (place in the word, how often the longest
context was seen); it learns online from the error of each bit, and an adaptive
table refines the mixed probability. A word seen once also has its share of all
those, by Good and Turing's estimate.

Spellings depend on the word alone, so each is done once for the corpus, not at
each use. The texts are read once. Slices of them send their distinct words to ranges of hashes and
get counts, classes and scores back; then their rows of classes are counted,
learnt from and scored where they are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm import running
from docspark.llm.common import Splits, fold, stored
from docspark.llm.textgrid import slices

FOLDS, HELD_OUT = 7, 2
#: Distinct words of slices that one range takes, about.
RANGE = 400_000
#: Groups of words by ending, and bits of the ranges of hashes whose masses in
#: each group are told one by one; finer ranges share them out.
GROUPS, COARSE = 256, 6
STOP = 0x20  # no word holds a space
ORDERS = (1, 2, 3, 4, 6, 0)  # bytes before; 0: the whole word so far
BITS = 18
PLACES, SEEN = 8, 4
STEPS, DEPTHS = 24, 16
RATE = 0.02
MINIBATCH = 1 << 15

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

TOKENS = T.StructType(
    [
        T.StructField("slice", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("held_out", T.ArrayType(T.BooleanType())),
        T.StructField("n", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.BinaryType()),
        T.StructField("distinct", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
    ]
)
ENTRIES = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("slice", T.LongType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
    ]
)
VOCABULARY = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("classes", T.BinaryType()),
        T.StructField("scores", T.BinaryType()),
    ]
)
ANSWERS = T.StructType(
    [
        T.StructField("slice", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("classes", T.BinaryType()),
        T.StructField("scores", T.BinaryType()),
        T.StructField("lengths", T.BinaryType()),
    ]
)
CODED = T.StructType(
    [
        T.StructField("slice", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("held_out", T.ArrayType(T.BooleanType())),
        T.StructField("n", T.ArrayType(T.IntegerType())),
        T.StructField("n_known", T.ArrayType(T.LongType())),
        T.StructField("size", T.ArrayType(T.LongType())),
        T.StructField("base", T.ArrayType(T.DoubleType())),
        T.StructField("within", T.ArrayType(T.DoubleType())),
        T.StructField("classes", T.BinaryType()),
    ]
)
NUMBERS = T.StructType(
    [T.StructField("chunk", T.LongType()), T.StructField("values", T.BinaryType()), T.StructField("tasks", T.LongType())]
)
CHUNK = 1 << 16
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("bits_per_byte", T.DoubleType()),
    ]
)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers below 1024, and of multiples of 1024 up to n; their products are all powers."""
    low, high = np.full(1024, base, np.uint64), np.full((n >> 10) + 1, pow(base, 1024, 2**64), np.uint64)
    low[0] = high[0] = 1
    return np.multiply.accumulate(low), np.multiply.accumulate(high)


def _shifted(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of bytes that begin at a place, as if they began at 0."""
    low, high = _powers(_INVERSE, int(at.max(initial=0)))
    return x * low[at & 1023] * high[at >> 10]


def _sums(raw: np.ndarray) -> np.ndarray:
    """Sums of the bytes' numbers, each times the power of its place, up to every place."""
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    _BYTE.take(raw, out=out[1:], mode="clip")
    low, high = _powers(_BASE, len(raw))
    whole = len(raw) >> 10 << 10
    out[1 : whole + 1].reshape(-1, 1024)[:] *= low * high[:-1, None]
    out[whole + 1 :] *= low[: len(raw) - whole] * high[-1]
    return np.cumsum(out, out=out)


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and their 64-bit hashes; white space on either side."""
    space = _SPACE.take(raw)
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = _sums(raw)
    h = _shifted(sums[last] - sums[first], first) + (last - first).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return first, last, h ^ (h >> np.uint64(31))


def _cut(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    """The given words, each followed by a space."""
    n = last - first + 1
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = raw[at]
    out[np.cumsum(n) - 1] = STOP
    return out.tobytes()


def _slices(batches: Iterator[pa.RecordBatch]):
    """Slices of (doc_id, held_out, text): number, batch part, bytes, lengths.

    A number is made of the partition and the place in it.
    """
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = [(x or b"").translate(_LOWER) for x in batch.column(2).cast(pa.binary()).to_pylist()]
        for at, part in slices(texts):
            raw = np.frombuffer(b" " + b"".join(t + b" " for t in part), np.uint8)
            yield number, batch.slice(at, len(part)), raw, np.cumsum([len(t) + 1 for t in part]) + 1
            number += 1


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's words as numbers, the place among its hashes in order; its
    distinct words in that order, with their counts in training texts."""
    for number, batch, raw, ends in _slices(batches):
        first, last, h = spans(raw)
        n = np.diff(np.searchsorted(first, ends), prepend=0)
        key, one, word = np.unique(h, return_index=True, return_inverse=True)
        held_out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(word[np.repeat(~held_out, n)], minlength=len(key)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([held_out], pa.list_(pa.bool_())),
                pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([_pack(word.astype(np.uint32))], pa.binary()),
                pa.array([zstandard.compress(_cut(raw, first[one], last[one]), 1)], pa.binary()),
                pa.array([_pack(counts)], pa.binary()),
            ],
            TOKENS.fieldNames(),
        )


def _entries(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each slice's distinct words by range, with their counts in training texts."""
        for batch in batches:
            for number, distinct, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = b" " + zstandard.decompress(distinct)
                counts = _unpack(counts, np.uint32)
                first, _, key = spans(np.frombuffer(raw, np.uint8))
                part = (key >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part)) + 1
                rows = []
                for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                    if b > a:
                        words = raw[first[a] : first[b] if b < len(key) else len(raw)]
                        rows.append((int(part[a]), number, zstandard.compress(words, 1), _pack(counts[a:b])))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ENTRIES.fieldNames()
                )

    return emit


def _vocabulary(table: pa.Table) -> pa.Table:
    """One range's distinct words, in order of their hashes, and their counts."""
    raw = np.frombuffer(b" " + b"".join(zstandard.decompress(x) for x in table["words"].to_pylist()), np.uint8)
    first, last, h = spans(raw)
    _, one, word = np.unique(h, return_index=True, return_inverse=True)
    counts = np.concatenate([_unpack(c, np.uint32) for c in table["counts"].to_pylist()])
    total = np.bincount(word, weights=counts, minlength=len(one)).astype(np.int64)
    words = zstandard.compress(_cut(raw, first[one], last[one]), 3)
    row = [[table["part"][0].as_py()], [words], [_pack(total)], [_pack(_groups(raw, last[one]))], [None]]
    return pa.table([pa.array(x, f) for x, f in zip(row, [pa.int64(), *[pa.binary()] * 4], strict=True)], VOCABULARY.fieldNames())


def _groups(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Groups of words by their last two bytes; a shorter word has a space before it."""
    h = (raw[last - 1].astype(np.uint32) << np.uint32(8) | raw[last - 2]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.uint16) % GROUPS


def code(frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman code of the bytes: length, bits, and the node of each bit."""
    order = counter()
    heap = [(int(f) + 1, next(order), [b]) for b, f in enumerate(frequency)]
    heapq.heapify(heap)
    length = np.zeros(256, np.int64)
    path: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for node in range(255):
        (f, _, a), (g, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in ((0, a), (1, b)):
            for s in side:
                path[s].append((bit, node))
        heapq.heappush(heap, (f + g, next(order), a + b))
    bit, node = np.zeros((256, 256), np.int8), np.zeros((256, 256), np.int16)
    for s, steps in enumerate(path):
        length[s] = len(steps)
        for i, (x, y) in enumerate(reversed(steps)):
            bit[s, i], node[s, i] = x, y
    deep = length.max()
    return length, bit[:, :deep], node[:, :deep]


class Spelling:
    """The bits of some words: slots of their contexts, gates and outcomes."""

    def __init__(self, words: bytes, coding: tuple[np.ndarray, ...]):
        raw = np.frombuffer(words, np.uint8).astype(np.uint32)
        stop = raw == STOP
        start = np.zeros(len(raw), bool)
        start[:1] = True
        start[1:] = stop[:-1]
        begins = np.flatnonzero(start)
        self.word = np.cumsum(start) - 1
        place = np.arange(len(raw)) - begins[self.word]
        before = np.ones(len(raw), np.uint32)
        contexts = {}
        for back in range(1, max(ORDERS) + 1):
            there = np.concatenate([np.zeros(back, np.uint32), raw[:-back]])[: len(raw)]
            before = before * np.uint32(0x2F0B4C47) + np.where(place >= back, there + 1, 0).astype(np.uint32)
            contexts[back] = before
        sums = _sums(raw)
        prefix = _shifted(sums[:-1] - sums[begins[self.word]], begins[self.word])
        contexts[0] = (prefix >> np.uint64(32)).astype(np.uint32) ^ place.astype(np.uint32)
        length, bit, node = coding
        n = length[raw]
        depth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.depth = np.minimum(depth, DEPTHS - 1)
        cell = np.repeat(raw * np.uint32(bit.shape[1]), n) + depth
        self.bit = bit.take(cell)
        at = node.take(cell).astype(np.uint32) * np.uint32(0x85EBCA77)
        self.place = np.repeat(np.minimum(place, PLACES - 1).astype(np.int32), n)
        slots = []
        for k, order in enumerate(ORDERS):
            h = (contexts[order] ^ np.uint32(k * 0x51ED270B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            h = np.repeat(h, n) + at
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            slots.append((k << BITS) + (h >> np.uint32(32 - BITS)).astype(np.int64))
        self.slots = slots
        self.word = np.repeat(self.word, n)

    def inputs(self, tables: np.ndarray, own: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each context and the gate; `own`: 1 where the tables
        count the bit itself, which is then taken out."""
        return self.told(log_odds(tables, own if np.isscalar(own) else 1))

    def told(self, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `inputs`, by log-odds made before, for each bit or for both alike."""
        x = np.empty((len(ORDERS) + 1, len(self.bit)), np.float32)
        shift = self.bit * np.int64(odds.shape[1]) if len(odds) > 1 else 0
        odds = odds.ravel()
        for k, slot in enumerate(self.slots):
            odds.take(slot + shift, out=x[k], mode="clip")
        x[-1] = 0.3
        return x, self.place * SEEN + (x[len(ORDERS) - 2].view(np.int32) & (SEEN - 1))


def log_odds(tables: np.ndarray, own: int) -> np.ndarray:
    """Log-odds by slot; with `own`, by outcome and slot, that outcome taken out.

    The last two bits of those of the longest order tell how often the slot was
    seen, so that one look gives both.
    """
    zeros, ones = tables
    out = np.empty((1 + own, tables.shape[1]), np.float32)
    at = slice((len(ORDERS) - 2) << BITS, (len(ORDERS) - 1) << BITS)
    for bit in range(1 + own):
        less = np.maximum(zeros - own * (1 - bit), 0), np.maximum(ones - own * bit, 0)
        out[bit] = np.log((less[1] + np.float32(0.3)) / (less[0] + np.float32(0.3)))
        seen = less[0][at] + less[1][at]
        level = np.minimum((seen > 0).astype(np.uint32) + (seen > 2) + (seen > 20), SEEN - 1).astype(np.uint32)
        part = out[bit, at].view(np.uint32)
        part &= np.uint32(2**32 - SEEN)
        part |= level
    return out


_squash = running.squash


def _step(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(((x + 8) * (STEPS / 16)).astype(np.int32), 0), STEPS - 1)


def _chunks(words: bytes, size: int = 150_000) -> Iterator[bytes]:
    """Whole words, about `size` bytes together."""
    at = 0
    while at < len(words):
        end = len(words) if at + size >= len(words) else words.index(b" ", at + size) + 1
        yield words[at:end]
        at = end


def _known(row_words: bytes, counts: np.ndarray) -> bytes:
    raw = np.frombuffer(b" " + row_words, np.uint8)
    first, last, _ = spans(raw)
    return _cut(raw, first[counts > 0], last[counts > 0])


def _numbers(values: np.ndarray, units: int = 1) -> pa.RecordBatch:
    parts = [_pack(values[a : a + CHUNK].astype(float)) for a in range(0, len(values), CHUNK)]
    n = len(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(parts, pa.binary()), pa.array(np.full(n, units))], NUMBERS.fieldNames()
    )


def _added(table: pa.Table) -> pa.Table:
    total = sum(_unpack(x, np.float64) for x in table["values"].to_pylist())
    row = [[table["chunk"][0].as_py()], [_pack(total)], [sum(table["tasks"].to_pylist())]]
    kinds = [pa.int64(), pa.binary(), pa.int64()]
    return pa.table([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], NUMBERS.fieldNames())


def _gathered(numbers: DataFrame, size: int, mean: bool = False) -> np.ndarray:
    """Numbers of all tasks, summed by place, or averaged over units; `size` places."""
    out = np.zeros(size)
    got = numbers.groupBy("chunk").applyInArrow(_added, NUMBERS).toArrow()
    for chunk, values, tasks in zip(*(c.to_pylist() for c in got.columns), strict=True):
        values = _unpack(values, np.float64)
        out[chunk * CHUNK : chunk * CHUNK + len(values)] = values / tasks if mean else values
    return out


class Mixer:
    """What is learnt: counts per slot, weights per gate, refinement counts."""

    def __init__(self, coding, tables, weights=None, refined=None):
        self.coding, self.tables, self.odds = coding, tables, {}
        gates = PLACES * SEEN
        self.weights = np.full((gates, len(ORDERS) + 1), 0.3, np.float32) if weights is None else weights
        self.refined = np.zeros((2, DEPTHS * STEPS)) if refined is None else refined

    def _odds(self, own: int) -> np.ndarray:
        if own not in self.odds:
            self.odds[own] = log_odds(self.tables, own)
        return self.odds[own]

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = np.ascontiguousarray(self.weights.T)
        mixed = weights[0].take(gate) * x[0]
        for own, odds in zip(weights[1:], x[1:], strict=True):
            mixed += own.take(gate) * odds
        return mixed

    def learn(self, words: bytes) -> None:
        """Online: every minibatch of bits is predicted, then learnt from."""
        size = self.refined.shape[1]
        for chunk in _chunks(words):
            s = Spelling(chunk, self.coding)
            odds, gate = s.told(self._odds(1))
            for a in range(0, len(s.bit), MINIBATCH):
                x, g, bit = odds[:, a : a + MINIBATCH], gate[a : a + MINIBATCH], s.bit[a : a + MINIBATCH]
                mixed = self._mixed(x, g)
                error = bit - _squash(mixed)
                n = np.bincount(g, minlength=len(self.weights))
                for k in range(len(x)):
                    slope = np.bincount(g, weights=error * x[k], minlength=len(self.weights))
                    self.weights[:, k] += RATE * slope / np.sqrt(n + 1)
                cell = s.depth[a : a + MINIBATCH] * STEPS + _step(mixed)
                self.refined += np.bincount(cell * 2 + bit, minlength=2 * size).reshape(-1, 2).T

    def score(self, words: bytes) -> np.ndarray:
        """log10 of each word's spelling, its stop included."""
        out = [np.zeros(0)]
        zeros, ones = self.refined
        n = ones + zeros + 4
        share, own = (n + 4) / (2 * n), ones / (2 * n)
        for chunk in _chunks(words):
            s = Spelling(chunk, self.coding)
            mixed = self._mixed(*s.told(self._odds(0)))
            cell = s.depth * STEPS + _step(mixed)
            p = _squash(mixed) * share.take(cell) + own.take(cell)
            out.append(np.bincount(s.word, weights=np.log(np.abs((1 - s.bit) - p))) / math.log(10))
        return np.concatenate(out)


def _learn(spark: SparkSession, vocabulary: DataFrame) -> Mixer:
    """The mixer of all training words; what reaches the driver has a fixed size."""

    def rows(batches):
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _known(zstandard.decompress(words), _unpack(counts, np.int64))

    def histogram(batches):
        total = np.zeros(256, np.int64)
        for words in rows(batches):
            total += np.bincount(np.frombuffer(words, np.uint8), minlength=256)
        yield _numbers(total)

    spelt = vocabulary.select("words", "counts")
    coding = code(_gathered(spelt.mapInArrow(histogram, NUMBERS), 256))
    shared_code = spark.sparkContext.broadcast(coding)
    size = len(ORDERS) << BITS

    def tally(batches):
        total = np.zeros((2, size), np.int64)
        for words in rows(batches):
            for chunk in _chunks(words):
                s = Spelling(chunk, shared_code.value)
                side = s.bit.astype(np.int64) << BITS
                for k, slot in enumerate(s.slots):
                    both = np.bincount((slot - (k << BITS)) + side, minlength=2 << BITS).reshape(2, -1)
                    total[:, k << BITS : (k + 1) << BITS] += both
        yield _numbers(total.ravel())

    tables = _gathered(spelt.mapInArrow(tally, NUMBERS), 2 * size).reshape(2, size).astype(np.float32)
    counted = spark.sparkContext.broadcast(tables)
    n_weights = PLACES * SEEN * (len(ORDERS) + 1)

    def train(batches):
        """Each range of words learns from the same start, so tasks do not matter."""
        total, units = 0, 0
        for words in rows(batches):
            if words:
                mixer = Mixer(shared_code.value, counted.value)
                mixer.learn(words)
                total, units = total + np.concatenate([mixer.weights.ravel(), mixer.refined.ravel()]), units + 1
        if units:
            yield _numbers(total, units)

    learnt = _gathered(spelt.mapInArrow(train, NUMBERS), n_weights + 2 * DEPTHS * STEPS, mean=True)
    weights = learnt[:n_weights].reshape(-1, len(ORDERS) + 1).astype(np.float32)
    return Mixer(coding, tables, weights, learnt[n_weights:].reshape(2, -1))


def _classes(part: int, group: np.ndarray, c: np.ndarray, bits: int, masses: np.ndarray) -> np.ndarray:
    """The classes of one range's words, which come in order of their hashes.

    `masses`: tokens of words seen more than once, by group and coarse range.
    """
    often = np.where(c > 1, c, 0).astype(float)
    order = np.argsort(group, kind="stable")
    own = np.bincount(group, weights=often, minlength=GROUPS)
    within = np.empty(len(c))
    within[order] = np.cumsum(often[order]) - often[order] / 2 - (np.cumsum(own) - own)[group[order]]
    within = np.maximum(within / np.maximum(own[group], 1), 0)
    fine = max(0, bits - COARSE)
    start = (np.cumsum(masses) - masses.ravel()).reshape(masses.shape)[:, part >> fine]
    share = ((part & ((1 << fine) - 1)) + within) / (1 << fine)
    place = start[group] + masses[group, part >> fine] * share
    cut = 2 + np.minimum(place / max(masses.sum(), 1) * (running.CLASSES - 2), running.CLASSES - 3).astype(np.int64)
    return np.where(c > 1, cut, running.RARE)


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x)


def score_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: its tokens and its log10 probability, two ways.

    Learns from the documents whose crc32 fold is not `HELD_OUT`. A NULL text
    counts as empty: its end is its only token. Repeated rows are learnt from
    and scored each for itself, an empty table gives no rows, and columns other
    than doc_id and text are not read. Words are told apart by 64-bit hashes.
    Every slice learns the weights of the mixer online from one start, and the
    mean of all is taken, so they hang on how files are cut, not on tasks.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "text",
    )
    tokens = Splits(spark).stored(rows.mapInArrow(_tokens, TOKENS), "tokens")
    total = tokens.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(3, (total // RANGE // 4).bit_length())
    entries = tokens.select("slice", "distinct", "counts").mapInArrow(_entries(bits), ENTRIES)
    vocabulary = stored(entries.groupBy("part").applyInArrow(_vocabulary, VOCABULARY), "vocabulary")
    speller = _learn(spark, vocabulary)

    def counted_words(batches):
        for batch in batches:
            for part, counts, group in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield part, _unpack(counts, np.int64), _unpack(group, np.uint16)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens, words, words seen once and twice; tokens of words seen more than once by group and range."""
        sums = np.zeros(4 + GROUPS * ranges)
        for part, counts, group in counted_words(batches):
            sums[:4] += counts.sum(), (counts > 0).sum(), (counts == 1).sum(), (counts == 2).sum()
            often = np.bincount(group, weights=np.where(counts > 1, counts, 0), minlength=GROUPS)
            sums[4:].reshape(GROUPS, -1)[:, part >> max(0, bits - COARSE)] += often
        yield _numbers(sums)

    ranges = 1 << min(bits, COARSE)
    counted = vocabulary.select("part", "counts", "classes")
    known = _gathered(counted.mapInArrow(masses, NUMBERS), 4 + GROUPS * ranges)
    (n, v, once, twice), mass = known[:4], known[4:].reshape(GROUPS, ranges)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Training tokens of each class."""
        sums = np.zeros(running.CLASSES)
        for part, counts, group in counted_words(batches):
            sums += np.bincount(_classes(part, group, counts, bits, mass), weights=counts, minlength=running.CLASSES)
        yield _numbers(sums)

    of_class = _gathered(counted.mapInArrow(shares, NUMBERS), running.CLASSES)
    # Among rare words: how many would have been seen once, were one token left out.
    old = min(max(2 * twice / max(once + 2 * twice, 1), 0.05), 0.95) if once else 0.0
    model = spark.sparkContext.broadcast((speller.coding, speller.tables, speller.weights, speller.refined))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word's class and its log10 probability within it."""
        mixer = Mixer(*model.value)
        for batch in batches:
            for part, words, counts, group in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                c = _unpack(counts, np.int64)
                own = _classes(part, _unpack(group, np.uint16), c, bits, mass)
                spelt = math.log10(1 - old) + mixer.score(zstandard.decompress(words))
                seen = _log(np.where(c == 1, old / max(once, 1), 0))
                rare = np.maximum(seen, spelt) + np.log10(1 + 10.0 ** -np.abs(np.where(c == 1, seen, 0) - spelt)) * (c == 1)
                within = np.where(c > 1, _log(c / np.maximum(of_class[own], 1)), rare)
                row = [[part], [words], [counts], [_pack(own.astype(np.uint16))], [_pack(within.astype(np.float32))]]
                kinds = [pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(row, kinds, strict=True)], VOCABULARY.fieldNames()
                )

    scored = stored(vocabulary.mapInArrow(spell, VOCABULARY), "spelt")
    answers = entries.groupBy("part").cogroup(scored.groupBy("part")).applyInArrow(_answers, ANSWERS)
    ends = rows.where("NOT held_out").count()
    train_tokens, words = int(n) + ends, v + (ends > 0)

    def coded(own: pa.Table, found: pa.Table) -> pa.Table:
        """A slice's texts as classes, and what is summed over their words."""
        order = np.argsort(found["part"].to_numpy())
        column = lambda name, kind: np.concatenate(
            [np.zeros(0, kind), *(_unpack(found[name][int(i)].as_py(), kind) for i in order)]
        )
        c, size = column("counts", np.int64), column("lengths", np.uint32).astype(np.int64)
        word = _unpack(own["words"][0].as_py(), np.uint32)
        each = np.array(own["n"][0].as_py(), np.int64)
        cuts = np.concatenate([[0], np.cumsum(each)])
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[word])])[cuts])
        base = lambda c: np.log10((c + 1) / (train_tokens + words + 1))
        row = np.full(len(word) + len(each), running.END, np.uint16)
        row[np.arange(len(word)) + np.repeat(np.arange(len(each)), each)] = column("classes", np.uint16)[word]
        values = [
            own["doc_ids"][0].as_py(),
            own["held_out"][0].as_py(),
            each.astype(np.int32),
            sums((c > 0).astype(np.int64)) + int(ends > 0),
            sums(size) + 1,
            sums(base(c)) + float(base(ends)),
            sums(column("scores", np.float32).astype(float)),
        ]
        kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        lists = [pa.array([x], pa.list_(k)) for x, k in zip(values, kinds, strict=True)]
        return pa.table([own["slice"], *lists, pa.array([_pack(row)], pa.binary())], CODED.fieldNames())

    texts = stored(tokens.drop("distinct", "counts").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(coded, CODED), "coded")
    mixer = spark.sparkContext.broadcast(_learn_running(spark, texts.select("held_out", "n", "classes"), running.heavy_classes(of_class)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = running.Mixer(*mixer.value).scorer()
        for batch in batches:
            for row in batch.to_pylist():
                logs = scorer(_unpack(row["classes"], np.uint16))
                each = np.array(row["n"], np.int64) + 1
                cuts = np.concatenate([[0], np.cumsum(each)])
                score = np.add.reduceat(logs, cuts[:-1]) + np.array(row["within"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["held_out"], pa.bool_()),
                        pa.array(each),
                        pa.array(row["n_known"], pa.int64()),
                        pa.array(np.full(len(each), train_tokens)),
                        pa.array(row["base"], pa.float64()),
                        pa.array(score),
                        pa.array(-score / math.log10(2) / np.array(row["size"])),
                    ],
                    RESULT.fieldNames(),
                )

    return texts.mapInArrow(score, RESULT)


def _learn_running(spark: SparkSession, texts: DataFrame, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts and what the mixer learnt of all training texts; both of a fixed size."""

    def taught(batches):
        for batch in batches:
            for row in batch.to_pylist():
                of = np.repeat(~np.array(row["held_out"], bool), np.array(row["n"], np.int64) + 1)
                classes = _unpack(row["classes"], np.uint16)[of]
                if len(classes):
                    yield classes

    def count(batches):
        total, lot = np.zeros((2, running.COUNTS), np.int64), []
        for classes in taught(batches):
            lot.append(classes)  # every text ends in END, so slices may follow each other
            if sum(map(len, lot)) >= 1 << 20:
                running.tally(np.concatenate(lot), heavy, total)
                lot = []
        if lot:
            running.tally(np.concatenate(lot), heavy, total)
        yield _numbers(total.ravel())

    counts = _gathered(texts.mapInArrow(count, NUMBERS), 2 * running.COUNTS).reshape(2, -1).astype(np.float32)
    shared = spark.sparkContext.broadcast(counts)

    def train(batches):
        total, units, mixer = 0, 0, running.Mixer(shared.value, heavy)
        for classes in taught(batches):
            mixer.start()
            mixer.learn(classes)
            total, units = total + mixer.learnt(), units + 1
        if units:
            yield _numbers(total, units)

    fresh = running.Mixer(counts, heavy).learnt()
    learnt = _gathered(texts.mapInArrow(train, NUMBERS), len(fresh), mean=True)
    return counts, heavy, learnt if learnt.any() else fresh


def _answers(entries: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """For each slice the counts, classes and scores of its words of one range."""
    h = spans(np.frombuffer(b" " + zstandard.decompress(vocabulary["words"][0].as_py()), np.uint8))[2]
    columns = [_unpack(vocabulary[k][0].as_py(), kind) for k, kind in (("counts", np.int64), ("classes", np.uint16), ("scores", np.float32))]
    cut = [zstandard.decompress(words) for words in entries["words"].to_pylist()]
    first, last, own = spans(np.frombuffer(b" " + b"".join(cut), np.uint8))
    at, length = np.searchsorted(h, own), (last - first + 1).astype(np.uint32)
    ends = np.cumsum([words.count(b" ") for words in cut])
    out = []
    for a, b in zip([0, *ends], ends, strict=False):
        out.append((*(_pack(x[at[a:b]]) for x in columns), _pack(length[a:b])))
    return pa.table(
        [entries["slice"], entries["part"], *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))],
        ANSWERS.fieldNames(),
    )
