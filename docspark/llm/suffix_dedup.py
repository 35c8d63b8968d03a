"""Removal of repeated 100-byte strings by a depth-limited radix sort of suffixes.

A suffix is ordered through its first 100 bytes only, so equal groups are the
repeated windows, and it is ordered digit by digit, from the most significant
one; what is alone in its group drops out at once. Three things keep the
passes small enough to be shuffled:

1. The first digit is one that content chooses: of the 32-byte strings in a
   window the one with the smallest hash, its anchor. Neighbouring windows
   share their anchor, so they are dealt as one span (some forty windows).
   Equal windows have equal anchors at equal places.
2. The second digit is the whole span. All windows of a span that occurred
   before are repeated, so only the first of equal spans goes on, and only if
   its anchor has other spans too.
3. The windows of these few spans are then sorted by 8-byte digits of their
   text, from the first byte on, inside the task that holds their anchor.

Anchors with very many different spans are cut into lots of LOT spans, sorted
one by one; the first window of each equal group meets those of the other lots
by a 128-bit digest of its 100 bytes. Nothing is dropped or sampled on the way.

Defined results: matches never cross rows; NULL text is empty; NULL doc_id
comes before all others; rows with one doc_id but different texts are
documents of their own, ordered by a hash of the text; rows that repeat both
are copies, the later ones removed whole if they have 100 bytes; texts below
100 bytes stay; other columns are ignored; an empty table gives no rows.
Anchors and spans are told apart by 64-bit hashes each, of independent tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import stored

WIDTH = 100
GRAM = 32
GRAMS = WIDTH - GRAM + 1  # in a window
ARENA_BITS = 20
ARENA = 1 << ARENA_BITS  # bytes hashed at a time
LOT = 512
DIGIT = 8
PENDING_BYTES = 16_000_000  # of spans sorted at a time

KEY = ["doc", "tie"]
ORDER = [*KEY, "place"]
#: Spans: place is start << 16 | (anchor - start) << 8 | windows. Removed bytes: place is start << 16, span the length.
SPAN = "anchor long, span long, doc long, tie long, place long"


class _Hashes:
    """Hashes of all substrings of an arena, by prefix sums modulo 2^64."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.table = draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(draw.integers(1 << 20, 1 << 62)) * 8 + 5
        self.up, self.down = self._powers(base), self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(ARENA + 1, base % (1 << 64), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[: len(raw)], out=out[1:])
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over each other."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : n]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[: n - width + 1]
    return np.minimum(ahead, behind)


class Spans:
    """Cuts texts into spans: runs of neighbouring windows with one anchor."""

    def __init__(self):
        self.grams, self.spans = _Hashes(1), _Hashes(2)

    def of(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, windows, start to anchor, anchor hash, span hash); `ends` tells where each byte's text ends."""
        none = np.zeros(0, np.int64)
        if len(raw) < WIDTH:
            return none, none, none, none, none
        sums = self.grams.sums(raw)
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * self.grams.down[: len(raw) - GRAM + 1])
        places = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64(ARENA - 1)
        least = (_smallest((grams & ~low) | places, GRAMS) & low).astype(np.int64)
        at = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= WIDTH)
        if not len(at):
            return none, none, none, none, none
        anchor = least[at]
        first = np.concatenate([[0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1])
        windows = np.diff(np.append(first, len(at)))
        start, anchor = at[first], anchor[first]
        stop = start + windows + WIDTH - 1
        sums = self.spans.sums(raw)
        shape = ((anchor - start) * 256 + windows).astype(np.uint64)
        span = _mixed((sums[stop] - sums[start]) * self.spans.down[start] + shape * np.uint64(0xD6E8FEB86659FD93))
        return start, windows, anchor - start, grams[anchor].view(np.int64), span.view(np.int64)


def _arenas(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, end of each byte's piece, row and offset of each byte's piece, by piece bounds).

    Texts stand side by side; one longer than an arena is cut into pieces that
    overlap by WIDTH - 1 bytes, so that each window lies whole in one piece.
    """
    binary = texts.cast(pa.large_binary())
    bounds = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    pieces, size = [], 0
    for row in range(len(binary)):
        at, end = int(bounds[row]), int(bounds[row + 1])
        while end - at >= WIDTH:
            to = min(end, at + ARENA - 1)
            if size + to - at >= ARENA:
                yield _arena(data, pieces, bounds)
                pieces, size = [], 0
            pieces.append((row, at, to))
            size += to - at
            if to == end:
                break
            at = to - WIDTH + 1
    if pieces:
        yield _arena(data, pieces, bounds)


def _arena(data: np.ndarray, pieces: list[tuple[int, int, int]], bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    rows, starts, stops = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
    sizes = stops - starts
    edges = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.concatenate([data[a:b] for a, b in zip(starts, stops, strict=True)])
    return raw, np.repeat(edges[1:], sizes), edges, np.stack([rows, starts - bounds[rows] - edges[:-1]])


def _later_ones(groups: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Places of rows that have one before them, by `order`, with the same group."""
    by = np.argsort(groups[0], kind="stable")
    same = np.zeros(len(by), bool)
    same[1:] = groups[0][by][1:] == groups[0][by][:-1]
    same[:-1] |= same[1:]
    some = by[same]
    if not len(some):
        return some
    some = some[np.lexsort([c[some] for c in (*reversed(order), *reversed(groups))])]
    repeats = np.zeros(len(some), bool)
    repeats[1:] = np.logical_and.reduce([c[some][1:] == c[some][:-1] for c in groups])
    return some[repeats]


def _ranges(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching ranges of one document as one."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, stop = doc[order], tie[order], start[order], stop[order]
    if not len(doc):
        return doc, tie, start, stop
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    owner = np.cumsum(new) - 1
    # The furthest stop so far: documents are set apart by offsets that grow.
    step = int(stop.max()) + 1
    if owner[-1] < (1 << 62) // step:
        far = np.maximum.accumulate(stop + owner * step) - owner * step
        new[1:] |= start[1:] > far[:-1]
        at = np.flatnonzero(new)
        return doc[at], tie[at], start[at], np.maximum.reduceat(stop, at)
    return doc, tie, start, stop


def _cut(docs: DataFrame) -> DataFrame:
    """All spans, but for those of which a batch holds an earlier copy: these are removed bytes already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans()
        for batch in batches:
            doc, tie = (batch[c].to_numpy(zero_copy_only=False) for c in KEY)
            parts = []
            for raw, ends, edges, (rows, shift) in _arenas(batch["text"]):
                start, windows, ahead, anchor, span = spans.of(raw, ends)
                piece = np.searchsorted(edges, start, "right") - 1
                place = (start + shift[piece] << 16) | (ahead << 8) | windows
                parts.append((anchor, span, doc[rows[piece]], tie[rows[piece]], place))
            if not parts:
                continue
            anchor, span, doc, tie, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            later = _later_ones([span, anchor], [doc, tie, place])
            gone = place[later]
            ranges = _ranges(doc[later], tie[later], gone >> 16, (gone >> 16) + (gone & 255) + WIDTH - 1)
            stay = np.ones(len(anchor), bool)
            stay[later] = False
            yield _spans(*(c[stay] for c in (anchor, span, doc, tie, place)))
            yield _removed(*ranges)

    return docs.select(*KEY, "text").mapInArrow(run, SPAN)


def _spans(*columns: np.ndarray) -> pa.RecordBatch:
    names = ["anchor", "span", *ORDER]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _removed(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Removed bytes as rows among the spans, dealt by a hash of their own."""
    dealt = _mixed(doc.view(np.uint64) + start.astype(np.uint64)).view(np.int64)
    return _spans(dealt, stop - start, doc, tie, start << 16)


def _compared(cut: DataFrame) -> DataFrame:
    """Removed bytes, and the spans whose anchor has others too, in lots.

    A task reads its spans in order; it keeps one span at a time, so an anchor
    of any number of spans passes through.
    """
    shape = f"{SPAN}, lot long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (anchor, span, number of the span, the row that waits for a second span)
        for batch in batches:
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("anchor", "span", *ORDER)]
            gone = columns[4] & 255 == 0
            done = [c[gone] for c in columns]
            anchor, span, doc, tie, place = live = [c[~gone] for c in columns]
            if len(anchor):
                new_anchor, new_span = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
                new_anchor[1:] = anchor[1:] != anchor[:-1]
                new_span[1:] = new_anchor[1:] | (span[1:] != span[:-1])
                goes_on = last is not None and last[0] == anchor[0]
                if goes_on:
                    new_anchor[0], new_span[0] = False, last[1] != span[0]
                group = np.cumsum(new_anchor) - new_anchor[0]
                number = np.cumsum(new_span)
                starts = np.searchsorted(group, np.arange(group[-1] + 1))
                number = number - number[starts][group]
                if goes_on:
                    number[group == 0] += last[2] + new_span[0]
                again = ~new_span
                copies = _ranges(doc[again], tie[again], place[again] >> 16, (place[again] >> 16) + (place[again] & 255) + WIDTH - 1)
                highest = np.maximum.reduceat(number, starts)
                chosen = new_span & (highest[group] > 0)
                out = [*(c[chosen] for c in live), number[chosen] // LOT]
                if goes_on and last[3] is not None and highest[0] > 0:
                    out = [np.append(c, v) for c, v in zip(out, (*last[3], 0), strict=True)]
                    waiting = None
                else:
                    waiting = last[3] if goes_on else None
                if group[-1] > 0 or not goes_on:
                    at = starts[-1]
                    waiting = [c[at] for c in live] if highest[-1] == 0 else None
                last = (anchor[-1], span[-1], int(number[-1]), waiting)
                yield _in_lots(*out)
                done = [np.concatenate(c) for c in zip(done, _columns(_removed(*copies)), strict=True)]
            yield _in_lots(*done, np.zeros(len(done[0]), np.int64))

    dealt = cut.repartition("anchor").sortWithinPartitions("anchor", "span", *ORDER)
    return dealt.mapInArrow(run, shape)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _in_lots(*columns: np.ndarray) -> pa.RecordBatch:
    names = ["anchor", "span", *ORDER, "lot"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _with_bytes(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """The spans with their text."""
    shape = "anchor long, lot long, doc long, tie long, place long, bytes binary"
    listed = spans.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "lot", "place")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            sizes = batch["spans"].value_lengths().to_numpy(zero_copy_only=False)
            rows, own = np.repeat(np.arange(batch.num_rows), sizes), batch["spans"].flatten()
            place = own.field("place").to_numpy(zero_copy_only=False)
            cuts = zip(rows.tolist(), (place >> 16).tolist(), (place & 255).tolist(), strict=True)
            views = [memoryview(t.as_buffer()) for t in texts]
            cut = pa.array([bytes(views[r][a : a + n + WIDTH - 1]) for r, a, n in cuts], pa.binary())
            arrays = [own.field("anchor"), own.field("lot"), *(batch[c].take(pa.array(rows)) for c in KEY)]
            names = ["anchor", "lot", *ORDER, "bytes"]
            yield pa.RecordBatch.from_arrays([*arrays, own.field("place"), cut], names=names)

    return docs.select(*KEY, "text").join(listed, KEY).mapInArrow(run, shape)


def radix_groups(text: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, group) of the windows that share all WIDTH bytes with another one of their first group.

    Most significant digit first; windows that are alone drop out after each pass.
    """
    places = np.arange(len(starts))
    for at in range(-DIGIT, WIDTH, DIGIT):
        if at < 0:
            order = np.argsort(groups, kind="stable")
            changes = groups[order][1:] != groups[order][:-1]
        else:
            digit = np.zeros((len(places), DIGIT), np.uint8)
            width = min(DIGIT, WIDTH - at)
            digit[:, :width] = text[starts[places][:, None] + np.arange(at, at + width)]
            digit = digit.view(">u8").ravel().astype(np.uint64)
            order = np.lexsort((digit, groups))
            changes = (groups[order][1:] != groups[order][:-1]) | (digit[order][1:] != digit[order][:-1])
        edge = np.concatenate([[True], changes, [True]]) if len(order) else np.zeros(1, bool)
        shared = ~(edge[:-1] & edge[1:]) if len(order) else np.zeros(0, bool)
        label = np.cumsum(edge[:-1]) if len(order) else np.zeros(0, np.int64)
        places, groups = places[order][shared], label[shared]
        if not len(places):
            break
    return places, groups


def _sorted(spans: DataFrame) -> DataFrame:
    """Removed bytes of the windows inside each lot; of anchors with several lots also the first of each window.

    The latter come with a digest: doc, tie, start, length, high, low.
    """
    shape = "doc long, tie long, start long, length long, high long, low long"

    def sort(rows: pa.Table) -> pa.RecordBatch:
        anchor, lot, doc, tie, place = (rows[c].to_numpy() for c in ("anchor", "lot", *ORDER))
        pieces = rows["bytes"].combine_chunks().cast(pa.large_binary())
        text = np.frombuffer(pieces.buffers()[2], np.uint8)
        bounds = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces)]
        windows, ahead = place & 255, (place >> 8) & 255
        span = np.repeat(np.arange(len(place)), windows)
        inner = np.arange(len(span)) - np.repeat(np.cumsum(windows) - windows, windows)
        new = np.ones(len(place), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (lot[1:] != lot[:-1])
        group = np.cumsum(new) - 1
        starts = bounds[span] + inner
        found, label = radix_groups(text, starts, group[span] * WIDTH + (ahead[span] - inner))
        begin = (place[span] >> 16) + inner
        owner = span[found]
        order = np.lexsort((begin[found], tie[owner], doc[owner], label))
        later = np.zeros(len(order), bool)
        later[1:] = label[order][1:] == label[order][:-1]
        gone = found[order[later]]
        ranges = _ranges(doc[span[gone]], tie[span[gone]], begin[gone], begin[gone] + WIDTH)
        many = (lot > 0) | (np.bincount(group)[group] >= LOT)
        first = many[span]
        first[gone] = False
        left = np.flatnonzero(first)
        digests = b"".join(hashlib.blake2b(text[s : s + WIDTH].tobytes(), digest_size=16).digest() for s in starts[left])
        halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
        none = np.zeros(len(ranges[0]), np.int64)
        size = np.full(len(left), WIDTH)
        columns = [
            np.concatenate([a, b])
            for a, b in (
                (ranges[0], doc[span[left]]),
                (ranges[1], tie[span[left]]),
                (ranges[2], begin[left]),
                (ranges[3] - ranges[2], size),
                (none, halves[:, 0]),
                (none, halves[:, 1]),
            )
        ]
        told = np.concatenate([np.zeros(len(none), bool), np.ones(len(left), bool)])
        arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
        arrays += [pa.array(c, pa.int64(), mask=~told) for c in columns[4:]]
        return pa.RecordBatch.from_arrays(arrays, names=["doc", "tie", "start", "length", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < PENDING_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            anchor, lot = (rows[c].to_numpy() for c in ("anchor", "lot"))
            edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (lot[1:] != lot[:-1])) + 1
            if len(edges):  # the last group may go on
                yield sort(rows.slice(0, int(edges[-1])))
                held = rows.slice(int(edges[-1])).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                yield sort(rows)

    return spans.repartition("anchor", "lot").sortWithinPartitions("anchor", "lot").mapInArrow(run, shape)


def _between_lots(sorted_spans: DataFrame) -> DataFrame:
    """Removed bytes of windows that an earlier one of another lot equals; a digest has a row per lot at most."""
    own = Window.partitionBy("high", "low").orderBy(*KEY, "start")
    told = sorted_spans.where("high IS NOT NULL").withColumn("_i", F.row_number().over(own))
    return told.where("_i > 1").select(*KEY, "start", "length")


def _kept(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """What is left of each text once its ranges are taken out."""
    shape = "doc_id long, doc long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    listed = ranges.groupBy(*KEY).agg(F.collect_list(F.struct("start", "length")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            out = []
            for row in range(batch.num_rows):
                text = memoryview(texts[row].as_buffer())
                digest, at, removed, spans = hashlib.sha256(), 0, 0, 0
                if batch["ranges"][row].is_valid:
                    own = batch["ranges"].slice(row, 1).flatten()
                    start, length = (own.field(c).to_numpy(zero_copy_only=False) for c in ("start", "length"))
                    same = np.zeros(len(start), np.int64)
                    _, _, starts, stops = _ranges(same, same, start, start + length)
                    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                        digest.update(text[at:a])
                        at, removed, spans = b, removed + b - a, spans + 1
                digest.update(text[at:])
                out.append((len(text), removed, spans, digest.hexdigest()))
            sizes, removed, spans, digests = zip(*out, strict=True) if out else ((), (), (), ())
            arrays = [batch[c] for c in ("doc_id", *KEY)]
            arrays += [pa.array(c, pa.int64()) for c in (sizes, removed, spans)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(digests, pa.string())],
                names=["doc_id", *KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return docs.join(listed, KEY, "left").select("doc_id", *KEY, "text", "ranges").mapInArrow(run, shape)


def _copies(found: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each copy: the first as it is, the others without what they repeat, which is all or nothing."""
    each = found.join(counts, KEY).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    whole = (F.col("_copy") > 1) & (F.col("n_bytes") >= WIDTH)
    return each.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def remove_repeats(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see the head of this file."""
    first = F.lit(-(1 << 63)).cast("long")
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = ids.withColumn("doc", F.coalesce("doc_id", first))
    repeated = not docs.groupBy("doc").count().where("count > 1").isEmpty()
    docs = docs.withColumn("tie", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    if repeated:
        counts = docs.groupBy(*KEY).agg(F.count("*").alias("copies"))
        docs = stored(docs.dropDuplicates(KEY), "texts")
    compared = stored(_compared(_cut(docs)), "spans")
    spans = compared.where("place & 255 > 0")
    sorted_spans = stored(_sorted(_with_bytes(spans, docs)), "windows")
    ranges = (
        compared.where("place & 255 = 0")
        .select(*KEY, F.shiftright("place", 16).alias("start"), F.col("span").alias("length"))
        .union(sorted_spans.where("high IS NULL").select(*KEY, "start", "length"))
        .union(_between_lots(sorted_spans))
    )
    found = _kept(docs, ranges)
    if repeated:
        return _copies(found, counts)
    return found.drop(*KEY)
