"""Similarity join on 5-word shingles with count vectors in an R-tree.

The shingles of a document are hashed into groups; the counts per group are a
point. For two documents the sum of the smaller counts bounds the overlap, for
a box of points the sum with the box's largest counts does, so a tree over the
points leaves out whole boxes.

A box over unrelated documents of like size bounds nothing, whatever the number
of groups, so one tree over a corpus would compare all with all. Documents are
therefore dealt to buckets first, without losing a pair: of two documents with
a similarity of t, each one's n - ceil(t * n) + 1 rarest shingles hold a common
one. An inverted index in ranges of shingle hashes tells how many documents
hold a shingle; those of a single document are dropped there, and a document
with fewer than t * n others is like no one. Within a bucket

1. every member is compared with one leader, another one in each bucket, and
   the links found are joined to components;
2. members of buckets that still hold several components go into R-trees, which
   give the pairs of different components whose bound suffices.

All surviving pairs are verified on the sets themselves. Step 2 leaves out only
pairs that are connected already, so components are those of all links, while
a group of n near copies costs about n comparisons a bucket.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import Splits, free_name, stored
from docspark.llm.components import components
from docspark.llm.textgrid import slices

SHINGLE = 5
PERCENT = 80
GROUPS = 256
LEAF = 16
#: Members of a bucket that one tree takes; larger buckets are dealt as pairs of stripes.
TREE = 256
#: Entries of the inverted index that one range holds, about.
RANGE = 1_000_000
#: Shingles kept as frequent, at most, and the least count of one. They skip the
#: inverted index, so no range holds the documents of a very common shingle.
FREQUENT, LEAST = 50_000, 50
#: Ids up to this many are broadcast (8 bytes each), beyond it shuffled.
BROADCAST_IDS = 500_000

_SEED = np.random.default_rng(20240131)
_BYTE = _SEED.integers(1, 2**63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_MULT = _SEED.integers(1, 2**63, SHINGLE + 1, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

POINTS = T.StructType(
    [
        T.StructField("slice", T.LongType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("cls", T.LongType()),
        T.StructField("vec", T.BinaryType()),
        T.StructField("key", T.LongType()),
        T.StructField("seen", T.LongType()),
    ]
)
ENTRIES = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("slice", T.LongType()),
        T.StructField("keys", T.BinaryType()),
        T.StructField("at", T.BinaryType()),
        T.StructField("held", T.BinaryType()),
    ]
)
PREFIXES = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType())])
SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of the texts, and where each text's begin.

    The sets are sorted. A text of fewer than `SHINGLE` words has one shingle,
    all its words; without words it has none. Texts are UTF-8.
    """
    raw = np.frombuffer(b" " + b"".join(t + b" " for t in texts), np.uint8)
    space = _SPACE[raw]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    text_end = np.cumsum([len(t) + 1 for t in texts]) + 1
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    word = _mix((sums[last] - sums[first]) * _powers(_INVERSE, len(raw))[first] + (last - first).astype(np.uint64))
    of = np.searchsorted(text_end, first, side="right")
    n_words = np.bincount(of, minlength=len(texts))
    begins = np.cumsum(n_words) - n_words
    shingle = np.zeros(len(word), np.uint64)
    length = np.minimum(n_words[of], SHINGLE)
    for j in range(SHINGLE):
        there = np.minimum(np.arange(len(word)) + j, len(word) - 1)
        shingle += np.where(j < length, word[there] * _MULT[j], np.uint64(0))
    shingle = _mix(shingle + length.astype(np.uint64) * _MULT[SHINGLE])
    at = np.arange(len(word)) - begins[of]
    whole = at <= np.maximum(n_words[of] - SHINGLE, 0)
    shingle, of = shingle[whole], of[whole]
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    shingle, of = shingle[new], of[new]
    return shingle, np.searchsorted(of, np.arange(len(texts) + 1))


def _classes(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One number per set, equal for equal sets."""
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(_mix(sets ^ _BASE), out=sums[1:])
    n = np.diff(starts).astype(np.uint64)
    return _mix(sums[starts[1:]] - sums[starts[:-1]] + n * _MULT[0])


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """Slices of (doc_id, text) with their numbers, doc_ids and texts.

    A number is made of the partition and the place in it, so that another
    read of the same files, cut alike (`Splits`), numbers the same documents alike.
    """
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at, part in slices(_texts(batch.column(1))):
            yield number, batch.column(0).slice(at, len(part)), part
            number += 1


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size, number and group counts; per shingle that
    several documents of a slice hold, how many do."""
    for number, doc_ids, part in _slices(batches):
        sets, starts = shingle_sets(part)
        n = np.diff(starts)
        of = np.repeat(np.arange(len(part)), n)
        group = of * GROUPS + (sets & np.uint64(GROUPS - 1)).astype(np.int64)
        vec = np.bincount(group, minlength=len(part) * GROUPS).reshape(len(part), GROUPS)
        key, seen = np.unique(sets, return_counts=True)
        key, seen = key[seen > 1], seen[seen > 1]
        docs, none = len(part), len(key)
        vecs = pa.array([x.astype(np.uint16 if x.max() < 2**16 else np.uint32).tobytes() for x in vec], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(docs + none, number)),
                pa.concat_arrays([pa.array(np.arange(docs, dtype=np.int32)), pa.nulls(none, pa.int32())]),
                pa.concat_arrays([doc_ids, pa.nulls(none, pa.int64())]),
                pa.concat_arrays([pa.array(n.astype(np.int32)), pa.nulls(none, pa.int32())]),
                pa.concat_arrays([pa.array(_classes(sets, starts).view(np.int64)), pa.nulls(none, pa.int64())]),
                pa.concat_arrays([vecs, pa.nulls(none, pa.binary())]),
                pa.concat_arrays([pa.nulls(docs, pa.int64()), pa.array(key.view(np.int64))]),
                pa.concat_arrays([pa.nulls(docs, pa.int64()), pa.array(seen.astype(np.int64))]),
            ],
            POINTS.fieldNames(),
        )


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first: the last ones are mostly zero."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _entries(docs: DataFrame, keys: np.ndarray, seen: np.ndarray, bits: int) -> DataFrame:
    """The inverted index, dealt to 2^bits ranges of hashes.

    A row holds the shingles of one slice in one range: the next 32 bits of
    each hash, as steps, and the document's place in the slice. A shorter hash
    may put two shingles under one key; that adds a bucket, never a link.
    Frequent shingles come in rows of their own with their counts.
    """
    frequent = docs.sparkSession.sparkContext.broadcast((keys, seen))  # FREQUENT at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = frequent.value
        for number, _, part in _slices(batches):
            sets, starts = shingle_sets(part)
            at = np.repeat(np.arange(len(part)), np.diff(starts)).astype(np.uint16)
            order = np.argsort(sets, kind="stable")
            key, at = sets[order] >> np.uint64(32 - bits), at[order]
            parts, rows = [], []
            often = np.zeros(len(key), bool)
            if len(known):
                i = np.minimum(np.searchsorted(known, key), len(known) - 1)
                often = known[i] == key
                if often.any():
                    held = (count[i[often]] + (1 << 40)).astype(np.int64)
                    parts.append((1 << bits) + number % (1 << bits))
                    rows.append((key[often].tobytes(), _planes(at[often]), held.tobytes()))
            key, at = key[~often], at[~often]
            of = (key >> np.uint64(32)).astype(np.int64)
            low = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(of)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if b > a:
                    parts.append(of[a])
                    rows.append((_planes(np.diff(low[a:b], prepend=0).astype(np.uint32)), _planes(at[a:b]), None))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(parts, pa.int64()),
                    pa.array(np.full(len(parts), number)),
                    *(pa.array(c, pa.binary()) for c in columns),
                ],
                ENTRIES.fieldNames(),
            )

    return docs.mapInArrow(emit, ENTRIES)


def _shared(table: pa.Table) -> pa.Table:
    """Of one range, the entries whose shingle several documents hold."""
    part = table["part"][0].as_py()
    if table["held"][0].is_valid:
        return table
    raw = table["keys"].to_pylist()
    steps = [_unplaned(x, np.uint32).astype(np.int64).cumsum() for x in raw]
    key = np.concatenate(steps)
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    held = count[where]
    key += part << 32
    ends = np.cumsum([len(x) for x in steps])
    out: dict[str, list] = {"slice": [], "keys": [], "at": [], "held": []}
    for number, at, a, b in zip(
        table["slice"].to_pylist(), table["at"].to_pylist(), [0, *ends[:-1]], ends, strict=True
    ):
        some = held[a:b] > 1
        if some.any():
            out["slice"].append(number)
            out["keys"].append(key[a:b][some].tobytes())
            out["at"].append(_planes(_unplaned(at, np.uint16)[some]))
            out["held"].append(held[a:b][some].astype(np.int64).tobytes())
    return pa.table(
        [
            pa.array([part] * len(out["slice"]), pa.int64()),
            pa.array(out["slice"], pa.int64()),
            *(pa.array(out[c], pa.binary()) for c in ("keys", "at", "held")),
        ],
        ENTRIES.fieldNames(),
    )


def _rarest(entries: pa.Table, points: pa.Table) -> pa.Table:
    """(key, id) of one slice: the rarest shingles of documents with few of
    their own, by how many documents hold one and then by its key."""
    n = points["n"].to_numpy()[np.argsort(points["place"].to_numpy())]
    cls = points["cls"].to_numpy()[np.argsort(points["place"].to_numpy())]
    join = lambda name, kind: np.frombuffer(b"".join(entries[name].to_pylist()), kind)
    key, held = join("keys", np.int64), join("held", np.int64)
    at = np.concatenate([_unplaned(x, np.uint16) for x in entries["at"].to_pylist()] + [np.zeros(0, np.uint16)])
    at = at.astype(np.int64)
    least = (PERCENT * n + 99) // 100
    shared = np.bincount(at, minlength=len(n))
    order = np.lexsort((key, held, at))
    key, at = key[order], at[order]
    rank = np.arange(len(at)) - (np.cumsum(shared) - shared)[at]
    taken = rank < (shared - least + 1)[at]
    return pa.table([pa.array(key[taken]), pa.array(cls[at[taken]])], PREFIXES.fieldNames())


def _prefixes(docs: DataFrame, points: DataFrame, keys: np.ndarray, seen: np.ndarray, total: int) -> DataFrame:
    """(key, id): the shingles of the prefixes that other documents hold too."""
    bits = max(8, (total // RANGE).bit_length())
    order = np.argsort(keys)
    short, first = np.unique(keys[order] >> np.uint64(32 - bits), return_index=True)
    entries = _entries(docs, short, seen[order][first], bits)
    shared = entries.groupBy("part").applyInArrow(_shared, ENTRIES)
    return (
        shared.groupBy("slice").cogroup(points.select("slice", "place", "n", "cls").groupBy("slice"))
        .applyInArrow(_rarest, PREFIXES)
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, part in slices(_texts(batch.column(0))):
            sets, starts = shingle_sets(part)
            some = np.diff(starts) > 0
            lists = pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(sets.view(np.int64)))
            cls = pa.array(_classes(sets, starts).view(np.int64))
            yield pa.RecordBatch.from_arrays([cls, lists], SETS.fieldNames()).filter(pa.array(some))


class Tree:
    """A packed R-tree over (size, group counts)."""

    def __init__(self, n: np.ndarray, vec: np.ndarray):
        self.order = np.lexsort((vec[:, 0], n))
        self.n, self.vec = n[self.order], vec[self.order]
        self.levels = []
        low, high, top = self.n, self.n, self.vec
        while len(low) > 1:
            at = np.arange(0, len(low), LEAF)
            low, high, top = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(top, at)
            self.levels.append((low, high, top))

    def near(self, n: int, vec: np.ndarray) -> np.ndarray:
        """The points whose bound allows the similarity with the given one."""
        at = np.zeros(1, np.int64)
        for low, high, top in reversed(self.levels):
            at = at[at < len(low)]
            fits = (100 * high[at] >= PERCENT * n) & (PERCENT * low[at] <= 100 * n)
            bound = np.minimum(top[at], vec).sum(1)
            # overlap >= t / (1 + t) * (both sizes); the smallest size in the box asks least
            at = at[fits & ((100 + PERCENT) * bound >= PERCENT * (n + low[at]))]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.n)]
        bound = np.minimum(self.vec[at], vec).sum(1)
        fits = (100 + PERCENT) * bound >= PERCENT * (n + self.n[at])
        fits &= 100 * np.minimum(n, self.n[at]) >= PERCENT * np.maximum(n, self.n[at])
        return self.order[at[fits]]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components that the trees leave, bucket by bucket.

    Rows (bucket, side, id, component, n, vec) come sorted by bucket. In a
    bucket made of two stripes, pairs lie across; else within.
    """

    def pairs(bucket: list[np.ndarray]) -> np.ndarray:
        _, side, ids, comp, n, vec = (np.concatenate(c) for c in zip(*bucket, strict=True))
        tree = Tree(n, vec)
        found = []
        within = (side == 0).all()
        for i in range(len(ids)):
            j = tree.near(n[i], vec[i])
            j = j[(comp[j] != comp[i]) & ((ids[j] > ids[i]) if within else (side[j] > side[i]))]
            if len(j):
                found.append(np.stack([np.full(len(j), ids[i]), ids[j]], 1))
        out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return np.sort(out, axis=1)

    told: set[tuple[int, int]] = set()

    def out(found: np.ndarray) -> pa.RecordBatch:
        """The pairs that this task has not told lately; `distinct` does the rest."""
        if len(told) > 200_000:
            told.clear()
        new = [p for p in map(tuple, found.tolist()) if p not in told]
        told.update(new)
        found = np.array(new, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], PAIRS.fieldNames())

    open_: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        raw = batch.column(5).to_pylist()
        vec = np.stack([np.frombuffer(x, np.uint16 if len(x) == 2 * GROUPS else np.uint32).astype(np.int32) for x in raw])
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if open_ and open_[-1][0][0] != cols[0][a]:
                yield out(pairs(open_))
                open_ = []
            open_.append((*(c[a:b] for c in cols), vec[a:b]))
    if open_:
        yield out(pairs(open_))


def _alike(a: Column, b: Column) -> Column:
    """Do the sizes of a pair allow the similarity?"""
    return 100 * F.least(a, b).cast("long") >= PERCENT * F.greatest(a, b).cast("long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough."""
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b")), "b"
    )
    common = F.size(F.array_intersect("_a", "_b")).cast("long")
    return met.where(
        (100 + PERCENT) * common >= PERCENT * (F.size("_a").cast("long") + F.size("_b").cast("long"))
    ).select("a", "b")


def _broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _residual(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs left by the R-trees of buckets that hold several components."""
    whole = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    whole = stored(whole, "members")
    # Stripes are a power of two, so that buckets of much the same members are
    # cut alike, and go where their first member sends them: a task then meets
    # a pair again rather than another task, and tells it once.
    stripes = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_size") / TREE)))).cast("int")
    open_ = (
        whole.groupBy("key")
        .agg(
            F.min("component").alias("_low"),
            F.max("component").alias("_high"),
            F.min("id").alias("_first"),
            F.count("*").alias("_size"),
        )
        .where("_low <> _high")
        .select("key", "_first", stripes.alias("_stripes"))
    )
    stripe = F.pmod(F.xxhash64("id"), F.col("_stripes")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_stripes") - 1))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    dealt = (
        whole.join(open_, "key")
        .withColumn("_own", stripe)
        .withColumn("_other", other)
        .withColumn("bucket", F.xxhash64("key", low, high))
        .withColumn("route", F.xxhash64("_first", low, high))
        # 0 in a bucket of one stripe, else 1 and 2 for the stripe's rank
        .withColumn(
            "side",
            F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2),
        )
    )
    rows = dealt.join(classes.select("id", "n", "vec"), "id").select(
        "route", "bucket", F.col("side").cast("long"), "id", "component", F.col("n").cast("long"), "vec"
    )
    sent = rows.repartition("route").sortWithinPartitions("bucket").drop("route")
    return sent.mapInArrow(_search, PAIRS).distinct()


def similar_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: its set's size and the group it belongs to.

    Two documents are linked if 100 times the common shingles are at least 80
    times the shingles of both; component_id is the smallest doc_id that links
    reach. A NULL text, an empty one and one of white space have no shingles and
    stay alone. Rows without a doc_id are linked like all others; their
    component_id is NULL unless a row with a doc_id is in their group. Equal
    sets, repeated rows among them, are one point and share a group. An empty
    table gives no rows. Only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    splits = Splits(spark)
    points = splits.stored(docs.mapInArrow(_points, POINTS), "points")
    seen = points.where("key IS NOT NULL").groupBy("key").agg(F.sum("seen").alias("seen"))
    seen = stored(seen.where(F.col("seen") >= LEAST), "frequent")
    total = seen.agg(F.sum("seen")).first()[0] or 0
    # At most total / floor shingles can be seen so often: FREQUENT of them.
    often = seen.where(F.col("seen") >= total / FREQUENT).toArrow()
    keys = often["key"].to_numpy().view(np.uint64)
    rows = points.where("key IS NULL AND n > 0")
    classes = stored(
        rows.groupBy(F.col("cls").alias("id")).agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("vec").alias("vec")
        ),
        "classes",
    )
    every = points.where("key IS NULL")
    shingles = every.agg(F.sum("n")).first()[0] or 0
    prefixes = splits.stored(_prefixes(docs, every, keys, often["seen"].to_numpy(), shingles), "prefixes")
    # The mask orders the classes of each bucket in another way, so leaders differ.
    mask = F.xxhash64("key")
    buckets = (
        prefixes.groupBy("key")
        .agg(F.min(F.col("id").bitwiseXOR(mask)).alias("_first"), F.max(F.col("id").bitwiseXOR(mask)).alias("_last"))
        .where("_first <> _last")
        .select("key", F.col("_first").bitwiseXOR(mask).alias("leader"))
    )
    shared = stored(prefixes.join(buckets, "key").distinct(), "buckets")
    held = shared.select("id").distinct().join(classes.select("id", "doc_id"), "id")
    wanted = _broadcast_if_small(stored(held.select("doc_id"), "wanted"), BROADCAST_IDS)
    sets = docs.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(_sets, SETS)
    nameless = held.where("doc_id IS NULL").select("id")
    if not nameless.isEmpty():  # sets that only rows without a doc_id have
        more = docs.where("doc_id IS NULL").select("text").mapInArrow(_sets, SETS)
        sets = sets.union(more.join(nameless, "id", "left_semi").dropDuplicates(["id"]))
    sets = stored(sets, "sets")
    near = (
        shared.where("id <> leader")
        .select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
        .distinct()
        .join(classes.select(F.col("id").alias("a"), F.col("n").alias("_na")), "a")
        .join(classes.select(F.col("id").alias("b"), F.col("n").alias("_nb")), "b")
        .where(_alike(F.col("_na"), F.col("_nb")))
        .select("a", "b")
    )
    stars = stored(_verified(near, sets), "stars")
    labels = components(stars)
    more = stored(_verified(_residual(shared.select("key", "id"), classes, labels), sets), "more")
    if not more.isEmpty():
        labels = components(stars.union(more))
    labelled = classes.join(labels, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = labelled.join(least, "component").select(F.col("id").alias("cls"), "component_id")
    return (
        points.where("key IS NULL")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
        .join(grouped, "cls", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group, that of the smallest doc_id, columns unchanged.

    Rows are grouped and judged each by its own text: they are numbered first,
    so that rows that share a doc_id, or have none, are told apart. A row
    without a doc_id stays only if no row of its group has one; of rows with
    one doc_id any may stay. Rows without shingles all stay.
    """
    row = free_name(docs, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = similar_groups(spark, numbered.select(F.col(row).alias("doc_id"), "text"))
    groups = stored(groups.select(F.col("doc_id").alias(row), F.col("component_id").alias("_group")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row)))
    kept = groups.join(numbered.select(row, "doc_id"), row).groupBy("_group").agg(first.alias("_first"))
    rest = groups.join(kept.select(f"_first.{row}"), row, "left_anti").select(row)
    return numbered.join(rest, row, "left_anti").select(*docs.columns)
