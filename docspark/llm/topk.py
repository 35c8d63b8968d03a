"""Exact top-k search by tiled matrix products.

Queries are dealt to groups, candidates to stripes, and each (group, stripe) is
one task: its queries come first, then its candidates in the order of their
ids. A product of some queries and a block of candidates gives a tile of
scores, of which only those above the k-th best so far of their query go on.
So a task holds one group, k rows for each of its queries and one block,
however long the stripe is, and gives k rows per query. Those of the stripes
are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import stored

#: Candidates and queries of a tile.
BLOCK, TILE_QUERIES = 2048, 1024
#: Components that the queries of a group, and vectors that a stripe, hold at most, about.
GROUP_CELLS, STRIPE_ROWS = 1 << 21, 1 << 18
#: The least number of each, so that small tables, too, fill many cores.
GROUPS, STRIPES = 4, 8

PACKED = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("numbers", T.BinaryType()),
    ]
)
FOUND = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("score", T.LongType()),
    ]
)


#: Types of packed numbers by their bytes.
KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 * x) of each component, as double.

    Vectors that are NULL or empty, or hold a NULL, NaN or infinite component,
    and rows without a vec_id, are left out.
    """
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is above it
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite)
    return vectors.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"),
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's numbers in the fewest bytes that hold them all."""
    for batch in batches:
        offsets = batch.column(1).offsets.to_numpy()
        flat = batch.column(1).flatten().to_numpy()
        width = np.diff(offsets)
        ends = np.cumsum(width)
        numbers = np.empty(len(width), object)
        if len(width):
            largest = np.maximum.reduceat(np.abs(flat), ends - width)  # no vector is empty
            size = np.select([largest < 2**7, largest < 2**15, largest < 2**31], [1, 2, 4], 8)
            for n in np.unique(size):
                with np.errstate(invalid="ignore"):  # of vectors that need more bytes
                    whole = flat.astype(KINDS[n])
                for i in np.flatnonzero(size == n):
                    numbers[i] = whole[ends[i] - width[i] : ends[i]].tobytes()
        columns = [batch.column(0), pa.array(width, pa.int32()), pa.array(numbers, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, PACKED.fieldNames())


def _unpacked(numbers: list[bytes], width: int) -> np.ndarray:
    """The numbers of vectors of one width, a row each."""
    size = np.array([len(x) for x in numbers]) // width
    out = np.empty((len(numbers), width))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = np.frombuffer(b"".join([numbers[i] for i in at]), KINDS[n]).reshape(-1, width)
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in floating point where that is exact."""
    bound = q.shape[1] * max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1)
    if bound < 2**24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if bound < 2**53:
        return q @ c.T
    return q.astype(np.int64) @ c.astype(np.int64).T


def best(q_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each row of a tile the k best other ids, ties to the smaller: rows, columns.

    Columns must be sorted by id, so that the place tells ties apart.
    """
    n = len(ids)
    rows, columns = [], []
    for a in range(0, len(q_ids), 256):
        part = score[a : a + 256]
        own = q_ids[a : a + 256, None] == ids
        if np.abs(part).max(initial=0) < 2**62 // n:
            key = part * n - np.arange(n)
            key[own] = np.iinfo(np.int64).min
            keep = min(k, n)
            at = np.argpartition(key, n - keep, axis=1)[:, n - keep :]
        else:
            at = np.argsort(-part, axis=1, kind="stable")
            own_last = np.argsort(np.take_along_axis(own, at, 1), axis=1, kind="stable")
            at = np.take_along_axis(at, own_last, 1)[:, :k]
        row = np.repeat(np.arange(len(part)), at.shape[1])
        column = at.ravel()
        other = ~own[row, column]
        rows.append(row[other] + a)
        columns.append(column[other])
    return np.concatenate(rows), np.concatenate(columns)


class Best:
    """The k best candidates so far of each query of a group.

    Candidates must come in the order of their ids, so that of equal scores the
    first stays.
    """

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.least = np.full(len(q_ids), -np.inf)  # a score must be above it
        self.found = [tuple(np.empty(0, np.int64) for _ in range(3))]  # lots of (query's place, vec_id, score)
        self.fresh = 0

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        for a in range(0, len(self.q_ids), TILE_QUERIES):
            q_ids = self.q_ids[a : a + TILE_QUERIES]
            score = products(self.q[a : a + TILE_QUERIES], c)
            exact = score.dtype != np.int64
            if exact:
                at = np.flatnonzero(score > self.least[a : a + TILE_QUERIES, None].astype(score.dtype))
            if exact and len(at) <= len(q_ids) * self.k:
                row, column = np.divmod(at, len(ids))
                other = q_ids[row] != ids[column]
                row, column = row[other], column[other]
            else:
                row, column = best(q_ids, ids, score.astype(np.int64), self.k)
            if len(row):
                self.found.append((row + a, ids[column], score[row, column].astype(np.int64)))
                self.fresh += len(row)
        if self.fresh >= len(self.q_ids) * self.k:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        """(query's place, vec_id, score) of the k best of each query."""
        row, ids, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, ~score, row))
        row = row[order]
        starts = np.searchsorted(row, np.arange(len(self.q_ids) + 1))
        keep = np.arange(len(row)) - starts[row] < self.k
        row, ids, score = row[keep], ids[order][keep], score[order][keep]
        full = np.flatnonzero(np.diff(starts) >= self.k)
        last = np.searchsorted(row, full, "right") - 1
        self.least[full] = score[last]
        self.found, self.fresh = [(row, ids, score)], 0
        return row, ids, score


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, bool], np.ndarray, list[bytes]]]:
    """((cell, width, whether they ask), ids, numbers) of neighbouring rows, `BLOCK` of them at most."""
    for batch in batches:
        cell, width, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        new = (np.diff(cell) != 0) | (np.diff(width) != 0) | (np.diff(asks.astype(np.int8)) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(ids)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            for a in range(start, end, BLOCK):
                part = slice(a, min(a + BLOCK, end))
                numbers = batch.column(4).slice(a, part.stop - a).to_pylist()
                yield (int(cell[a]), int(width[a]), bool(asks[a])), ids[part], numbers


def _search(k: int):
    def given(group: Best | None) -> Iterator[pa.RecordBatch]:
        if group is not None:
            row, ids, score = group.merge()
            for a in range(0, len(row), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.q_ids[row[part]]), pa.array(ids[part]), pa.array(score[part])], FOUND.fieldNames()
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asking, group = None, [], None
        for (cell, width, asks), ids, numbers in _runs(batches):
            if (cell, width) != place:
                yield from given(group)
                place, asking, group = (cell, width), [], None
            if asks:
                asking.append((ids, _unpacked(numbers, width)))
            elif asking or group:
                if asking:
                    q_ids, q = (np.concatenate(x) for x in zip(*asking, strict=True))
                    asking, group = [], Best(q_ids, q, k)
                group.add(ids, _unpacked(numbers, width))
        yield from given(group)

    return search


def _cells(packed: DataFrame, cell: Column, asks: bool) -> DataFrame:
    return packed.select(cell.alias("cell"), "width", F.lit(asks).alias("asks"), "vec_id", "numbers")


def top_k(spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Each query's k highest scores: query_id, rank, vec_id, score.

    Queries are the vectors whose vec_id is divisible by `every`; candidates
    are all vectors of the same length but those with the query's own id. Fewer
    candidates give fewer rows; ties go to the smaller vec_id. A row that
    repeats another's vec_id is one candidate more, so that a vec_id may hold
    several ranks, and asks no second query of its own: of the vectors of one
    vec_id the least in order asks. An empty table gives no rows. Columns other than vec_id and embedding are not read.
    """
    rows = whole_numbers(vectors)
    candidates = stored(rows.mapInArrow(_packed, PACKED), "candidates")
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = stored(asking.mapInArrow(_packed, PACKED), "queries")
    cells = queries.groupBy("width").agg(F.sum("width").alias("n")).agg(F.max("n")).first()[0] or 0
    groups = max(GROUPS, math.ceil(cells / GROUP_CELLS))
    stripes = max(STRIPES, math.ceil(candidates.count() / STRIPE_ROWS))
    # Dealt by place, so that many rows of one vec_id do not meet in one stripe.
    stripe = F.pmod(F.monotonically_increasing_id(), F.lit(stripes))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_stripe = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    dealt = candidates.withColumn("stripe", stripe).withColumn("group", every_group)
    asked = queries.withColumn("group", group).withColumn("stripe", every_stripe)
    cell = (F.col("stripe") * groups + F.col("group")).cast("int")
    tasks = _cells(asked, cell, True).unionByName(_cells(dealt, cell, False)).repartitionById(groups * stripes, "cell")
    found = tasks.sortWithinPartitions("cell", "width", F.desc("asks"), "vec_id").mapInArrow(_search(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
