"""Source divergence audit: how the sources of a language differ in their terms.

Terms are counted under 64-bit digests. What the big shuffle carries is of
fixed width, (language, source, digest, occurrences, documents); the strings
stay where they are. A second reading of the texts gives the smallest and the
largest string of each digest that was kept. Where the two differ, strings
share the digest: these few digests are counted once more, by the string
itself. Strings are joined back to the rows that are returned, nothing else.

Sums over all kept terms of a pair of sources are taken in tiles: the sources
of a language stand in blocks, the terms in slices, and a tile holds the
entries of two blocks in one slice as a small matrix. A tile gives one sum per
pair, so neither pairs of a term nor of rows are ever made; terms that neither
source has are added by their number. All arithmetic is on whole numbers.

Defined results: NULL text, lang or source is empty text; a text without terms
still makes its group; a language with one source has no pairs; without kept
terms all pairs have value 0 and no term is listed; repeated rows count as
often as they occur; equal values rank by item; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import stored

LEAST_DOCS = 10  # a language keeps terms that so many of its documents hold
TOP_TERMS = 10
SCALE_HEAD, SCALE_TAIL = 100_000, 10_000  # their product is the scale of a share
SLICE_BYTES = 8_000_000  # of text, tokenized at a time
MERGE_ROWS = 2_000_000  # counts that a task holds before it hands them on
BLOCK = 64  # sources
TILE_ROWS = 100_000
CHUNK_TERMS = 1024
BROADCAST_DIGESTS = 2_000_000  # 16 MB of digests; more are joined by a shuffle
DIGEST_BITS = 64

GROUP = ["lang", "source"]
TERM = ["digest", "word"]

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
IS_TERM = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWERED = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of whole texts, of about SLICE_BYTES."""
    ends = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield at, to
        at = to


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number and word number of each term, the distinct words)."""
    binary = texts.cast(pa.large_binary())
    _, offsets, data = binary.buffers()
    offsets = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    inside = IS_TERM[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = bounds[:-1][bounds[1:] > bounds[:-1]]
    first[filled] = inside[filled]  # a term never goes on in the next text
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = inside[bounds[1:][bounds[1:] > bounds[:-1]] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    letters = LOWERED[raw[inside]]
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    terms = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(letters.tobytes())]
    ).dictionary_encode()
    owner = np.searchsorted(bounds, starts, "right") - 1
    return owner, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary


def digests(words: pa.Array, bits: int) -> np.ndarray:
    """The leading bits of each word's digest, as signed whole numbers."""
    raw = b"".join(hashlib.blake2b(w.as_py(), digest_size=8).digest() for w in words)
    return (np.frombuffer(raw, ">u8").astype(np.uint64) >> np.uint64(64 - bits)).view(np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)


def _summed(group: np.ndarray, term: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values added up per (group, term)."""
    order = np.lexsort((term, group))
    group, term = group[order], term[order]
    changes = np.zeros(len(group), bool)
    if len(group):
        changes[0] = True
        changes[1:] = (group[1:] != group[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(changes)
    return group[at], term[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _slice_counts(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(group, word number, occurrences, documents) and the words of one slice."""
    owner, codes, words = tokenize(texts)
    held = np.sort(owner * max(1, len(words)) + codes)
    at = _runs(held)
    times = np.diff(np.append(at, len(held)))
    doc, code = np.divmod(held[at], max(1, len(words)))
    return *_summed(groups[doc], code, times, np.ones(len(at), np.int64)), words


class _Groups:
    """Numbers of the (language, source) groups that a task has met."""

    def __init__(self):
        self.numbers: dict[tuple[str, str], int] = {}

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        pairs = zip(*(batch[c].to_pylist() for c in GROUP), strict=True)
        return np.fromiter((self.numbers.setdefault(p, len(self.numbers)) for p in pairs), np.int64, batch.num_rows)

    def columns(self, numbers: np.ndarray) -> dict[str, pa.Array]:
        names = list(self.numbers)
        return {c: pa.array([n[i] for n in names], pa.string()).take(pa.array(numbers)) for i, c in enumerate(GROUP)}


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """Counts under digests, added up within each task as far as its memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, rows = _Groups(), [], 0

        def merged() -> tuple[np.ndarray, ...]:
            return _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

        def told(counts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            group, *rest = counts
            named = {c: pa.array(v, pa.int64()) for c, v in zip(("digest", "n", "docs"), rest, strict=True)}
            return pa.RecordBatch.from_pydict(groups.columns(group) | named)

        for batch in batches:
            numbers = groups.of(batch)
            for at, to in _slices(batch["text"]):
                group, code, n, df, words = _slice_counts(batch["text"].slice(at, to - at), numbers[at:to])
                held.append((group, digests(words, bits)[code] if len(words) else code, n, df))
                rows += len(group)
                if rows > 2 * MERGE_ROWS:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows > MERGE_ROWS:
                        yield told(held.pop())
                        rows = 0
        if held:
            yield told(merged())

    return docs.mapInArrow(run, "lang string, source string, digest long, n long, docs long")


def _words(docs: DataFrame, bits: int) -> DataFrame:
    """(digest, word) of each task's distinct words, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in _slices(batch["text"]):
                words = tokenize(batch["text"].slice(at, to - at))[2]
                yield pa.RecordBatch.from_pydict(
                    {"digest": pa.array(digests(words, bits)), "word": words.cast(pa.large_string()).cast(pa.string())}
                )

    return docs.select("text").mapInArrow(run, "digest long, word string")


def _spelled(docs: DataFrame, bits: int) -> DataFrame:
    """Counts with the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups()
        for batch in batches:
            numbers = groups.of(batch)
            for at, to in _slices(batch["text"]):
                group, code, n, df, words = _slice_counts(batch["text"].slice(at, to - at), numbers[at:to])
                texts = words.cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(
                    groups.columns(group)
                    | {"digest": pa.array(digests(words, bits)[code] if len(words) else code)}
                    | {"word": texts.take(pa.array(code)), "n": pa.array(n), "docs": pa.array(df)}
                )

    return docs.mapInArrow(run, "lang string, source string, digest long, word string, n long, docs long")


def _bounded(df: DataFrame) -> DataFrame:
    """The rows, marked for a broadcast if they are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_DIGESTS else df


def _held_by_enough(counts: DataFrame, *term: str) -> DataFrame:
    """Rows of the terms that enough documents of their language hold, with the language's count."""
    each = counts.repartition("lang", *term).groupBy(*GROUP, *term).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", *term)
    return (
        each.withColumn("lang_n", F.sum("n").over(own))
        .withColumn("lang_docs", F.sum("docs").over(own))
        .where(F.col("lang_docs") >= LEAST_DOCS)
        .drop("docs", "lang_docs")
    )


def _kept(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(entries of the kept terms, smallest and largest word of each digest).

    Entries: lang, source, digest, word, n, lang_n; `word` is NULL but for
    digests that several words share.
    """
    counts = stored(_held_by_enough(_counted(docs, bits), "digest"), "terms")
    wanted = stored(counts.select("digest").distinct(), "digests")
    words = stored(
        _words(docs, bits)
        .join(_bounded(wanted), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("word").alias("least"), F.max("word").alias("most")),
        "words",
    )
    unnamed = counts.withColumn("word", F.lit(None).cast("string"))
    shared = words.where("least <> most").select("digest")
    if shared.isEmpty():
        return unnamed, words
    shared = _bounded(shared)
    split = _held_by_enough(_spelled(docs, bits).join(shared, "digest", "left_semi"), "digest", "word")
    return stored(unnamed.join(shared, "digest", "left_anti").unionByName(split), "split"), words


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / total), in two steps that stay in 64 bits."""
    total = F.nullif(total, F.lit(0))
    first = (count + 2) * SCALE_HEAD
    whole = lambda a, b: F.call_function("div", a, b)
    return 1 + whole(first, total) * SCALE_TAIL + whole((first % total) * SCALE_TAIL, total)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Every (lang, source) with its number in the language, totals, and the share of an absent term."""
    own = entries.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    langs = entries.select("lang", *TERM, "lang_n").distinct().groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")
    )
    none = F.lit(0).cast("long")
    full = docs.select(*GROUP).distinct().join(own, GROUP, "left").join(langs, "lang", "left")
    full = full.select(*GROUP, *[F.coalesce(c, none).alias(c) for c in ("total", "terms", "lang_total")])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return full.withColumn("number", number.cast("long")).withColumn(
        "absent", F.coalesce(_share(none, F.col("total") + 2 * F.col("terms")), none)
    )


def _term_part(entries: DataFrame, groups: DataFrame, words: DataFrame) -> DataFrame:
    """The terms that a source has more of than its language, the TOP_TERMS by value.

    Ranked by value alone first, with all ties; only those rows get their strings.
    """
    joined = entries.join(groups.select(*GROUP, "total", "terms", "lang_total"), GROUP)
    p = _share(F.col("n"), F.col("total") + 2 * F.col("terms"))
    q = _share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("terms"))
    scored = joined.where("n > 0").select(*GROUP, *TERM, p.alias("p"), q.alias("q")).where("p > q")
    scored = scored.select(*GROUP, *TERM, _gap(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    top = scored.withColumn("_rank", F.rank().over(best)).where(F.col("_rank") <= TOP_TERMS).drop("_rank")
    named = top.join(words.select("digest", "least"), "digest").withColumn("item", F.coalesce("word", "least"))
    last = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return named.select(*GROUP, F.lit("term").alias("part"), "item", "value", last.alias("rank")).where(
        F.col("rank") <= TOP_TERMS
    )


def _tile_sums(tile: pa.Table, members: pa.Table) -> pa.Table:
    """Sums over the terms of one tile, for each pair of a source of one block and one of the other."""
    numbers = members["number"].to_numpy()
    order = np.argsort(numbers)
    numbers, absent = numbers[order], members["absent"].to_numpy()[order]
    a, b = members["low"][0].as_py(), members["high"][0].as_py()
    rows = np.flatnonzero(numbers // BLOCK == a)
    columns = np.flatnonzero(numbers // BLOCK == b)
    named = tile["word"].is_valid().to_numpy()
    code = np.zeros(tile.num_rows, np.int64)
    _, code[~named] = np.unique(tile["digest"].to_numpy()[~named], return_inverse=True)
    if named.any():
        spelled = np.array(tile["word"].to_pylist(), object)[named].astype(str)
        code[named] = code[~named].max(initial=-1) + 1 + np.unique(spelled, return_inverse=True)[1]
    by_term = np.argsort(code, kind="stable")
    code, place = code[by_term], np.searchsorted(numbers, tile["number"].to_numpy()[by_term])
    share = tile["p"].to_numpy()[by_term]
    terms = int(code[-1]) + 1
    sums = np.zeros((len(rows), len(columns)), np.int64)
    for start in range(0, terms, CHUNK_TERMS):
        lo, hi = np.searchsorted(code, [start, start + CHUNK_TERMS])
        matrix = np.tile(absent, (min(CHUNK_TERMS, terms - start), 1))
        matrix[code[lo:hi] - start, place[lo:hi]] = share[lo:hi]
        others = matrix[:, columns]
        for i, r in enumerate(rows):
            p = matrix[:, r : r + 1]
            sums[i] += ((p - others) ** 2 // (p + others)).sum(axis=0)
    first, second = np.repeat(numbers[rows], len(columns)), np.tile(numbers[columns], len(rows))
    wanted = first < second
    return pa.table(
        {
            "lang": pa.array([members["lang"][0].as_py()] * int(wanted.sum()), pa.string()),
            "one": first[wanted],
            "other": second[wanted],
            "value": sums.ravel()[wanted],
            "met": np.full(int(wanted.sum()), terms, np.int64),
        }
    )


def _pair_part(spark: SparkSession, entries: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of sources of a language, by the gap over all kept terms."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(parts, entries.count() // TILE_ROWS)
    blocks = groups.groupBy("lang").agg(F.call_function("div", F.max("number"), F.lit(BLOCK)).alias("last_block"))
    placed = groups.join(blocks, "lang").withColumn("block", F.call_function("div", "number", F.lit(BLOCK)))
    with_block = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), "last_block")))
    placed = with_block.select(
        *GROUP,
        "number",
        "absent",
        (F.col("total") + 2 * F.col("terms")).alias("whole"),
        F.least("block", "_other").alias("low"),
        F.greatest("block", "_other").alias("high"),
    )
    tile = ["lang", "low", "high", "slice"]
    share = _share(F.col("n"), F.col("whole")).alias("p")
    own = F.pmod(F.xxhash64(*TERM), F.lit(slices)).alias("slice")
    dealt = entries.join(placed, GROUP).select("lang", "low", "high", own, "number", "digest", "word", share)
    numbered = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice")
    # Aliases, as both sides of the tiles come from one frame.
    members = placed.select(*[F.col(c).alias(c) for c in ("lang", "low", "high", "number", "absent")], numbered)

    def sums(cells: pa.Table, members: pa.Table) -> pa.Table:
        if not cells.num_rows or not members.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("lang", pa.string()), *((c, pa.int64()) for c in ("one", "other", "value", "met")))})
        return _tile_sums(cells, members)

    partial = dealt.groupBy(*tile).cogroup(members.groupBy(*tile)).applyInArrow(
        sums, "lang string, one long, other long, value long, met long"
    )
    partial = partial.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    side = lambda name: groups.select(
        "lang", F.col("number").alias(name), F.col("source").alias(f"{name}_source"), F.col("absent").alias(f"{name}_p"), "terms"
    )
    pairs = side("one").join(side("other").drop("terms"), "lang").where("one < other")
    none = F.lit(0).cast("long")
    unmet = F.col("terms") - F.coalesce("met", none)
    rest = F.when(unmet > 0, unmet * _gap(F.col("one_p"), F.col("other_p"))).otherwise(0)
    full = pairs.join(partial, ["lang", "one", "other"], "left").withColumn("value", F.coalesce("value", none) + rest)
    turned = F.explode(
        F.array(
            F.struct(F.col("one_source").alias("source"), F.col("other_source").alias("item")),
            F.struct(F.col("other_source").alias("source"), F.col("one_source").alias("item")),
        )
    )
    both = full.select("lang", turned.alias("_pair"), "value").select("lang", "_pair.source", "_pair.item", "value")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return both.select(*GROUP, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def audit(spark: SparkSession, documents: DataFrame, bits: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank; see the head of this file."""
    bits = DIGEST_BITS if bits is None else bits
    empty = F.lit("")
    docs = documents.select(*[F.coalesce(c, empty).alias(c) for c in ("lang", "source", "text")])
    entries, words = _kept(docs, bits)
    groups = stored(_groups(docs, entries), "groups")
    return _pair_part(spark, entries, groups).unionByName(_term_part(entries, groups, words))
