"""Benchmark decontamination as a prefix-filtered join on words.

A window is a run of `window` consecutive words of a benchmark item, or the
whole item if it is shorter. A window lies in a document only if all its words
do, so joining its rarest word, by how often the corpus uses it, is enough:
the prefix that containment needs is one token long. Windows that share their
rarest word at one place of the item share one anchor. A document word that
equals an anchor is kept if the words around it agree with the item far enough:
the agreeing stretch around the anchor must be as long as a window. Every word
of such a stretch lies in an occurrence, and every occurrence lies in the
stretch around its anchor.

Column functions only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import ascii_lower, free_name, stored

WINDOW = 10
BLOCK = 4096  # places of an item
#: Anchors up to this many are broadcast (some hundred bytes each), beyond it shuffled.
BROADCAST_ANCHORS = 100_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """Lower-cased words of a text; NULL and texts without words have none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def _item_words(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, word array) of items that have words."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item"))
    return rows.where(F.size("item") > 0).distinct()


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): how often all documents use each word of the vocabulary."""
    found = docs.select(F.explode_outer(words(F.col("text"))).alias("word")).join(vocabulary, "word", "left_semi")
    return found.groupBy("word").agg(F.count("*").alias("n"))


def anchors(benchmark: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(word, item_id, need, before, after): one row per anchor.

    `before` and `after` are the item's words on either side of the anchor,
    nearest first, `window` - 1 at most; `need` is the length of a window.
    """
    items = _item_words(benchmark).select(
        "item_id", F.xxhash64("item").alias("words"), F.size("item").alias("size"), "item"
    )
    # A place carries its neighbours at most, never its item.
    at = F.col("at")
    first = F.greatest(F.lit(0), at - (window - 1))
    places = items.select("item_id", "words", "size", "item", F.posexplode_outer("item").alias("at", "word")).select(
        "item_id",
        "words",
        "size",
        "at",
        "word",
        F.reverse(F.slice("item", first + 1, at - first)).alias("before"),
        F.slice("item", at + 2, F.lit(window - 1)).alias("after"),
    )
    places = stored(places, "places")
    counts = word_counts(docs, places.select("word").distinct())
    ranked = places.select("item_id", "words", "size", "at", "word").join(counts, "word", "left")
    # The rarest place of each window is its anchor. Windows of one block of an
    # item are looked at together; the first places of a block end those before.
    block = F.floor(at / BLOCK)
    blocks = F.explode(F.array_distinct(F.array(block, F.floor(F.greatest(at - (window - 1), F.lit(0)) / BLOCK))))
    dealt = ranked.select(
        "item_id", "words", "size", "at", blocks.alias("block"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at").alias("rarity")
    )
    ahead = Window.partitionBy("item_id", "words", "block").orderBy("at").rowsBetween(0, window - 1)
    need = F.least("size", F.lit(window))
    rarest = (
        dealt.withColumn("rarest", F.min("rarity").over(ahead)["at"])
        .where((block == F.col("block")) & (at + need <= F.col("size")))
        .select("item_id", "words", F.col("rarest").alias("at"))
        .distinct()
    )
    return places.join(rarest, ["item_id", "words", "at"], "left_semi").select(
        "word", "item_id", need.alias("need"), "before", "after"
    )


def _agreeing(theirs: Callable[[int], Column], item_side: Column, reach: int) -> Column:
    """How many neighbours in a row agree, counted from the anchor on."""
    out = F.lit(0)
    for j in reversed(range(reach)):
        out = F.when(theirs(j) == F.get(item_side, F.lit(j)), out + 1).otherwise(0)
    return out


def _of_row(hash_: Column) -> Column:
    """Does a hit (`_hit`, `_hash`) belong to the row? NULL ids are told apart by their texts."""
    return F.col("doc_id").eqNullSafe(F.col("_hit")) & (hash_ == F.col("_hash"))


def stretches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, item_id, first, last): document words that an item's windows hit."""
    found = stored(anchors(benchmark, docs, window), "anchors")
    reach = window - 1
    # The outer form: the inner one filters on the size and splits the text once more.
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("tokens")).select(
        "doc_id", "text_hash", "tokens", F.posexplode_outer("tokens").alias("pos", "word")
    )
    pos = F.col("pos")
    if found.count() <= BROADCAST_ANCHORS:
        # Generate and join run in one stage of compiled code, so that the
        # words of a document are not copied for each of its words.
        met = tokens.join(F.broadcast(found), "word")
        before = lambda j: F.get("tokens", pos - (j + 1))
        after = lambda j: F.get("tokens", pos + (j + 1))
    else:
        first = F.greatest(F.lit(0), pos - reach)
        near = tokens.select(
            "doc_id",
            "text_hash",
            "pos",
            "word",
            F.reverse(F.slice("tokens", first + 1, pos - first)).alias("near_before"),
            F.slice("tokens", pos + 2, F.lit(reach)).alias("near_after"),
        )
        met = near.where("word IS NOT NULL").join(found, "word")
        before = lambda j: F.get("near_before", F.lit(j))
        after = lambda j: F.get("near_after", F.lit(j))
    left = _agreeing(before, F.col("before"), reach)
    right = _agreeing(after, F.col("after"), reach)
    return met.where(left + right + 1 >= F.col("need")).select(
        "doc_id", "text_hash", "item_id", (pos - left).alias("first"), (pos + right).alias("last")
    )


def covered(spans: Column) -> Column:
    """How many positions an array of (first, last) covers, overlaps once."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], acc["upto"] + 1) + 1)).alias("n"),
            F.greatest(acc["upto"], x["last"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, hit words and items found in it.

    NULL and empty texts have no words; items without words are found
    nowhere; repeated items count once. Rows that share a doc_id, or have none,
    are judged each by its own text, told apart by a 64-bit hash. Empty tables
    give no rows, or no hits. Of either table only the id and the text are read.
    """
    hits = (
        stretches(docs, benchmark, window)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.collect_set(F.struct("first", "last")).alias("spans"),
            F.collect_set("item_id").alias("items"),
        )
        .select(
            F.col("doc_id").alias("_hit"),
            F.col("text_hash").alias("_hash"),
            covered(F.col("spans")).alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.array_join(F.array_sort("items"), ",").alias("items"),
        )
    )
    n_words = F.size(words(F.col("text"))).cast("long").alias("n_words")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words)
        .join(hits, _of_row(F.col("text_hash")), "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows that no benchmark window occurs in, columns unchanged."""
    hits = stretches(docs.select("doc_id", "text"), benchmark, window)
    id_, hash_ = free_name(docs, "_hit"), free_name(docs, "_hash")
    hit = hits.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left_anti")
