"""Prefix trie over rebuilt conversations, by composable fingerprints.

A conversation c is rebuilt from the head of another one (c - c % 5) and its
own turns behind its own head. The fingerprint of a sequence of turns is a pair
(length n, hash x), and pairs multiply: (n, x) * (m, y) = (n + m, x + B^n * y),
modulo primes below 2^31. So the fingerprint of every prefix of a rebuilt
conversation follows from three stored prefix products (of the other
conversation's head, of its own head, of its own turns so far) without putting
a rebuilt text together; a rebuilt turn is a reference to a stored one.

Prefixes with one depth and fingerprint make a node. Each node is verified:
its members must have one parent node, and the turns they refer to must be
equal, text by text. Should two sequences share a fingerprint, all is done
again to another base.

Sums over subtrees do not go level by level. The node of which conversation c
is the smallest member, and all deeper ones of which it is, form a chain; the
chains hang on each other as a tree far shallower than the trie, whose sums
take pointer doubling, and a running sum along each chain gives its nodes'.

Defined results: rows with a NULL conv_id take no part; turns of one
conversation with one `turn` follow by role, then text, and repeated rows are
turns of their own; NULL turns come first; NULL role or text is empty; no rows
give no nodes, not even a root; other columns are ignored. A conversation that
owns most rows lies in many ranges, each a product of its own, multiplied in
order. Rows of many conversations that share a prefix are folded before they
are shuffled.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import stored

#: Head lengths are below HEADS; conversations take the head of the one at the start of their FAMILY.
FAMILY, HEADS = 5, 9
# The three largest primes below 2**31.
PRIMES = (2147483647, 2147483629, 2147483587)
PARTS = range(len(PRIMES))
ATTEMPTS = 8
STRETCH_BITS = 12  # conversation ids, and depths, are handled in stretches of 4096
PREFIX_CHARS = 64  # of role and text, by which turns with one number are dealt to ranges

NODE = ["depth", "a", "b"]
REF = ["conv_id", "range", "place"]


class Products:
    """Powers of one base per prime, for arrays and for columns."""

    def __init__(self, bases: list[int]):
        self.bases = bases
        self.tables = [
            np.array([[pow(b, d << s, p) for d in range(256)] for s in (0, 8, 16, 24)], np.int64)
            for b, p in zip(bases, PRIMES, strict=True)
        ]

    def power(self, part: int, exponents: np.ndarray) -> np.ndarray:
        """base^exponent for exponents below 2^32."""
        out = np.ones(len(exponents), np.int64)
        for table, shift in zip(self.tables[part], (0, 8, 16, 24), strict=True):
            out = out * table[(exponents >> shift) & 255] % PRIMES[part]
        return out

    def power_column(self, part: int, exponent: Column) -> Column:
        out = F.lit(1).cast("long")
        for table, shift in zip(self.tables[part], (0, 8, 16, 24), strict=True):
            values = F.expr(f"array({', '.join(f'{v}L' for v in table)})")
            digit = F.shiftright(exponent, shift).bitwiseAND(F.lit(255)).cast("int")
            out = out * F.get(values, digit) % PRIMES[part]
        return out

    def shrink_column(self, part: int, steps: Column) -> Column:
        """base^-steps for 0 <= steps < HEADS."""
        inverse = pow(self.bases[part], -1, PRIMES[part])
        values = F.expr(f"array({', '.join(f'{pow(inverse, i, PRIMES[part])}L' for i in range(HEADS))})")
        return F.get(values, steps.cast("int"))


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns in the order of their conversation, dealt to ranges of about equal size."""
    empty = F.lit("")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.col("turn").asc_nulls_first()
    return (
        turns.repartitionByRange(
            parts, "conv_id", turn, F.left("role", F.lit(PREFIX_CHARS)), F.left("text", F.lit(PREFIX_CHARS))
        )
        .withColumn("range", F.spark_partition_id())
        .sortWithinPartitions("conv_id", turn, "role", "text")
        .drop("turn")
    )


def _placed(turns: DataFrame, products: Products) -> DataFrame:
    """Number the turns of each conversation within its range, with products up to each.

    q0.. are the products up to and with the turn, e0.. those before it.
    """
    hashed = turns.select(
        "conv_id",
        "range",
        "role",
        "text",
        F.octet_length("text").cast("long").alias("size"),
        *[F.pmod(F.xxhash64(F.lit(products.bases[i]), "role", "text"), F.lit(PRIMES[i])).alias(f"t{i}") for i in PARTS],
    )
    sums = ", ".join(f"q{i} long, e{i} long" for i in PARTS)
    shape = f"conv_id long, range int, place long, role string, text string, size long, {sums}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, ahead = None, 0, [0] * len(PRIMES)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch["conv_id"].to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            group = np.zeros(len(conv), np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            goes_on = last is not None and conv[0] == last
            place = np.arange(len(conv)) - starts[group]
            place[group == 0] += count if goes_on else 0
            sums = {}
            for i in PARTS:
                terms = batch[f"t{i}"].to_numpy(zero_copy_only=False) * products.power(i, place) % PRIMES[i]
                total = np.cumsum(terms)
                total -= (total - terms)[starts][group]
                total[group == 0] += ahead[i] if goes_on else 0
                sums[f"q{i}"] = total % PRIMES[i]
                sums[f"e{i}"] = (total - terms) % PRIMES[i]
            last, count, ahead = conv[-1], int(place[-1]) + 1, [int(sums[f"q{i}"][-1]) for i in PARTS]
            kept = {c: batch[c] for c in ("conv_id", "range")} | {"place": pa.array(place)}
            kept |= {c: batch[c] for c in ("role", "text", "size")}
            yield pa.RecordBatch.from_pydict(kept | {k: pa.array(v) for k, v in sums.items()})

    return hashed.mapInArrow(run, shape)


def _prefixes(placed: DataFrame, products: Products) -> DataFrame:
    """Products of whole prefixes: those of the ranges before, times those within the range.

    Only (conversation, range) pairs meet in the window, at most one per range.
    """
    ranges = placed.groupBy("conv_id", "range").agg(
        F.count("*").alias("n"), *[F.max_by(f"q{i}", "place").alias(f"q{i}") for i in PARTS]
    )
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shifted = [(F.col(f"q{i}") * products.power_column(i, F.col("from")) % PRIMES[i]).alias(f"q{i}") for i in PARTS]
    ranges = ranges.select("conv_id", "range", "from", *shifted)
    ahead = [F.coalesce(F.sum(f"q{i}").over(before), F.lit(0)).alias(f"ahead{i}") for i in PARTS]
    joined = placed.drop("role", "text").join(
        ranges.select("conv_id", "range", "from", *ahead), ["conv_id", "range"]
    )
    scaled = lambda c, i: F.pmod(
        F.col(f"ahead{i}") + F.col(f"{c}{i}") * products.power_column(i, F.col("from")) % PRIMES[i], F.lit(PRIMES[i])
    )
    return joined.select(
        *REF,
        (F.col("from") + F.col("place") + 1).alias("pos"),
        "size",
        *[scaled(c, i).alias(f"{c}{i}") for c in "qe" for i in PARTS],
    )


def _conversations(prefixes: DataFrame) -> DataFrame:
    """Per conversation how it is rebuilt: where its head comes from, and the products to combine."""
    sums = [f"{c}{i}" for c in "qe" for i in PARTS]
    head = F.when(F.col("pos") < HEADS, F.struct("pos", "range", "place", "size", *sums))
    own = prefixes.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.array_sort(F.collect_list(head)).alias("own_head")
    )
    own = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % FAMILY
    )
    heads = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("own_head").alias("head"))
    both = own.join(heads, "base", "left").withColumn(
        "k", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int")
    )
    product = lambda head, at, i: F.coalesce(F.get(head, at.cast("int") - 1)[f"q{i}"], F.lit(0))
    return both.select(
        "conv_id",
        "base",
        "h",
        "k",
        (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        F.coalesce(F.slice("head", F.lit(1), F.col("k")), F.expr("slice(own_head, 1, 0)")).alias("head"),
        *[product(F.col("head"), F.col("k"), i).alias(f"head{i}") for i in PARTS],
        *[product(F.col("own_head"), F.least("h", "n"), i).alias(f"skip{i}") for i in PARTS],
    )


def _key(name: str, values: list[Column]) -> list[Column]:
    """Three residues as two whole numbers."""
    a, b = ("a", "b") if name == "x" else ("up_a", "up_b")
    return [(values[0] * (1 << 31) + values[1]).alias(a), values[2].alias(b)]


def _cells(prefixes: DataFrame, convs: DataFrame, products: Products) -> DataFrame:
    """One row per rebuilt conversation and depth: its node's key, its parent's, and the turn referred to."""
    turn = F.col("turn")
    heads = convs.select("conv_id", "base", "length", F.explode("head").alias("turn")).select(
        "conv_id",
        turn["pos"].cast("long").alias("depth"),
        *_key("x", [turn[f"q{i}"] for i in PARTS]),
        *_key("e", [turn[f"e{i}"] for i in PARTS]),
        turn["size"].alias("size"),
        F.struct(F.col("base").alias("conv_id"), turn["range"].alias("range"), turn["place"].alias("place")).alias("ref"),
        (turn["pos"] == F.col("length")).alias("ends"),
    )
    none = F.lit(0).cast("long")
    roots = convs.select(
        "conv_id",
        none.alias("depth"),
        *_key("x", [none, none, none]),
        F.lit(None).cast("long").alias("up_a"),
        F.lit(None).cast("long").alias("up_b"),
        none.alias("size"),
        F.lit(None).cast("struct<conv_id:long,range:int,place:long>").alias("ref"),
        (F.col("length") == 0).alias("ends"),
    )
    names = ["conv_id", "h", "k", "length", *[f"{c}{i}" for c in ("head", "skip") for i in PARTS]]
    own = prefixes.join(convs.select(*names), "conv_id").where("pos > h")

    def combined(c: str, i: int) -> Column:
        tail = F.pmod(F.col(f"{c}{i}") - F.col(f"skip{i}"), F.lit(PRIMES[i]))
        moved = tail * products.shrink_column(i, F.col("h") - F.col("k")) % PRIMES[i]
        return (F.col(f"head{i}") + moved) % PRIMES[i]

    depth = F.col("pos") - F.col("h") + F.col("k")
    own = own.select(
        "conv_id",
        depth.alias("depth"),
        *_key("x", [combined("q", i) for i in PARTS]),
        *_key("e", [combined("e", i) for i in PARTS]),
        "size",
        F.struct(*REF).alias("ref"),
        (depth == F.col("length")).alias("ends"),
    )
    return roots.unionByName(heads).unionByName(own)


def _nodes(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("size").alias("size"),
        *[f(c).alias(f"{n}{c}") for c in ("up_a", "up_b") for n, f in (("", F.min), ("most_", F.max))],
        F.min_by("ref", "conv_id").alias("lead"),
    )


def _collides(nodes: DataFrame, cells: DataFrame, placed: DataFrame) -> bool:
    """Does any node hold different sequences?

    Members must agree on the parent node, and their last turns with the one
    of the smallest member; references that are the same need no look.
    """
    if not nodes.where("up_a <> most_up_a OR up_b <> most_up_b").isEmpty():
        return True
    pairs = (
        cells.where("depth > 0")
        .select(*NODE, "ref")
        .distinct()
        .join(nodes.select(*NODE, "lead"), NODE)
        .where("ref <> lead")
        .select("ref", "lead")
        .distinct()
    )
    turns = placed.select(F.struct(*REF).alias("at"), "role", "text")
    left = turns.select(F.col("at").alias("ref"), "role", "text")
    right = turns.select(F.col("at").alias("lead"), F.col("role").alias("lead_role"), F.col("text").alias("lead_text"))
    met = pairs.join(left, "ref").join(right, "lead")
    return not met.where("role <> lead_role OR text <> lead_text").isEmpty()


def _tree(nodes: DataFrame) -> DataFrame:
    """Nodes with the smallest member of their parent and the number of their children."""
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("a").alias("up_a"),
        F.col("b").alias("up_b"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return (
        nodes.join(children, NODE, "left")
        .join(parents, ["depth", "up_a", "up_b"], "left")
        .select(
            *NODE,
            "conv_id",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
        )
    )


def _hanging(tree: DataFrame) -> DataFrame:
    """(conv_id, depth, hung_leaves, hung_saved): what hangs on a chain at one of its nodes.

    The chains' sums over all that hangs below them: each round doubles how
    far down they have been added up, and how far up each points.
    """
    chains = stored(
        tree.groupBy("conv_id").agg(
            F.min("depth").alias("top"),
            F.min_by("parent_conv_id", "depth").alias("up"),
            F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"),
        ),
        "chains",
    )
    state = chains.select("conv_id", "up", "leaves", "saved")
    while not state.where("up IS NOT NULL").isEmpty():
        below = (
            state.where("up IS NOT NULL")
            .groupBy(F.col("up").alias("conv_id"))
            .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        )
        above = state.select(F.col("conv_id").alias("up"), F.col("up").alias("above"))
        state = stored(
            state.join(below, "conv_id", "left")
            .join(above, "up", "left")
            .select(
                "conv_id",
                F.col("above").alias("up"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            "chain-sums",
        )
    sums = state.select("conv_id", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    return (
        chains.where("up IS NOT NULL")
        .join(sums, "conv_id")
        .groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth"))
        .agg(F.sum("all_leaves").alias("hung_leaves"), F.sum("all_saved").alias("hung_saved"))
    )


def _subtrees(tree: DataFrame) -> DataFrame:
    """Sums over each node's subtree: its chain from here on, with all that hangs there.

    Along a chain the sums run in stretches of depths, which are added up by themselves.
    """
    full = tree.join(_hanging(tree), ["conv_id", "depth"], "left").select(
        *tree.columns,
        F.shiftright("depth", STRETCH_BITS).alias("stretch"),
        (F.col("leaves") + F.coalesce("hung_leaves", F.lit(0))).alias("own_leaves"),
        (F.col("saved") + F.coalesce("hung_saved", F.lit(0))).alias("own_saved"),
    )
    full = stored(full, "hung")
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    rest = (
        full.groupBy("conv_id", "stretch")
        .agg(F.sum("own_leaves").alias("l"), F.sum("own_saved").alias("s"))
        .select(
            "conv_id",
            "stretch",
            F.coalesce(F.sum("l").over(deeper), F.lit(0)).alias("rest_leaves"),
            F.coalesce(F.sum("s").over(deeper), F.lit(0)).alias("rest_saved"),
        )
    )
    on = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth"))
    return full.join(rest, ["conv_id", "stretch"]).select(
        *NODE,
        "conv_id",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.sum("own_leaves").over(on) + F.col("rest_leaves")).alias("n_leaves"),
        (F.sum("own_saved").over(on) + F.col("rest_saved")).alias("saved_tokens"),
    )


def _end_digests(cells: DataFrame) -> DataFrame:
    """SHA-256 of the listed conversations that end at a node.

    Ids are joined in stretches of 4096 first; a task then feeds the stretches
    of a node to its digest one after another, so no list is ever whole.
    """
    lists = (
        cells.where("ends")
        .groupBy(*NODE, F.shiftright("conv_id", STRETCH_BITS).alias("stretch"))
        .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
        .select(*NODE, "stretch", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch[c].to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(ids.encode())
            yield _ended(done)
        if key is not None:
            yield _ended([(*key, digest.hexdigest())])

    dealt = lists.repartition(*NODE).sortWithinPartitions(*NODE, "stretch")
    return dealt.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "a": pa.int64(), "b": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds)
    )


def _bases(attempt: int) -> list[int]:
    draw = random.Random(attempt)
    return [draw.randrange(1 << 20, p - 1) for p in PRIMES]


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (UTF-8 bytes) and ends_sha256; see the head of this file.
    """
    for attempt in range(ATTEMPTS):
        products = Products(_bases(attempt))
        placed = stored(_placed(_turns(conversations), products), "placed")
        prefixes = stored(_prefixes(placed, products), "prefixes")
        convs = stored(_conversations(prefixes), "rebuilt")
        cells = stored(_cells(prefixes, convs, products), "cells")
        nodes = stored(_nodes(cells), "nodes")
        if not _collides(nodes, cells, placed):
            break
    else:
        raise RuntimeError(f"fingerprints collide at each of {ATTEMPTS} bases")
    sums = _subtrees(stored(_tree(nodes), "trie"))
    ended = sums.join(_end_digests(cells), NODE, "left")
    return ended.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
