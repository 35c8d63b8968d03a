"""Best-fit packing of tokenized documents by minimum bin slack.

Bins are filled one at a time: a subset-sum table over the lengths still
available, one bit per sum, finds the fullest feasible combination, which is
then taken out, as often as the counts of its lengths allow. Only the counts
per length enter the table, so planning costs the same for any number of
documents: at most `capacity` lengths, and at most as many patterns, since each
uses up one length at least. Rows meet their places by rank within their
length.
"""

from __future__ import annotations

import array
import json
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import salted_rank, stored

END = b"\0\0\0\0"  # id 0 ends each document

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
PLAN = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("length", "first", "stop", "per_bin", "bin", "place")]
)


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Texts to packed little-endian unsigned 32-bit ids.

    The ids are those of the `tokenizers` file. A plain byte-level BPE whose
    ids follow its merges is run by tiktoken, which is several times faster and
    gives the same ids; texts that hold an added token, and all other
    vocabularies, are encoded by `tokenizers` itself.
    """

    # Fixed value: the split pattern of byte-level vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.fast = self._plain(spec)

    def _plain(self, spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        byte_of = _byte_of()
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        if (
            model.get("type", "BPE") != "BPE"
            or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space")
            or not pre.get("use_regex", True)
            or spec.get("normalizer")
            or model.get("dropout")
            or any(a.get("lstrip") or a.get("rstrip") for a in spec.get("added_tokens", []))
            or any(c not in byte_of for t in vocab for c in t)
            or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges))
            or len(vocab) != 256 + len(merges)
        ):
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("byte_level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.fast.encode_to_numpy(text).tobytes()


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """One row per piece: the ids of a document, cut from its end on.

    Every piece but the first is `capacity` ids long. A NULL text counts as
    empty: a piece that holds the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + END
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((doc_id.as_py(), piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], PIECES.fieldNames()
            )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of available lengths: length to how many.

    Takes the longest length first, as every bin must hold it in the end, and
    fills the rest. Bit s of a table is set if the lengths so far can sum to
    s; counts enter as powers of two. The lengths are read back from the last
    table to the first. Longer lengths are tried first and the search ends
    when a bin is full.
    """
    longest = max(counts)
    rest = capacity - longest
    limit = (1 << (rest + 1)) - 1
    tables = [1]
    steps: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), rest // length)
        k = 1
        while left > 0:
            k = min(k, left)
            tables.append((tables[-1] | tables[-1] << (k * length)) & limit)
            steps.append((length, k))
            left -= k
            k *= 2
        if tables[-1] >> rest & 1:
            break
    total = tables[-1].bit_length() - 1
    taken = {longest: 1}
    for before, (length, k) in zip(tables[-2::-1], steps[::-1], strict=True):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + k
            total -= k * length
    return taken


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, stop, per_bin, bin, place).

    The pieces of a length with rank in [first, stop) go into the bins from
    `bin` on, `per_bin` into each, from offset `place` on.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used = dict.fromkeys(left, 0)
    out = []
    bins = 0
    while left:
        taken = fullest(left, capacity)
        times = min(left[length] // n for length, n in taken.items())
        place = 0
        for length, n in sorted(taken.items(), reverse=True):
            out.append((length, used[length], used[length] + n * times, n, bins, place))
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
            place += n * length
        bins += times
    return out


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Every document's pieces with the sequence and the place they go to.

    An empty table gives no rows; repeated rows are packed each for itself;
    columns other than doc_id and text are not read. Pieces of one length are
    interchangeable, so ties among them change only which of them goes where.
    """
    pieces = stored(cut_documents(docs, tokenizer, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    columns = list(zip(*plan_bins(counts, capacity), strict=True)) or [()] * 6
    # A table of Arrow needs no Python workers of its own on the executors, as a list of rows does.
    plan = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], PLAN.fieldNames()))
    ordered = pieces.withColumn("_order", F.struct("doc_id", "piece", "ids_crc32"))
    ranked = salted_rank(ordered, "length", "_order", "_rank", sum(counts.values())).drop("_order")
    # The plan has `capacity` patterns of at most 63 lengths, so it can be broadcast.
    p = F.broadcast(plan.withColumnRenamed("length", "_length"))
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("stop"))
    nth = F.col("_rank") - F.col("first")
    return ranked.join(p, fits).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("place") + (nth % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )
