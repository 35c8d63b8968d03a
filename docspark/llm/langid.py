"""Language identification by a mixture of languages per document.

Each language has a distribution over hashed letter trigrams, counted on
labelled texts. A word's likelihood in a language is the product over its
trigrams. Expectation-maximisation finds the proportions of languages from
which a document's words are most likely drawn; languages then enter one after
the other, the largest proportion first, while the gain in log-likelihood
exceeds the penalty for one more proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import fold
from docspark.llm.textgrid import code_points, letter_table, slices

UNDETERMINED = "und"
BITS = 16
SMOOTHING = 0.5
ROUNDS = 15
FOLDS = 5
#: Bound of the training sample: about so many labelled documents a language.
TRAIN_DOCS = 2000
HASH_STEPS = 1 << 30

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("lang_set", T.ArrayType(T.StringType())),
    ]
)
COUNTS = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())]
)


def trigrams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, where each word begins, and its text.

    A word is a run of letters; each letter gives the trigram around it, with
    the word's end as a mark of its own.
    """
    lowered = [t.lower() for t in texts]
    cp = code_points("\n" + "".join(t + "\n" for t in lowered))
    is_letter = letters[cp]
    sym = np.where(is_letter, cp, np.uint32(0))
    at = np.flatnonzero(is_letter)
    h = sym[at - 1] * np.uint32(0x9E3779B1) + sym[at] * np.uint32(0x85EBCA77) + sym[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    grams = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    begins = np.flatnonzero(~is_letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return grams, begins, np.searchsorted(ends, at[begins] - 1, side="right")


def learn(labelled: DataFrame, per_lang: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihoods (trigram, language).

    Reads about `per_lang` documents of each language, chosen by a hash of
    doc_id. The counts are summed on the executors; one number per hashed
    trigram and language reaches the driver.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(totals)
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / totals[k])))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASH_STEPS)) < share[F.col("lang")] * HASH_STEPS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_lang.setdefault(lang, []).append(text.as_py())
            for lang, texts in by_lang.items():
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for _, part in slices(texts):
                    own += np.bincount(trigrams(part, letters)[0], minlength=1 << BITS)
        for lang, own in sums.items():
            gram = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int32()), pa.array(own[gram])],
                COUNTS.fieldNames(),
            )

    counted = chosen.select("lang", "text").mapInArrow(count, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = np.zeros((1 << BITS, len(langs)))
    got = counted.toArrow()
    column = np.array([langs.index(x) for x in got["lang"].to_pylist()], np.int64)
    sums[got["gram"].to_numpy(), column] = got["n"].to_numpy()
    logs = np.log(sums + SMOOTHING) - np.log(sums.sum(0) + SMOOTHING * len(sums))
    return langs, logs.astype(np.float32)


@dataclass(frozen=True)
class Mixtures:
    """What a slice of texts is made of; texts without letters have no top."""

    top: np.ndarray
    score: np.ndarray
    chosen: np.ndarray


def _em(like: np.ndarray, first: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document from its words.

    `like`: word by language; `first`: each document's first word; `n`: its
    number of words; `start`: proportions to begin with, 0 stays 0.
    """
    pi = start / start.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = np.repeat(pi, n, axis=0)
        part *= like
        total = part.sum(1, keepdims=True)
        part /= total
        pi = np.add.reduceat(part, first, axis=0) / n[:, None]
    return pi, np.add.reduceat(np.log(total[:, 0]), first)


def mixtures(texts: list[str], logs: np.ndarray, letters: np.ndarray) -> Mixtures:
    k = logs.shape[1]
    out = Mixtures(np.full(len(texts), -1), np.zeros(len(texts)), np.zeros((len(texts), k), bool))
    grams, begins, of = trigrams(texts, letters)
    if not len(begins) or not k:
        return out
    words = np.add.reduceat(logs[grams], begins, axis=0, dtype=np.float32)
    docs, first, n = np.unique(of, return_index=True, return_counts=True)
    single = np.add.reduceat(words, first, axis=0, dtype=np.float64)
    like = np.maximum(np.exp(words - words.max(1, keepdims=True)), 1e-30)
    pi, _ = _em(like, first, n, np.ones((len(docs), k)))
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1)
    best = single.argmax(1)
    odds = np.exp(single - single.max(1, keepdims=True))
    score = 1 / odds.sum(1)
    chosen = np.zeros((len(docs), k), bool)
    chosen[np.arange(len(docs)), best] = True
    top = best.copy()
    least = np.add.reduceat(words.max(1), first, dtype=np.float64)  # what `like` leaves out
    value = single[np.arange(len(docs)), best]
    open_ = (np.sort(pi, axis=1)[:, -2] * n >= 1) if k > 1 else np.zeros(len(docs), bool)
    for size in range(2, k + 1):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        pick = np.repeat(open_, n)
        starts = np.cumsum(n[at]) - n[at]
        share, ll = _em(like[pick], starts, n[at], (rank[at] < size) * (pi[at] + 1e-6))
        penalised = ll + least[at] - np.log(n[at] + 1) * (size - 1)
        better = penalised > value[at]
        open_[at[~better]] = False
        at, share = at[better], share[better]
        value[at] = penalised[better]
        chosen[at] = rank[at] < size
        top[at] = share.argmax(1)
        score[at] = share.max(1)
    out.top[docs], out.score[docs], out.chosen[docs] = top, score, chosen
    return out


def identify(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Language, its share of the words and the set of languages, per document.

    Learns from `labelled`; by default from the documents whose crc32 fold is
    not 0. A NULL text and one without a letter are `und` with score 0 and an
    empty set, as is every text where nothing could be learnt. With one
    language, score is its probability against the other languages alone.
    Repeated rows are judged each for itself, ties go to the language that
    sorts first, an empty table gives no rows. Of the documents to judge only
    doc_id and text are read.
    """
    if labelled is None:
        labelled = docs.where(fold(F.col("doc_id"), FOLDS) != 0)
    langs, logs = learn(labelled)
    model = spark.sparkContext.broadcast(logs)  # 2^16 trigrams by language

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            top, score, sets = [], [], []
            for _, part in slices([t.as_py() or "" for t in batch.column(2)]):
                m = mixtures(part, model.value, letters)
                top += [UNDETERMINED if i < 0 else langs[i] for i in m.top]
                score.append(m.score)
                sets += [[langs[i] for i in np.flatnonzero(row)] for row in m.chosen]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(top, pa.string()),
                    pa.array(np.concatenate([*score, np.zeros(0)])),
                    pa.array(sets, pa.list_(pa.string())),
                ],
                RESULT.fieldNames(),
            )

    held_out = (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, "text").mapInArrow(judge, RESULT)


def keep_known(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents whose language can be told, columns unchanged.

    Goes: a NULL text, one without a letter, and every text if nothing could
    be learnt. A weak vote is no ground to drop a document.
    """
    if labelled is None:
        labelled = docs.where(fold(F.col("doc_id"), FOLDS) != 0)
    _, logs = learn(labelled)
    model = spark.sparkContext.broadcast(logs)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            known = [np.zeros(0, bool)]
            for _, part in slices([t.as_py() or "" for t in batch.column(at)]):
                known.append(mixtures(part, model.value, letters).top >= 0)
            yield batch.filter(pa.array(np.concatenate(known)))

    return docs.mapInArrow(keep, docs.schema)
