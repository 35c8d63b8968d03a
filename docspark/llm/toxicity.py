"""Toxicity by a linear classifier on character n-grams.

The presence of an n-gram in a document, hashed, is a feature; it is scaled by
the naive Bayes log-count ratio of its hash, log(p / q), where p and q are the
smoothed shares of toxic and of other documents that hold it. A logistic
regression on the scaled features gives the score. It is fitted on a bounded
sample of the labelled rows, in one task; all documents are scored where they
lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import fold
from docspark.llm.textgrid import code_points, slices

ORDERS = (3, 4, 5, 6)
BITS = 18
FOLDS = 5
#: Bound of the training sample: about so many labelled documents a class.
TRAIN_DOCS = 2000
#: Hashes kept: those whose ratio is furthest from chance.
FEATURES = 20_000
SMOOTHING = 1.0
PENALTY = 1e-4
ROUNDS = 300
HASH_STEPS = 1 << 30

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
    ]
)
WEIGHTS = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("weight", T.DoubleType())])


def present(texts: list[str], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hashed n-gram) pairs; of the kept hashes, if given.

    Letters are lower-cased, runs of white space count as one space, and each
    text has a space on either side.
    """
    joined = [" " + " ".join(t.lower().split()) + " " for t in texts]
    ends = np.cumsum([len(t) for t in joined])
    cp = code_points("".join(joined))
    of = np.repeat(np.arange(len(texts)), [len(t) for t in joined])
    found = []
    h = np.zeros(len(cp), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(cp) < n:
            break
        h = h[: len(cp) - n + 1] * np.uint32(0x01000193) + cp[n - 1 :] * np.uint32(0x9E3779B1)
        if n not in ORDERS:
            continue
        x = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B + 2 * n)
        bucket = (x >> np.uint32(32 - BITS)).astype(np.int64)
        inside = np.arange(len(bucket)) + n <= ends[of[: len(bucket)]]
        if kept is not None:
            inside &= kept[bucket]
        at = np.flatnonzero(inside)
        found.append(of[at] << BITS | bucket[at])
    pairs = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _sums(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=x, minlength=n)


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each hash, 0 for those not kept, and the intercept.

    `weight`: how many documents of its class a text stands for.
    """
    n_pos, n_neg = int(toxic.sum()), int((1 - toxic).sum())
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for at, part in slices(texts):
        of, feature = present(part)
        pos += _sums(feature, toxic[of + at], 1 << BITS)
        neg += _sums(feature, 1.0 - toxic[of + at], 1 << BITS)
    ratio = np.log((pos + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - np.log((neg + SMOOTHING) / (n_neg + 2 * SMOOTHING))
    # The ratio's spread is about the root of the summed inverse counts.
    strength = np.abs(ratio) / np.sqrt(1 / (pos + SMOOTHING) + 1 / (neg + SMOOTHING))
    kept = np.zeros(1 << BITS, bool)
    kept[np.argsort(-strength, kind="stable")[:FEATURES]] = True
    parts = [(at, *present(part, kept)) for at, part in slices(texts)]
    of = np.concatenate([p[1] + p[0] for p in parts])
    feature = np.concatenate([p[2] for p in parts])
    x = ratio[feature]
    share = weight / weight.sum()
    w, bias = np.zeros(1 << BITS), 0.0
    # Nesterov's accelerated gradient; the step follows the largest row norm.
    rows = _sums(of, x * x, len(texts))
    step = 4.0 / (np.percentile(rows, 95) + 1)
    at_w, at_b, momentum = w, bias, 1.0
    for _ in range(ROUNDS):
        z = _sums(of, at_w[feature] * x, len(texts)) + at_b
        error = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - toxic)
        gradient = _sums(feature, error[of] * x, 1 << BITS) + PENALTY * at_w
        next_w, next_b = at_w - step * gradient, at_b - step * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        at_w, at_b = next_w + pull * (next_w - w), next_b + pull * (next_b - bias)
        w, bias, momentum = next_w, next_b, following
    return w * ratio, bias


def learn(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """Weights and intercept from about `per_class` documents of each label.

    The sample is chosen by a hash of doc_id among the labelled rows whose
    crc32 fold is not 0; rows without a label or a text are left out. Without
    rows of both classes the weights are 0 and the intercept tells the class.
    """
    rows = labels.where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    nothing = np.zeros(1 << BITS)
    if not pos or not neg:
        return nothing, float(np.log((pos + 0.5) / (neg + 0.5)))
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / pos)).otherwise(min(1.0, per_class / neg))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASH_STEPS)) < share * HASH_STEPS)
    sample = (
        docs.where("text IS NOT NULL")
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # twice `per_class` rows, about
        .selectExpr("text", "CAST(toxic = 1 AS DOUBLE) AS toxic")
    )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        label = np.array(toxic)
        if len(texts) and 0 < label.sum() < len(label):
            stands_for = np.where(label == 1, pos / label.sum(), neg / (1 - label).sum())
            w, bias = fit(texts, label, stands_for)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *at], pa.int32()), pa.array([bias, *w[at]], pa.float64())], WEIGHTS.fieldNames()
            )

    got = sample.repartition(1).mapInArrow(fitted, WEIGHTS).toArrow()
    if not got.num_rows:
        return nothing, float(np.log(pos / neg))
    feature, weight = got["feature"].to_numpy(), got["weight"].to_numpy()
    out = nothing.copy()
    out[feature[1:]] = weight[1:]
    return out, float(weight[0])


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its probability of being toxic.

    A NULL or empty text gets the intercept's score. Repeated rows are scored
    each for itself, extra columns are not read, an empty table gives no rows.
    """
    model = spark.sparkContext.broadcast(learn(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model.value
        kept = w != 0
        for batch in batches:
            z = [np.zeros(0)]
            for _, part in slices([t.as_py() or "" for t in batch.column(2)]):
                of, feature = present(part, kept)
                z.append(_sums(of, w[feature], len(part)) + bias)
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                RESULT.fieldNames(),
            )

    held_out = (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, "text").mapInArrow(score, RESULT)
