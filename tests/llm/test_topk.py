import math
import random

import numpy as np
import pytest

from docspark.llm import topk


def brute(rows, every, k):
    usable = {}
    listed = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            numbers = [math.floor(64 * float(np.float32(x))) for x in v]
            if (i, tuple(numbers)) not in usable:
                usable[i, tuple(numbers)] = True
                listed.append((i, numbers))
    out = set()
    for i, v in listed:
        if i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in listed if j != i and len(w) == len(v))
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("block", [topk.BLOCK, 7])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(6)
    rows = [(i, [round(rng.uniform(-2, 2), 1) for _ in range(4)]) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(120, 150)]  # ties
    rows += [(160, None), (180, [1.0, None, 1.0, 1.0]), (200, [float("nan"), 1.0, 1.0, 1.0]), (220, [math.inf] * 4)]
    rows += [(None, [1.0] * 4), (240, []), (260, [1.0, 2.0]), (261, [1.0, 2.0]), (280, [1e6] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark, df.repartition(3)).collect()}
    assert got == brute(rows, 20, 20)


@pytest.mark.parametrize("size", [1.0, 2.0**23])
@pytest.mark.parametrize("block", [topk.BLOCK, 7])
def test_copies_are_candidates_of_their_own(spark, monkeypatch, block, size):
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = [(7, [9.0 * size, 0.0])] * 20 + [(20, [size, 0.0])] * 30 + [(i, [i * size / 64, 0.0]) for i in range(21, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    one = 64 * int(size)
    for k in (20, 30):
        got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(spark, df, k=k).collect())
        want = [(7, 9 * one * one)] * 20 + [(i, i * int(size) * one) for i in range(39, 20, -1)]
        assert got == [(r, *x) for r, x in enumerate(want[:k], 1)]


@pytest.mark.parametrize("size", [1.0, 2.0**12, 2.0**20])
def test_many_cells_and_scores_that_rise_with_the_ids(spark, monkeypatch, size):
    for name, value in {"BLOCK": 16, "TILE_QUERIES": 3, "GROUP_CELLS": 8, "STRIPE_ROWS": 30}.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(7)
    rows = [(i, [i * size / 8, rng.choice([-size, 0.0, size])]) for i in range(200)]
    rows += [(i, [rng.uniform(-2, 2)] * 3) for i in range(200, 260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark, df, k=7).collect()}
    assert got == brute(rows, 20, 7)


def test_vectors_are_not_broadcast(spark):
    """A table of blocks is small on disk and not in memory, so that a broadcast of it fails."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(100)]
    plan = topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert "Broadcast" not in plan._jdf.queryExecution().toString()


def test_empty_and_single(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(spark, df).count() == 0
    assert topk.top_k(spark, df.where("false")).count() == 0


@pytest.mark.parametrize("size", [1.0, 2.0**14, 2.0**30])
def test_products_are_exact(size):
    rng = np.random.default_rng(1)
    q, c = (np.floor(rng.uniform(-size, size, (3, 5))) for _ in range(2))
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    if size == 2.0**30:
        assert topk.products(q, c).tolist() == exact
    assert topk.products(q, c).tolist() == exact
