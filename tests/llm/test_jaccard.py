import random
import re

import numpy as np
import pytest

from docspark.llm import jaccard
from docspark.llm.components import components


def shingles(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus():
    rng = random.Random(11)
    vocabulary = [f"Wort{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([20, 60, 150]))
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 2, 9])):
            edited = list(words)
            for _ in range(rng.choice([0, 1, 2, 3])):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts.append(" ".join(edited).upper() if rng.random() < 0.2 else "\n".join(edited))
    texts += [f"{' '.join(rng.choices(vocabulary, k=8))} {passage}" for _ in range(15)]
    texts += [passage, passage, None, "", " \t", "one", "one", "One two", "a b c d", "a b c d e", "é b c d e", "x " * 3000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("tree,least", [(jaccard.TREE, jaccard.LEAST), (3, 2)])
def test_groups_match_brute_force(spark, docs, monkeypatch, tree, least):
    monkeypatch.setattr(jaccard, "TREE", tree)
    monkeypatch.setattr(jaccard, "LEAST", least)
    texts = corpus()
    df = docs(*texts, lang=["x"] * len(texts)).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark, df).collect()}
    assert got == brute(texts)
    kept = jaccard.keep_one(spark, df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_empty_table(spark, docs):
    assert jaccard.similar_groups(spark, docs("a").where("false")).count() == 0


def test_tree_leaves_out_no_similar_point():
    rng = np.random.default_rng(3)
    n_sets = [set(rng.integers(0, 400, rng.integers(20, 60)).tolist()) for _ in range(150)]
    n_sets += [set(list(s)[: len(s) - 2]) for s in n_sets[:40]]
    n = np.array([len(s) for s in n_sets])
    vec = np.stack([np.bincount([x % jaccard.GROUPS for x in s], minlength=jaccard.GROUPS) for s in n_sets])
    tree = jaccard.Tree(n, vec)
    for i, a in enumerate(n_sets):
        near = set(tree.near(n[i], vec[i]).tolist())
        for j, b in enumerate(n_sets):
            if 100 * len(a & b) >= 80 * len(a | b):
                assert j in near


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_one_row_of_each_group_is_kept_whatever_the_ids(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey")
    rows = [(5, a), (5, a), (None, b), (None, b), (None, a), (5, c), (8, c), (9, b), (4, ""), (4, ""), (None, None), (None, "x y z u v w")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int")
    kept = jaccard.keep_one(spark, docs.repartition(3))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert got == sorted([(5, a), (9, b), (5, c), (4, ""), (4, ""), (0, ""), (0, "x y z u v w")])


def test_rows_without_an_id_are_linked(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text), (4, text + " tail"), (None, "alone here with some words of its own"), (None, None), (9, "x")]
    rows += [(None, "p " + " ".join(f"q{i}" for i in range(50))), (None, " ".join(f"q{i}" for i in range(50)))] * 2
    got = jaccard.similar_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted(
        [(-1, 56, 4), (4, 57, 4), (-1, 4, -1), (-1, 0, -1), (9, 1, 9)] + [(-1, 47, -1), (-1, 46, -1)] * 2
    )


def test_columns_of_any_name_pass(spark):
    rows = [(1, "a b c d e f", 7, 8), (2, "a b c d e f", 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, component_id long")
    assert [tuple(r) for r in jaccard.keep_one(spark, df).collect()] == [rows[0]]


def test_other_splits_between_reads(spark, tmp_path, monkeypatch):
    """Slices keep their numbers although the session would cut the files anew."""
    from docspark.llm import common

    text = lambda i: " ".join(f"w{(i // 3) * 50 + j}" for j in range(40)) + f" end{i}"
    rows = [(i, text(i)) for i in range(120)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(24).write.parquet(path)
    real, reads = common.stored, []

    def unsettled(df, name):
        out = real(df, name)
        reads.append(name)
        spark.conf.set("spark.sql.files.minPartitionNum", str(3 + 7 * len(reads)))
        return out

    monkeypatch.setattr(common, "stored", unsettled)
    try:
        got = jaccard.similar_groups(spark, spark.read.parquet(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i // 3 * 3) for i in range(120)}
