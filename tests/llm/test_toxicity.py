import random
import zlib

import pytest

from docspark.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    syllables = ["an", "the", "ri", "on", "lé", "st"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    texts, toxic = [], []
    for i in range(300):
        words = [word() for _ in range(rng.choice([8, 50, 200]))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumpfzak", "VILEMUCK"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "the " * 50_000), (0, texts[0])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(
        [(i, None, t) for i, t in enumerate(toxic)] + [(900, None, None)], "doc_id long, quality int, toxic int"
    )
    return docs, labels, toxic


def test_held_out_documents_are_told_apart(spark, tables):
    docs, labels, toxic = tables
    rows = toxicity.score_documents(spark, docs, labels).collect()
    assert len(rows) == docs.count()
    assert any(r.held_out for r in rows)
    wrong = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id < 900:
            wrong += r.predicted != toxic[r.doc_id]
    assert wrong <= 3


def test_one_class_and_no_rows(spark, tables):
    docs, labels, _ = tables
    scores = {r.score for r in toxicity.score_documents(spark, docs, labels.where("toxic = 0")).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    assert toxicity.score_documents(spark, docs.where("false"), labels).count() == 0
    assert len({r.score for r in toxicity.score_documents(spark, docs, labels.where("false")).collect()}) == 1


def test_features_are_the_distinct_ngrams_within_a_text():
    of, feature = toxicity.present(["abcab", "", "abcab  "])
    grams = {f" abcab "[i : i + n] for n in toxicity.ORDERS for i in range(8 - n)}
    first = set(feature[of == 0])
    assert len(first) == len(grams) and first == set(feature[of == 2]) and set(of[of == 1]) == set() or len(feature[of == 1]) == 0
