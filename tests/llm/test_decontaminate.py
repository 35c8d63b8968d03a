import hashlib
import random
import re

import pytest

from docspark.llm import decontaminate


def words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute(texts, items, window=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        n = min(window, len(w))
        for a in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(item_id))
    out = {}
    for i, text in enumerate(texts):
        w, hit, found = words(text), set(), set()
        for a in range(len(w)):
            for n in {len(k) for k in windows}:
                if a + n <= len(w) and (own := windows.get(tuple(w[a : a + n]))):
                    hit.update(range(a, a + n))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), sha, bool(hit))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Élan", "a1", *(f"w{i}" for i in range(12))]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(8)] + [(90, None), (91, "..."), (1, "the the")]
    items += [(92, "the " * 12)]
    texts = [text(60) for _ in range(10)]
    texts += [f"x {items[3][1]}. {items[5][1].upper()}", "the " * 40, None, "", "?!", items[0][1], items[0][1]]
    return texts, items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ANCHORS, 0])
def test_matches_brute_force(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ANCHORS", limit)
    texts, items = cases()
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, lang string")
    df = docs(*texts, lang=["en"] * len(texts))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(df, benchmark).collect()}
    assert got == brute(texts, items)
    kept = decontaminate.clean(df, benchmark)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r[-1]}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ANCHORS, 0])
def test_rows_without_an_id_or_sharing_one_are_judged_alone(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ANCHORS", limit)
    benchmark = spark.createDataFrame([(1, "a b c"), (2, "d e")], "item_id long, text string")
    rows = [(None, "x a b c"), (None, "clean"), (None, None), (None, "x a b c"), (7, "d e"), (7, "a b c d e"), (7, "e d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(df, benchmark).collect())
    assert got == [(0, 0, 0, 0), (0, 1, 0, 0), (0, 4, 3, 1), (0, 4, 3, 1), (7, 2, 0, 0), (7, 2, 2, 1), (7, 5, 5, 2)]
    kept = sorted(((r.doc_id or 0, r.text or "") for r in decontaminate.clean(df, benchmark).collect()))
    assert kept == [(0, ""), (0, "clean"), (7, "e d")]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(docs("a b"), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(2, 0, False)]
    assert decontaminate.contamination(docs("a").where("false"), none).count() == 0


def test_no_python_in_the_plan(spark, docs):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate.contamination(docs("a b c"), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_items_and_clashing_columns(spark, docs):
    """An item of a book's length costs its words, and columns of any name pass."""
    import random
    import time

    rng = random.Random(7)
    words = [f"w{rng.randrange(9000)}" for _ in range(50_000)]
    bench = spark.createDataFrame([("book", " ".join(words)), ("short", "a b c")], "item_id string, text string")
    df = docs("x " + " ".join(words[12_000:12_030]) + " y", "nothing here", "a b c", _hit=[1, 2, 3], _hash=[4, 5, 6])
    start = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {0: (32, 30, 1), 1: (2, 0, 0), 2: (3, 3, 1)}
    assert [tuple(r) for r in decontaminate.clean(df, bench).collect()] == [(1, "nothing here", 2, 5)]
    assert time.time() - start < 60
