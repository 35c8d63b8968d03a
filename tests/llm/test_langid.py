import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import langid
from docspark.llm.textgrid import letter_table

SYLLABLES = {"xx": ["ka", "lo", "mi", "té"], "yy": ["ber", "stru", "ght", "ünd"], "zz": ["что", "не", "по", "ра"]}


def prose(lang, rng, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(i, prose(lang, rng, rng.choice([5, 40, 80])), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(500, None, "xx", "s"), (501, "", None, "s"), (502, "12 .. 3", "yy", "s"), (503, "kalo", None, "s")]
    rows += [(504, prose("xx", rng) + " " + prose("yy", rng), None, "s"), (505, "ka " * 50_000, None, "s")]
    rows += [(506, "kalo", None, "s")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_held_out_accuracy_and_edges(spark, table):
    rows = langid.identify(spark, table).collect()
    truth = {r.doc_id: r.lang for r in table.collect()}
    assert len(rows) == table.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.doc_id < 500:
            assert r.lang_pred == truth[r.doc_id]
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (500, 501, 502, 503, 505)] == ["und", "und", "und", "xx", "xx"]
    assert sorted(by_id[504].lang_set) == ["xx", "yy"]
    assert 0.4 < by_id[504].score < 0.6


def test_predictions_do_not_read_the_labels(spark, table):
    labelled = table.where("doc_id < 100")
    first = langid.identify(spark, table, labelled).orderBy("doc_id").collect()
    other = langid.identify(spark, table.withColumn("lang", F.lit("zz")), labelled).orderBy("doc_id").collect()
    assert first == other


def test_likelihood_of_a_mixture_beats_brute_force_grid():
    rng = random.Random(2)
    like = np.array([[rng.random(), rng.random()] for _ in range(50)])
    share, total = langid._em(like, np.array([0]), np.array([50]), np.ones((1, 2)))
    grid = [np.log(like @ [p, 1 - p]).sum() for p in np.linspace(0, 1, 201)]
    assert total[0] > max(grid) - 0.05
    assert abs(share[0].sum() - 1) < 1e-9


def test_nothing_learnt(spark, table):
    none = table.where("false")
    assert {r.lang_pred for r in langid.identify(spark, table, none).collect()} == {"und"}
    assert langid.identify(spark, none).count() == 0
    assert langid.keep_known(spark, none).count() == 0


def test_keep_known_drops_only_what_has_no_language(spark, table):
    kept = langid.keep_known(spark, table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in table.collect()} - {r.doc_id for r in kept.collect()} == {500, 501, 502}


def test_words_are_runs_of_letters():
    grams, begins, of = langid.trigrams(["ab c1d", "", "É"], letter_table())
    assert len(grams) == 5 and begins.tolist() == [0, 2, 3, 4] and of.tolist() == [0, 0, 0, 2]
