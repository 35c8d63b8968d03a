"""The pipeline against its stages run one by one in plain Python."""

import sys
from collections import defaultdict

import pytest
from pyspark import cloudpickle

import corpus_pipeline
from docspark.llm import langid, packing, secrets
from docspark.llm.queries import tokenizer
from test_decontaminate import brute as contaminated
from test_jaccard import brute as groups
from test_langid import prose

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def sf_dir(spark, tmp_path):
    import random

    rng = random.Random(9)
    texts = [prose(lang, rng, 40) for lang in ["xx", "yy", "zz"] * 12]
    item = " ".join(texts[3].split()[5:20])
    texts += [texts[0], texts[1].upper() + " end", None, "", "123 ...", texts[4] + " password=hunter2hunter2", "x " * 9000]
    rows = [(i, t, ["xx", "yy", "zz"][i % 3] if i < 36 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, item


def test_run_matches_the_stages_in_plain_python(spark, sf_dir):
    folder, texts, item = sf_dir
    kept = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    ids = sorted(kept)
    grouped = groups([kept[i] for i in ids])
    kept = {i: kept[i] for n, i in enumerate(ids) if grouped[n][1] == n}
    ids = sorted(kept)
    hit = contaminated([kept[i] for i in ids], [(1, item)])
    kept = {i: kept[i] for n, i in enumerate(ids) if not hit[n][-1]}
    kept = {i: secrets.masked(t, secrets.scan(t)[1]) for i, t in kept.items()}
    assert not any("hunter2" in t for t in kept.values())

    rows = corpus_pipeline.run(spark, folder).collect()
    encode = packing.Encoder(tokenizer())
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.doc_id] += r.length
    assert dict(lengths) == {i: len(encode(t)) // 4 + 1 for i, t in kept.items()}


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    folder, *_ = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        none = stage(spark, docs.where("false"), folder)
        assert none.columns == docs.columns and none.count() == 0


def test_long_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    whole = langid.slices

    def small(texts):
        size = sum(map(len, texts))
        assert size < 5_000_000, f"a batch of {size} characters"
        return whole(texts)

    monkeypatch.setattr(langid, "slices", small)
    rows = [(i, "kalo " * 20_000, "xx", "s", 100_000) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    try:
        assert corpus_pipeline.known_language(spark, docs, str(tmp_path)).count() == 120
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)


def test_a_bound_of_the_session_stays_and_none_is_left_behind(spark, sf_dir):
    folder, *_ = sf_dir
    spark.conf.unset(corpus_pipeline.BATCH)
    rows = corpus_pipeline.run(spark, folder)
    assert spark.conf.get(corpus_pipeline.BATCH, None) is None
    n = rows.count()
    spark.conf.set(corpus_pipeline.BATCH, "1000")
    try:
        assert corpus_pipeline.run(spark, folder).count() == n
        assert spark.conf.get(corpus_pipeline.BATCH) == "1000"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)
