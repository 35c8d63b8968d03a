import hashlib
import random

import pytest

from docspark.llm import suffix_dedup as dedup

WIDTH = 100


def brute(docs):
    """Rows ordered by doc_id, NULL first, then text, as the tests need no other order of equal ids."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - WIDTH + 1):
            window = raw[s : s + WIDTH]
            if window in seen:
                gone[s : s + WIDTH] = b"\x01" * WIDTH
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((-1 if doc_id is None else doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, tie int, place string, span int")
    rows = dedup.remove_repeats(spark, df.repartition(3)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def words(rng, n, letters="abcdefghijklmno"):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(n))


def sample(seed):
    rng = random.Random(seed)
    line, passage = words(rng, 15), words(rng, 60)
    docs = [words(rng, rng.randrange(5, 300)) for _ in range(40)]
    docs += [words(rng, 20) + line + words(rng, 20) for _ in range(30)]
    docs += [words(rng, 20) + passage[: rng.randrange(len(passage))] + words(rng, 9) for _ in range(30)]
    docs += [docs[3], docs[3], docs[5].replace("a", "e", 1), docs[7] * 3, "é" * 260, "a" * 1000, "ab" * 400, "a" * 99, "", None]
    docs += ["a" * 100, "日本" * 90, "x" + docs[9]]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs = sample(seed)
    assert run(spark, docs) == brute(docs)


def test_small_arenas_and_lots(spark, monkeypatch):
    monkeypatch.setattr(dedup, "ARENA", 1 << 9)
    monkeypatch.setattr(dedup, "LOT", 2)
    monkeypatch.setattr(dedup, "PENDING_BYTES", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = sample(3)
        assert run(spark, docs) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_and_repeated_ids(spark):
    rng = random.Random(4)
    text = words(rng, 80)
    docs = [(None, text), (None, text), (3, text), (3, text), (3, "b" + words(rng, 50)), (9, "short"), (9, "short")]
    assert run(spark, docs) == brute(docs)


def test_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(dedup, "ARENA", 1 << 13)
    rng = random.Random(5)
    part = words(rng, 3_000)
    docs = [(0, part + words(rng, 9_000) + part)]
    assert run(spark, docs) == brute(docs)
    monkeypatch.undo()
    assert run(spark, [(1, "0" * 3_000_000)])[0][1:4] == (3_000_000, 3_000_000 - 1, 1)


def test_no_rows(spark):
    assert run(spark, []) == []
