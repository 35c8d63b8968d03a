import random
import re
from collections import Counter, defaultdict

import pytest

from docspark.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= 10]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, listed, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(listed, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1)]
    return sorted(out)


def run(spark, docs, **options):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, source string, word string, n int")
    return sorted(map(tuple, divergence.audit(spark, df.repartition(3), **options).collect()))


def sample(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "élan", "ÉLAN", "日本語", "delta", "x", "Y", "zeta", "eta", "theta", "iota", "kappa"]
    docs = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", None])
        text = rng.choice([" ", "-", "1", "\n"]).join(rng.choices(words, range(1, 15), k=rng.randrange(12)))
        docs.append((i, text, lang, source))
    return [*docs, *docs[:5], (None, None, "fr", "s9"), (1, "", "fr", "s8"), (2, "Q" * 50_000, "en", "long")]


def test_matches_brute_force(spark):
    docs = sample(1)
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("bits", [1, 3])
def test_words_that_share_a_digest(spark, bits, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 3)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 200)
    monkeypatch.setattr(divergence, "MERGE_ROWS", 5)
    docs = sample(2)
    assert run(spark, docs, bits=bits) == brute(docs)


def test_digests_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_DIGESTS", 0)
    docs = sample(3)
    assert run(spark, docs) == brute(docs)


def test_no_rows_and_no_terms(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "1 2 3", "en", "a"), (2, None, "en", "b")]) == [
        ("en", "a", "pair", "b", 0, 1),
        ("en", "b", "pair", "a", 0, 1),
    ]
