import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import lm, running


def tokens(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)), None]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    kinds = [["ka", "lo", "mi"], ["ber", "stru", "ÜND"]]
    make = lambda k: "".join(rng.choices(kinds[k], k=rng.choice([1, 1, 1, 2, 3])))
    out = [" \n".join(make(i % 2) for _ in range(rng.choice([3, 60, 200]))) for i in range(150)]
    return [*out, None, "", " \t ", "x" * 5000, out[0], "Kalo\x00\x7fé"]


def test_base_matches_brute_force_and_the_model_beats_it(spark, docs, texts):
    lang = ["xx" if i % 2 else "yy" for i in range(len(texts))]
    rows = {r.doc_id: r for r in lm.score_documents(spark, docs(*texts, lang=lang).repartition(3)).collect()}
    c = Counter(t for i, x in enumerate(texts) if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    assert set(rows) == set(range(len(texts)))
    for i, text in enumerate(texts):
        r, own = rows[i], tokens(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(c[t] > 0 for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0
    known = [r for r in rows.values() if r.held_out and r.n_known == r.n_tokens > 3]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_a_growing_unseen_word_keeps_costing(spark, docs, texts):
    rng = random.Random(3)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=12_800))
    grown = [word[: 100 << i] for i in range(8)]
    at = [i for i in range(200) if held(i)][: len(grown)]
    own = dict(zip(at, grown, strict=True))
    df = docs(*(own.get(i, texts[i % 150]) for i in range(at[-1] + 1)))
    rows = {r.doc_id: r for r in lm.score_documents(spark, df).collect()}
    bits = [rows[i].bits_per_byte for i in at]
    scores = [rows[i].score for i in at]
    assert all(b < a * 1.5 for a, b in zip(scores, scores[1:], strict=False))
    assert min(bits) > max(bits) / 2


def test_few_texts_and_no_rows(spark, docs, texts):
    assert lm.score_documents(spark, docs(*texts[:9])).count() == 9
    assert lm.score_documents(spark, docs("a").where("false")).count() == 0
    assert lm.score_documents(spark, docs(None, "")).count() == 2


def test_spelling_is_a_distribution():
    coding = lm.code(np.bincount(np.frombuffer(b"abba cab " * 9, np.uint8), minlength=256))
    mixer = lm.Mixer(coding, np.zeros((2, len(lm.ORDERS) << lm.BITS), np.float32))
    mixer.learn(b"abba cab baba ")
    # the first byte of all words, stop included, in every way it can be
    total = 0.0
    for b in range(256):
        s = lm.Spelling(bytes([b]), coding)
        odds, gate = s.inputs(mixer.tables, 0)
        mixed = (mixer.weights[gate].T * odds).sum(0)
        p = lm._squash(mixed)
        total += np.prod(np.where(s.bit == 1, p, 1 - p))
    assert abs(total - 1) < 1e-4


def test_learning_lowers_the_bits():
    words = b" ".join(random.Random(1).choices([b"kalomi", b"lokami", b"mimilo"], k=3000)) + b" "
    coding = lm.code(np.bincount(np.frombuffer(words, np.uint8), minlength=256))
    tables = np.zeros((2, len(lm.ORDERS) << lm.BITS), np.float32)
    s = lm.Spelling(words, coding)
    for slot in s.slots:
        np.add.at(tables, (s.bit.astype(int), slot), 1)
    fresh = lm.Mixer(coding, tables)
    before = fresh.score(words).sum()
    for _ in range(5):
        fresh.learn(words)
    assert fresh.score(words).sum() > before


def test_packing_round_trips():
    for x in (np.array([], np.uint32), np.arange(300, dtype=np.int64), np.array([1.5], np.float32)):
        assert np.array_equal(lm._unpack(lm._pack(x), x.dtype.type), x)


def test_order_and_repeats_count(spark, docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    phrase = lambda i: " ".join(words[i : i + 10])
    texts = [" ".join(phrase(rng.randrange(290)) for _ in range(30)) for _ in range(120)]
    at = [i for i in range(120) if held(i)][:4]
    fresh = rng.sample(words, 200)
    backwards = " ".join(reversed(phrase(40).split()))
    texts[at[0]], texts[at[1]], texts[at[2]], texts[at[3]] = phrase(40), backwards, " ".join(fresh), " ".join(fresh * 2)
    rows = {r.doc_id: r for r in lm.score_documents(spark, docs(*texts)).collect()}
    assert rows[at[0]].base_score == pytest.approx(rows[at[1]].base_score)
    assert rows[at[0]].score > rows[at[1]].score + 3
    # the second half was read before in the same text
    assert rows[at[3]].score > 1.8 * rows[at[2]].score


def test_tasks_do_not_matter(spark, docs, texts):
    df = docs(*texts).repartition(3)
    got = []
    for n in ("2", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append({r.doc_id: r.score for r in lm.score_documents(spark, df).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == pytest.approx(got[1], rel=1e-9)


def some_classes(n=3000):
    rng = np.random.default_rng(4)
    s = (rng.zipf(1.5, n) % 40 + 2).astype(np.uint16)
    s[rng.random(n) < 0.05] = running.RARE
    s[rng.random(n) < 0.02] = running.END
    s[-1] = running.END
    heavy = np.zeros(running.CLASSES, bool)
    heavy[2:5] = True
    return s, heavy


def test_contexts_match_brute_force():
    s, heavy = some_classes()
    r = running.Running(s, heavy)
    begin = 0
    for t in range(len(s)):
        own = s[begin:t].tolist()
        assert r.one[t] == (own[-1] if own else running.END)
        assert r.two[t] == (own[-2] if len(own) > 1 else running.END)
        assert r.far[t] == next((x for x in reversed(own[:-1]) if heavy[x]), running.END)
        before = [running.END, running.END, *own]
        stood = [i for i in range(len(own)) if before[i : i + 2] == before[-2:]]
        assert r.expected[t] == (own[stood[-1]] if stood else -1)
        if s[t] == running.END:
            begin = t + 1


def test_counts_match_brute_force_and_learning_pays():
    s, heavy = some_classes()
    counts = np.zeros((2, running.COUNTS), np.int64)
    running.tally(s, heavy, counts)
    own = Counter()
    for x in s.tolist():
        for j in range(running.LEVELS):
            own[(x >> (9 - j)) & 1, (x >> (10 - j)) | 1 << j] += 1
    free = counts[:, running.CONTEXTS << running.SLOTS :]
    assert {(b, i): free[b, i] for b, i in np.argwhere(free).tolist()} == own
    assert counts.sum() == (running.CONTEXTS + 1) * running.LEVELS * len(s)


def test_learning_pays_on_other_texts():
    rng = np.random.default_rng(9)
    step = rng.permutation(40)
    def chain(n):
        s = np.empty(n, np.uint16)
        x = 0
        for i in range(n):
            x = step[x] if rng.random() < 0.7 else rng.integers(40)
            s[i] = 2 + 25 * x
        return s
    train, other, heavy = chain(60_000), chain(5_000), np.zeros(running.CLASSES, bool)
    counts = np.zeros((2, running.COUNTS), np.int64)
    running.tally(train, heavy, counts)
    mixer = running.Mixer(counts.astype(np.float32), heavy)
    before = mixer.scorer()(other).sum()
    mixer.learn(train)
    after = mixer.scorer()(other).sum()
    # close to what the chain itself costs
    ideal = 5_000 * (0.7075 * math.log10(0.7075) + 39 * 0.0075 * math.log10(0.0075))
    assert after > before and after > 1.1 * ideal


def test_classes_are_a_distribution():
    s, heavy = some_classes()
    counts = np.zeros((2, running.COUNTS), np.int64)
    running.tally(s, heavy, counts)
    mixer = running.Mixer(counts.astype(np.float32), heavy)
    mixer.learn(s)
    score = mixer.scorer()
    for n in (0, 5, 40):
        total = sum(10 ** score(np.append(s[:n], c).astype(np.uint16))[-1] for c in range(running.CLASSES))
        assert abs(total - 1) < 1e-4


def test_ranges_of_hashes_share_the_classes():
    rng = np.random.default_rng(2)
    parts = [(rng.integers(0, lm.GROUPS, 200), rng.integers(0, 50, 200)) for _ in range(8)]
    masses = np.stack([np.bincount(g, np.where(x > 1, x, 0), lm.GROUPS) for g, x in parts], 1)
    found = np.concatenate([lm._classes(i, g, x, 3, masses) for i, (g, x) in enumerate(parts)])
    group, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    assert (found[c < 2] == running.RARE).all()
    # in order of group, then of range, then of place
    order = np.argsort(group, kind="stable")
    own = found[order][c[order] > 1]
    assert (np.diff(own) >= 0).all() and own[0] == 2 and own[-1] < running.CLASSES
    # ranges finer than the masses are told
    g, x, even = np.array([7, 7]), np.array([9, 9]), np.ones((lm.GROUPS, 1 << lm.COARSE))
    fine = [lm._classes(5 * 4 + i, g, x, lm.COARSE + 2, even) for i in range(4)]
    assert (np.diff(np.concatenate(fine)) >= 0).all()


def test_texts_are_read_once(spark, docs, texts):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def look(text):
        seen.add(1)
        return text

    df = docs(*texts)
    assert lm.score_documents(spark, df.withColumn("text", look("text"))).count() == len(texts)
    assert seen.value == len(texts)


def test_words_are_hashed_alike_wherever_they_stand():
    word = b"stru\xc3\xbcnd"
    raw = np.frombuffer(b" " + (word + b" ka ") * 700 + b"\t" + word + b" ", np.uint8)
    first, last, h = lm.spans(raw)
    assert len(raw) > 5000 and len(h) == 1401 and len(set(h.tolist())) == 2
    power, own = 1, 0
    for b in word:
        own, power = (own + int(lm._BYTE[b]) * power) % 2**64, power * int(lm._BASE) % 2**64
    own = (own + len(word)) % 2**64
    own = (own ^ (own >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    own = (own ^ (own >> 27)) * 0x94D049BB133111EB % 2**64
    assert {int(x) for x in h[last - first == len(word)]} == {own ^ (own >> 31)}


def test_mixing_matches_one_bit_after_another():
    s, heavy = some_classes(700)
    counts = np.zeros((2, running.COUNTS), np.int64)
    running.tally(s, heavy, counts)
    mixer = running.Mixer(counts.astype(np.float32), heavy)
    mixer.learn(s)
    r, levels, m32 = running.Running(s, heavy), running.LEVELS, 0xFFFFFFFF

    def mixed(weights, t, j, own, seen):
        node = int(s[t]) >> (levels - j) | 1 << j
        h = (int(r.both[t]) ^ node * 0x2C1B3C6D & m32) * 0x297A2D39 & m32
        h = (h ^ h >> 15) * 0x9E3779B1 & m32
        keys = ("one", int(r.one[t]), node), ("far", int(r.far[t]), node), ("both", h >> 12), ("none", node)
        bit = int(s[t]) >> (levels - 1 - j) & 1
        if seen is None:
            return [(k, bit) for k in keys]
        n = [[seen[k, b] - own * (b == bit) for b in (0, 1)] for k in keys]
        x = [math.log((b + 0.4) / (a + 0.4)) for a, b in n]
        e = int(r.expected[t])
        agrees = e >= 0 and e >> (levels - j) == int(s[t]) >> (levels - j)
        gate = sum(sum(n[2]) > k for k in (0, 2, 20)) + 4 * agrees
        x += [(4 * (e >> (levels - 1 - j) & 1) - 2) * agrees, 0.3]
        return bit, gate, np.array(x), float(np.dot(weights[j][gate], x))

    seen = Counter(k for t in range(len(s)) for j in range(levels) for k in mixed(None, t, j, 0, None))
    start = running.Mixer(counts.astype(np.float32), heavy).weights
    slope, bend = np.zeros((2, *start.shape))
    for t in range(len(s)):
        for j in range(levels):
            bit, gate, x, dot = mixed(start, t, j, 1, seen)
            p = 1 / (1 + math.exp(-min(max(dot, -12), 12)))
            slope[j, gate] += (bit - p) * x
            bend[j, gate] += p * (1 - p) * x**2
    assert mixer.weights == pytest.approx(start + running.RATE * slope / (bend + 50), abs=1e-4)
    assert mixer.refined.sum() == levels * len(s)
    zeros, ones = mixer.refined
    logs = mixer.scorer()(s)
    for t in range(0, len(s), 7):
        own = 0.0
        for j in range(levels):
            bit, _, _, dot = mixed(mixer.weights, t, j, 0, seen)
            cell = int(min(max((dot + 8) * running.STEPS / 16, 0), running.STEPS - 1))
            p, n = 1 / (1 + math.exp(-min(max(dot, -12), 12))), zeros[j, cell] + ones[j, cell]
            p = (p + (ones[j, cell] + 4 * p) / (n + 4)) / 2
            own += math.log10(p if bit else 1 - p)
        assert logs[t] == pytest.approx(own, abs=1e-2)
