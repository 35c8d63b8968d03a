import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from docspark.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, a string, ref string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        ends[rebuilt[c]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items()
    )


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)
    out = trie.prefix_trie(spark, df.repartition(3)).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in out)


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-4, 40), 1000, 10**12]:
        for turn in range(rng.randrange(13)):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", "tool", None]), rng.choice(["a", "é", "", None])))
    return [*rows, *rows[:9], (None, 1, "user", "lost"), (7, 2, "user", "z" * 100_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = sample(seed)
    assert run(spark, rows) == brute(rows)


def test_collisions_are_noticed(spark, monkeypatch):
    # Base 1 forgets the order of turns; the attempt after it does not.
    real = trie._bases
    monkeypatch.setattr(trie, "_bases", lambda attempt: [1, 1, 1] if attempt == 0 else real(attempt))
    turns = [("user", "a"), ("user", "b"), ("user", "c")]
    rows = [(5, i, *t) for i, t in enumerate(turns)] + [(10, i, *t) for i, t in enumerate(reversed(turns))]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(trie, "_bases", lambda attempt: [1, 1, 1])
    monkeypatch.setattr(trie, "ATTEMPTS", 1)
    with pytest.raises(RuntimeError):
        run(spark, rows)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH_BITS", 3)
    rows = [(5, i, "user", f"t{i % 7}") for i in range(300)] + [(6, i, "user", f"t{i % 7}") for i in range(280)]
    rows += [(c, i, "user", "same") for c in range(20, 60) for i in range(3)]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
