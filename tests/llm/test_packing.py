import array
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import packing
from docspark.llm.queries import tokenizer

TEXTS = ["a  b", " x", "x ", "\n a \n\nb", "", "<|endoftext|> hi", " it's  'll 's", "x²½ é", "word " * 3000, "a" * 5000]


def test_ids_are_those_of_the_tokenizers_file():
    encode = packing.Encoder(tokenizer())
    assert encode.fast is not None
    for text in TEXTS:
        ids = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == array.array("I", ids).tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8))
def test_plan_places_every_piece_once_and_fills_bins(counts):
    bins = defaultdict(list)
    for length, first, stop, per_bin, b, place in packing.plan_bins(counts, 40):
        for r in range(first, stop):
            bins[b + (r - first) // per_bin].append((place + (r - first) % per_bin * length, length))
    total = sum(len(x) for x in bins.values())
    assert total == sum(counts.values())
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 40
    # two bins that could be one would show slack left behind
    fills = sorted(sum(n for _, n in x) for x in bins.values())
    assert len(fills) < 2 or fills[0] + fills[1] > 40


def test_fullest_is_the_best_subset_sum_with_the_longest():
    counts = {7: 1, 5: 2, 3: 1}
    assert packing.fullest(counts, 10) == {7: 1, 3: 1}
    assert sum(k * n for k, n in packing.fullest({6: 1, 4: 3}, 13).items()) == 10


def test_documents_round_trip(spark, docs):
    encode = packing.Encoder(tokenizer())
    df = docs(*TEXTS, None, "word " * 3000)
    rows = packing.pack_documents(spark, df, tokenizer(), 64).collect()
    ids = {i: encode(t or "") + packing.END for i, t in enumerate([*TEXTS, None, "word " * 3000])}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) * 4 == len(ids[i])
        assert all(r.length == 64 for r in own[1:])
    assert set(by_doc) == set(ids)
    for pieces in by_bin.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_table(spark, docs):
    assert packing.pack_documents(spark, docs("x").where("false"), tokenizer()).count() == 0


@pytest.mark.parametrize("capacity", [1, 5])
def test_tiny_sequences(spark, docs, capacity):
    rows = packing.pack_documents(spark, docs("a b c", ""), tokenizer(), capacity).collect()
    assert max(r.length for r in rows) <= capacity


def test_plan_needs_no_python_on_the_executors(spark, docs, capsys):
    packing.pack_documents(spark, docs("a b c", "d", None), tokenizer()).explain()
    plan = capsys.readouterr().out
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan and "InArrow" not in plan
