import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing, tokens


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, b in enumerate(bins) if sum(b) + n <= capacity]
        if fits:
            bins[max(fits, key=lambda i: (sum(bins[i]), -i))].append(n)
        else:
            bins.append([n])
    return Counter(tuple(b) for b in bins)


def planned(histogram, capacity):
    runs, n_bins = packing.plan(histogram, capacity)
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, lo, n, first, offset in runs:
        ranks[length] += range(lo, lo + n)
        for i in range(n):
            bins[first + i].append((offset, length))
    for length, n in histogram.items():
        assert sorted(ranks[length]) == list(range(n))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(bins) == list(range(n_bins))
    return Counter(tuple(n for _, n in sorted(b)) for b in bins.values())


@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(lengths, capacity):
    assert planned(dict(Counter(lengths)), capacity) == best_fit_decreasing(lengths, capacity)


def test_plan_size_follows_lengths_not_documents():
    rng = random.Random(1)
    small = {n: rng.randrange(1, 100) for n in range(1, 2049)}
    a, _ = packing.plan(small, 2048)
    b, _ = packing.plan({k: v * 1_000_003 for k, v in small.items()}, 2048)
    assert len(b) < 40_000 and len(b) < 4 * len(a)
    with pytest.raises(ValueError):
        packing.plan({2049: 1}, 2048)


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encode = tokens.encoding()
    pieces = []
    for r in docs.collect():
        n = len(encode.encode_ordinary(r.text))
        pieces += [min(512, n - i) for i in range(0, n, 512)]
    bins, slots = defaultdict(list), Counter()
    for r in packing.pack(docs, capacity=512).collect():
        bins[r.bin_id].append((r.bin_offset, r.n_tokens))
        slots[r.doc_id, r.piece] += 1
    assert max(slots.values()) == 1 and len(slots) == len(pieces)
    assert Counter(tuple(n for _, n in sorted(b)) for b in bins.values()) == best_fit_decreasing(pieces, 512)
    for own in bins.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 2)
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "e f g h", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack(docs, capacity=1024).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == {1: 2, None: 1, 4: 1}
    assert sum(r.n_tokens for r in out) == sum(len(tokens.encoding().encode_ordinary(t)) for _, t, _ in rows if t)
    assert len({(r.bin_id, r.bin_offset) for r in out}) == len(out)
    assert packing.pack(docs.limit(0)).count() == 0
