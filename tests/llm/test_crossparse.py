import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import crossparse as cp


def brute(reference, sequence):
    inside = {tuple(r[i:j]) for r in reference for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    count = at = 0
    while at < len(sequence):
        n = 0
        while at + n < len(sequence) and tuple(sequence[at : at + n + 1]) in inside:
            n += 1
        at, count = at + max(n, 1), count + 1
    return count


@given(st.lists(st.lists(st.integers(0, 3), max_size=14), max_size=4), st.lists(st.integers(0, 4), max_size=20))
@settings(max_examples=200, deadline=None)
def test_phrases_against_brute_force(reference, sequence):
    assert cp.SuffixAutomaton(iter(reference)).phrases(sequence) == brute(reference, sequence)


def test_lz78():
    assert cp.lz78([]) == 0
    assert cp.lz78(list("aababcabcd")) == 4
    assert cp.lz78(list("aa")) == 2 and cp.lz78(list("aaa")) == 2


def test_known_text_scores_below_unknown(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    chain = {w: rng.sample(pool, 3) for w in pool}

    def walk(n):
        w, out = rng.choice(pool), []
        for _ in range(n):
            out.append(w)
            w = rng.choice(chain[w])
        return " ".join(out)

    rows = [(i, walk(200), "x") for i in range(40)] + [(100 + i, " ".join(rng.choices(pool, k=200)), "x") for i in range(20)]
    rows += [(200, None, "x"), (201, "", "x"), (None, walk(50), "x"), (202, "new " * 60_000, "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    out = cp.score(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    like, unlike = [by[i].cross_bits for i in range(40)], [by[100 + i].cross_bits for i in range(20)]
    assert max(like) < min(unlike)
    assert by[200].n_words is None and by[201].n_words == 0 and by[201].cross_bits is None and by[None].n_words == 50
    assert len({r for r in out if r.doc_id == 1}) == 1
    assert cp.score(docs.limit(0), labels).count() == 0
    bare = {r.doc_id: r for r in cp.score(docs, labels.limit(0)).collect()}
    assert bare[0].phrases == 200


def test_every_row_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 1500")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    from millrace.llm.common import words

    got = {r.doc_id: r for r in cp.score(docs, labels, shard_chars=20_000, group_chars=15_000).collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    n, total = docs.count(), docs.agg(F.sum(F.length("text"))).first()[0]
    shards = max(2, int(np.ceil(total * (len(good) / n if len(good) < n else 1.0) / 20_000)))
    own, away = cp.placement(shards, F.col("text"), F.col("doc_id"))
    rows = docs.select("doc_id", "text", own.alias("own"), away.alias("away")).collect()
    assert all(r.own != r.away for r in rows) and len(got) == n
    for r in rows[::9]:
        reference = [words(o.text) for o in rows if o.doc_id in good and o.own == r.away]
        joined = ["\x00".join(["", *w, ""]) for w in reference]
        seq, at, count = words(r.text), 0, 0
        while at < len(seq):
            k = 0
            while at + k < len(seq) and any("\x00".join(["", *seq[at : at + k + 1], ""]) in j for j in joined):
                k += 1
            at, count = at + max(k, 1), count + 1
        assert got[r.doc_id].phrases == count


@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=40), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_suffixes_in_order(texts):
    from millrace.llm import suffixes

    flat = np.array([w for t in texts for w in [*t, 0]] + [0] * suffixes.STRIDE, np.uint64)
    ends = np.flatnonzero(flat == 0)
    tail = lambda p: flat[p : ends[np.searchsorted(ends, p)]].tolist()
    at = np.flatnonzero(flat)
    got = suffixes.sort_suffixes(flat, at)
    assert sorted(got.tolist()) == at.tolist() and [tail(p) for p in got] == sorted(tail(p) for p in at)


def test_every_row_against_the_whole_reference(spark, sf, monkeypatch):
    """Phrases by brute force over all good texts but one's own, pieces and long repeats included."""
    from millrace.llm import suffixes
    from millrace.llm.common import words

    monkeypatch.setattr(suffixes, "PIECE", 5_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 1200").limit(250).collect()]
    near = rows[0][1].split() * 8
    rows += [(10**6, " ".join(near)), (10**6 + 1, " ".join(near[:90] + ["other"] + near[90:])), (10**6 + 2, rows[0][1]), (10**6 + 3, "word " * 300), (10**6 + 4, "word " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = {d for i, (d, _) in enumerate(rows) if i % 2 == 0 or d >= 10**6}
    labels = spark.createDataFrame([(d, 1) for d in sorted(good)], "doc_id long, quality int")
    got = {r.doc_id: r for r in cp.score(docs, labels).collect()}
    reference = {t: "\x00".join(["", *words(t), ""]) for d, t in rows if d in good}
    for d, t in rows:
        others = [r for other, r in reference.items() if other != t]
        seq, at, count = words(t), 0, 0
        while at < len(seq):
            k = 0
            while at + k < len(seq) and any("\x00".join(["", *seq[at : at + k + 1], ""]) in r for r in others):
                k += 1
            at, count = at + max(k, 1), count + 1
        assert (got[d].n_words, got[d].phrases) == (len(seq), count), d
        size = sum(len(words(r)) for r in reference if r != t)
        assert got[d].cross_bits is None or abs(got[d].cross_bits - count * np.log2(size) / len(seq)) < 1e-9


def test_words_without_a_longer_match_need_no_search_each(monkeypatch):
    """Searches don't grow with the phrases of a text where these are words or pairs; counts are those of brute force."""
    from millrace.llm import suffixes

    rng = np.random.RandomState(8)
    reference = [rng.randint(1, 40, 60).tolist() for _ in range(6)]
    flat = np.array([w for r in reference for w in (*r, 0)] + [0] * suffixes.STRIDE, np.uint64)
    at = np.flatnonzero(flat[: -suffixes.STRIDE])
    names = [f"reference {i}" for i in range(6)]
    rows = sorted((suffixes.text_hash(t), 61 * i, 60) for i, t in enumerate(names))
    index = suffixes.Suffixes("", 360, False)
    monkeypatch.setattr(index, "open", lambda: (flat, suffixes.sort_suffixes(flat, at).astype(np.uint32), np.array(rows, np.uint64)))
    others = [rng.randint(1, 45, rng.randint(0, 90)).tolist() for _ in range(40)]
    texts, words = names + [f"other {i}" for i in range(40)], reference + others
    got, size = suffixes.count_phrases(index, texts, [np.array(w, np.uint64) for w in words])
    want = [brute(reference[:i] + reference[i + 1 :], w) for i, w in enumerate(reference)] + [brute(reference, w) for w in others]
    assert got.tolist() == want and size.tolist() == [300] * 6 + [360] * 40
    calls, narrow = [], suffixes._narrow
    monkeypatch.setattr(suffixes, "_narrow", lambda *a: calls.append(1) or narrow(*a))
    unknown = np.arange(100, 600, dtype=np.uint64)
    assert suffixes.count_phrases(index, ["new"], [unknown])[0].tolist() == [500]
    pairs = np.array([x for r in reference for i in range(0, 60, 2) for x in (*r[i : i + 2], 99)], np.uint64)
    assert suffixes.count_phrases(index, ["pairs"], [pairs])[0].tolist() == [360] and len(calls) < 200


def test_texts_of_a_size_are_parsed_together():
    sizes = [5, 900, 1, 0, 5, 2000, 4, 900]
    parts = cp._portions(sizes, 1000)
    assert sorted(i for p in parts for i in p) == list(range(8)) and cp._portions([], 10) == []
    assert all(len(p) == 1 or sum(sizes[i] for i in p) <= 1000 for p in parts)
    assert [sizes[i] for p in parts for i in p] == sorted(sizes)


def test_leading_pairs_are_looked_up_without_a_search(spark, monkeypatch):
    """The table of leading pairs that pieces make is that of the whole array; words and pairs are not searched in the array."""
    from millrace.llm import suffixes

    monkeypatch.setattr(suffixes, "PIECE", 300)
    rng = random.Random(3)
    texts = [" ".join("often" if rng.random() < 0.5 else f"w{rng.randint(0, 80)}" for _ in range(150)) for _ in range(20)]
    index = suffixes.build(spark.createDataFrame([(t,) for t in texts], "text string"))
    text, array, _ = index.open()
    distinct, keys, rows = suffixes.leading_pairs(text, array, index.bits)
    got = index.pairs()
    assert got[0].tolist() == distinct.tolist() and got[1].tolist() == keys.tolist() and got[2].tolist() == [*rows.tolist(), len(array)]
    pairs = {(a, b) for t in texts for a, b in zip(t.split(), t.split()[1:])}
    assert len(rows) >= len(pairs)
    asked = [f"{a} {b}" for a, b in sorted(pairs)] + ["new words only", "often", "w1 new w2"]
    searched, narrow = [], suffixes._narrow
    monkeypatch.setattr(suffixes, "_narrow", lambda *a: searched.append(len(a[2])) or narrow(*a))
    counts = suffixes.count_phrases(index, asked, [suffixes.word_hashes(t) for t in asked])[0].tolist()
    assert counts == [1] * len(pairs) + [3, 1, 3] and not sum(searched)
