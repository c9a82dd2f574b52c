import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import rans, tokens


@given(st.lists(st.lists(st.integers(0, 99), max_size=400), min_size=1, max_size=5), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(blocks, skew):
    counts = np.array([1000 ** min(skew, i % 3) for i in range(100)])
    freq = rans.normalised(counts)
    assert freq.sum() == rans.TOTAL and freq.min() >= 1
    ids = [np.array(b, dtype=np.int64) for b in blocks]
    coded = rans.encode_blocks(ids, freq)
    for b, c in zip(ids, coded):
        assert rans.decode_block({"n_tokens": len(b)} | c, freq).tolist() == b.tolist()


def test_segments_decode_alone_and_checksums_catch_damage():
    rng = np.random.RandomState(1)
    ids = np.minimum(rng.geometric(0.01, 70_000), 4999)
    freq = rans.normalised(np.bincount(ids, minlength=5000))
    block = {"n_tokens": len(ids)} | rans.encode_blocks([ids, ids[:5]], freq)[0]
    parts = rans.segments(block)
    assert len(parts) == 5
    for k in reversed(range(len(parts))):
        assert (rans.decode_segment(block, k, freq) == ids[parts[k][0] : parts[k][1]]).all()
    entropy = -(np.bincount(ids) / len(ids) * np.log2(np.maximum(np.bincount(ids), 1) / len(ids))).sum()
    assert len(block["payload"]) * 8 < len(ids) * entropy * 1.02
    bad = bytearray(block["payload"])
    bad[1000] ^= 4
    with pytest.raises(ValueError):
        rans.decode_block(block | {"payload": bytes(bad)}, freq)
    with pytest.raises(ValueError):
        rans.decode_segment(block | {"payload": bytes(bad)}, 4, freq)


def test_documents_round_trip(spark):
    long = "über den Fluss, and over again 12 " * 20_000
    rows = [(1, "a b c", 5), (1, "a b c", 5), (None, "x", 1), (3, "", 2), (4, None, 3), (5, long, 4), (2, " " * 5000 + "\n\té", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload int")
    back = rans.decode(rans.encode(docs, block_tokens=4096)).collect()
    encode = tokens.encoding()
    found = {}
    for r in back:
        found.setdefault((r.doc_id, None if r.ids is None else 0), []).append((r.piece, r.ids))
    for d, t, _ in rows:
        got = found[(d, None if t is None else 0)]
        if t is None:
            assert got == [(0, None)]
        elif d == 1:
            assert sorted(got) == [(0, encode.encode_ordinary(t))] * 2
        else:
            assert encode.decode(sum((i for _, i in sorted(got)), [])) == t
    assert max(r.piece for r in back) > 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    rows = rans.encode(docs).collect()
    assert [r.kind for r in rows] == ["table"]
    assert rans.decode(rans.encode(docs)).count() == 0


def test_every_document_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = rans.decode(rans.encode(docs)).collect()
    encode = tokens.encoding()
    pieces = {}
    for r in back:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.ids))
    for d, t in docs.select("doc_id", "text").collect():
        assert encode.decode(sum((i for _, i in sorted(pieces[d])), [])) == t
