import random
from collections import Counter

import numpy as np

from millrace.llm import toxicity as tox


def test_nearest_is_exact():
    rng = random.Random(2)
    idf = np.array([rng.uniform(1, 5) for _ in range(50)])
    probe = tox.Index([str(i) for i in range(50)], idf, [], [], [])
    make = lambda: probe.vector(Counter(rng.choices(range(50), weights=[1 / (i + 1) for i in range(50)], k=rng.randrange(1, 9))))
    vectors = [make() for _ in range(700)]
    index = tox.Index(probe.terms, idf, vectors, list(range(700)), [i % 2 for i in range(700)], block=16)
    by_id = dict(enumerate(vectors))
    for own in range(60):
        q = make()
        got = index.nearest(q, 15, own)
        cosines = sorted((round(sum(w * v.get(t, 0.0) for t, w in q.items()), 9) for i, v in by_id.items() if i != own), reverse=True)[:15]
        assert np.allclose([s for s, _ in got], [c for c in cosines if c > 0], atol=1e-8)
        assert own not in [index.doc_ids[p] for _, p in got]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.filter("doc_id % 3 <> 0")
    out = {r.doc_id: r for r in tox.score(docs, train).collect()}
    assert len(out) == docs.count()
    held = [(r.toxic, out[r.doc_id]) for r in labels.filter("doc_id % 3 = 0").collect()]
    hits = [o.toxic for t, o in held if t]
    false = [o.toxic for t, o in held if not t]
    assert np.mean(hits) >= 0.9 and np.mean(false) <= 0.01
    assert all(0 <= r.score <= 1 for r in out.values())
    assert all(len(r.neighbours) > 0 for r in out.values() if r.toxic)


def test_edge_cases(spark):
    rows = [(i, f"some plain words {i} here" + (" awfulword" if i % 2 else ""), "x") for i in range(60)]
    rows += [(None, "awfulword", "x"), (1, rows[1][1], "x"), (90, None, "x"), (91, "", "x"), (92, "awfulword " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (1, 1), (None, 1)], "doc_id long, toxic int")
    out = [r for r in tox.score(docs, labels).collect()]
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[90].score is None and by[90].toxic is None and by[90].neighbours == []
    assert by[91].toxic is False and by[92].toxic is True and by[None].toxic is True
    assert tox.score(docs, labels.limit(0)).filter("score is not null").count() == 0
    assert {r.score for r in tox.score(docs, labels.filter("toxic = 0")).collect()} == {0.0, None}
    assert tox.score(docs.limit(0), labels).count() == 0
