import math
import random
from collections import Counter

import pytest

from millrace.llm import decontaminate as dc
from millrace.llm.common import words


def test_question_and_answer():
    assert dc.question_answer("What is it? Answer: a tree") == (["what", "is", "it"], ["a", "tree"])
    assert dc.question_answer("One two. Three four.") == (["one", "two"], ["three", "four"])
    assert dc.question_answer("a b c d e f g h") == (list("abcdef"), list("gh"))
    assert dc.question_answer("") == ([], []) and dc.question_answer("solo") == ([], ["solo"])


def brute(docs, items, threshold, least):
    segs = [(i, s) for i, (_, t) in enumerate(items) for s in dc.segments(words(t))]
    df = Counter(t for _, s in segs for t in set(s))
    average = sum(len(s) for _, s in segs) / len(segs)

    def impacts(seg):
        tf, norm = Counter(seg), dc.K1 * (1 - dc.B + dc.B * len(seg) / average)
        return {t: math.log(1 + (len(segs) - df[t] + 0.5) / (df[t] + 0.5)) * c * (dc.K1 + 1) / (c + norm) for t, c in tf.items()}

    made = [(i, impacts(s)) for i, s in segs]
    out = {}
    for d, text in docs:
        w = words(text or "")
        for start in range(0, len(w), dc.SEGMENT):
            passage = set(w[start : start + 2 * dc.SEGMENT])
            for i, own in made:
                score = sum(v for t, v in own.items() if t in passage) / sum(own.values())
                if score >= threshold:
                    q, a = dc.question_answer(items[i][1])
                    n = len(q) + len(a)
                    region = w[max(0, start - n) : start + 2 * dc.SEGMENT + n]
                    share = (dc.overlap(q, region), dc.overlap(a, region))
                    whole = n >= dc.EXACT_WORDS or n >= dc.LEAST_WORDS and f" {' '.join(q + a)} " in f" {' '.join(region)} "
                    if whole and min(share) >= least:
                        key = (d, items[i][0])
                        out[key] = max(out.get(key, (0, 0)), (round(score, 6), -start))
    return out


@pytest.mark.parametrize("shard", [65_536, 9])
def test_against_brute_force(spark, shard):
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) for _ in range(500)]
    sentence = lambda n: " ".join(rng.choices(pool, weights=[1 / (i + 3) for i in range(500)], k=n)) + "."
    items = [(i, " ".join(sentence(rng.randrange(3, 25)) for _ in range(rng.randrange(1, 4)))) for i in range(30)]
    items.append((30, " ".join(sentence(20) for _ in range(9))))
    docs = []
    for d in range(60):
        body = [sentence(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 12))]
        if d % 2:
            leaked = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, len(leaked) // 4 + 1)):
                leaked[rng.randrange(len(leaked))] = rng.choice(pool)
            body.insert(rng.randrange(len(body) + 1), " ".join(leaked).upper())
        docs.append((d, "\n".join(body)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.score, 6), -r.passage) for r in dc.contaminated(frame, bench, shard_segments=shard).collect()}
    assert got == brute(docs, items, dc.THRESHOLD, dc.OVERLAP) and len(got) > 15
    kept = {r.doc_id for r in dc.drop_contaminated(frame, bench, shard_segments=shard).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_edge_cases(spark):
    item = "alpha beta gamma delta epsilon zeta. eta theta iota kappa"
    rows = [(1, item, "x"), (1, item, "x"), (None, "pre " + item, "x"), (2, None, "x"), (3, "", "x"), (4, "noise " * 80_000 + item, "x"), (5, "alpha beta gamma", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item, 1), (None, item, 1), (8, None, 1), (9, "", 1)], "item_id long, text string, score int")
    got = Counter((r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect())
    assert got == Counter({(1, 7): 2, (1, None): 2, (None, 7): 1, (None, None): 1, (4, 7): 1, (4, None): 1})
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, bench).collect()) == [2, 3, 5]
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), bench).count() == 0
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_planted_items_are_found(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    exact = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert exact <= got and len(got) <= 1.1 * len(exact) + 2


def test_short_items_need_their_words(spark):
    bench = spark.createDataFrame([(1, "yes"), (2, "Is it so? Yes"), (3, "one two three four five. Six seven"), (4, "Answer: no")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "well yes that is it"), (2, "is it so yes indeed"), (3, "and one two three four five six seven go"), (4, "one two three four five and six seven go"), (5, "no no no answer")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()} == {(3, 3)}
    assert dc.overlap([], ["a"]) == 0.0


def test_a_large_benchmark_in_one_pass():
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(4000)]
    items = [(i, " ".join(rng.choices(pool, k=25)) + ". " + " ".join(rng.choices(pool, k=6))) for i in range(20_000)]
    df = Counter(t for _, text in items for s in dc.segments(words(text)) for t in set(s))
    index = dc.Index(items, df, 20_000, 31.0, dc.THRESHOLD)
    docs = [rng.choices(pool, k=300) for _ in range(200)]
    for d in range(0, 200, 4):
        docs[d][100:100] = words(items[d * 100][1])
    found = dc.find(index, docs, dc.OVERLAP)
    assert {(d, i) for d, own in found.items() for i in own} == {(d, d * 100) for d in range(0, 200, 4)}


def test_string_ids(spark):
    item = "alpha beta gamma delta epsilon zeta. eta theta iota kappa lambda mu nu"
    docs, bench = spark.createDataFrame([("x", item)], "doc_id string, text string"), spark.createDataFrame([("b", item)], "item_id string, text string")
    assert [tuple(r)[:2] for r in dc.contaminated(docs, bench).collect()] == [("x", "b")]
