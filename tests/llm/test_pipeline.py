from collections import Counter, defaultdict

import numpy as np
import pytest
from test_decontaminate import brute as leaks
from test_lines import brute_force
from test_packing import best_fit_decreasing

import corpus_pipeline
from millrace.llm import decontaminate, language, lines, packing, simhash, tokens

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(base / str(i))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    columns = stages[0][0].schema.names
    assert all(after.schema.names == columns for _, after in stages[:-1])


def test_language_stage(stages):
    before, after = stages[0]
    rows = language.documents_as_rows(before, [before.doc_id])
    accepted = {r.doc_id for r in language.identify(rows, language.train(before), ["doc_id"]).collect() if r.accepted}
    assert {r.doc_id for r in after.collect()} == accepted and len(accepted) >= 0.99 * before.count()


def test_line_stage(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[1])
    for (d, r), text in zip(before.items(), brute_force([r.text for r in before.values()])):
        assert (after[d].text, after[d].n_chars) == (text, len(text))


def test_near_duplicate_stage(stages):
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in stages[2])
    ids = sorted(before)
    prints = [simhash.text_fingerprint(before[d]) for d in ids]
    raw = np.stack([np.unpackbits(np.frombuffer(p, np.uint8)) for p, _ in prints]).astype(np.int32)
    distance = raw.sum(1)[:, None] + raw.sum(1)[None, :] - 2 * raw @ raw.T
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in np.argwhere(distance <= simhash.RADIUS):
        if prints[i][1] and prints[j][1] or distance[i, j] == 0:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    expected = {ids[i] for i in range(len(ids)) if find(i) == i}
    assert len(expected ^ set(after)) <= 0.01 * len(expected) and expected <= set(after)
    assert all(after[d] == before[d] for d in after)


def test_decontamination_stage(spark, stages):
    before, after = ([(r.doc_id, r.text) for r in d.collect()] for d in stages[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, _ in leaks(before, items, decontaminate.THRESHOLD, decontaminate.OVERLAP)}
    assert held and sorted(after) == sorted((d, t) for d, t in before if d not in held)


def test_packing_stage(stages):
    before, after = stages[4]
    pieces = []
    for r in before.collect():
        n = len(tokens.encoding().encode_ordinary(r.text))
        pieces += [min(packing.CAPACITY, n - i) for i in range(0, n, packing.CAPACITY)]
    bins = defaultdict(list)
    for r in after.collect():
        bins[r.bin_id].append((r.bin_offset, r.n_tokens))
    assert Counter(tuple(n for _, n in sorted(b)) for b in bins.values()) == best_fit_decreasing(pieces, packing.CAPACITY)


def test_run_applies_all_stages(spark, stages):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    key = lambda r: (r.doc_id, r.piece, r.n_tokens)
    assert Counter(map(key, corpus_pipeline.run(spark, small).collect())) == Counter(map(key, docs.collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark):
    base = [(i, f"the quick brown fox number {i} jumps over the lazy dog and goes home again " + " ".join(f"w{i}x{j}" for j in range(20)), "en", "s", 10) for i in range(30)]
    odd = [(None, "just some words of the same fox and dog", "en", None, None), (40, None, "en", "s", 0), (41, "", None, "s", 0), (42, "dog and fox " * 20_000, "en", "s", 1), (1, base[1][1], "en", "s", 10)]
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(base + odd)], "doc_id long, text string, lang string, source string, n_chars long, fp string, bucket int")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            rows = out.count()
            assert rows <= table.count() or name == "packing"
            if name != "packing":
                assert out.columns == docs.columns
    kept = {name: Counter(r.doc_id for r in stage(spark, docs, SF).collect()) for name, stage in corpus_pipeline.STAGES}
    assert kept["language_id"][40] == kept["language_id"][41] == 0 and kept["language_id"][None] == 1
    assert sum(kept["line_dedup"].values()) == sum(kept["decontamination"].values()) == 35
    assert kept["near_dedup"][40] == kept["near_dedup"][41] == kept["near_dedup"][42] == 1
    assert kept["packing"][40] == kept["packing"][41] == 0 and kept["packing"][42] > 10


def test_near_duplicate_stage_loses_no_link(spark):
    """Pairs of texts about the radius apart: one of each pair within it goes, without exception."""
    rng = np.random.RandomState(2)
    texts = []
    for i in range(500):
        base = [f"w{i}x{j}" for j in range(200)]
        other = base[:]
        for j in rng.permutation(200)[:22]:
            other[j] = f"v{i}x{j}"
        texts += [" ".join(base), " ".join(other)]
    raw = [np.unpackbits(np.frombuffer(simhash.text_fingerprint(t)[0], np.uint8)) for t in texts]
    near = [int((raw[i] != raw[i + 1]).sum()) <= simhash.RADIUS for i in range(0, len(texts), 2)]
    assert 100 < sum(near) < 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i in range(len(texts)) if i % 2 == 0 or not near[i // 2]}


def test_line_stage_writes_no_more_files_than_it_needs(spark, tmp_path):
    """A file for texts that lose nothing and one for the others: the executor starts processes for each file."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    corpus_pipeline.drop_recurring_lines(spark, docs, small).write.parquet(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*.parquet"))) <= 2
