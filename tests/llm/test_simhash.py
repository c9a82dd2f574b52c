import random
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import simhash


def test_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(256) for _ in range(60)]
    for v in list(values):
        for _ in range(6):
            for b in rng.sample(range(256), rng.randrange(1, 60)):
                v ^= 1 << b
            values.append(v)
    tree = simhash.BKTree(values[0])
    for v in values[1:]:
        tree.add(v)
    for v in values:
        assert sorted(tree.within(v, 40)) == sorted({w for w in values if (v ^ w).bit_count() <= 40})


def test_fingerprint_is_the_sign_of_the_sum():
    hashes = np.array([3, 99, 12345678901234567], dtype=np.uint64)
    lanes = simhash._mix(hashes[:, None] + simhash._GOLDEN * np.arange(1, 5, dtype=np.uint64)[None, :])
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1).astype(int)
    assert simhash.fingerprint(hashes) == np.packbits((2 * bits - 1).sum(axis=0) >= 0).tobytes()


def test_recall_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert out.keys() == texts.keys()
    prints = {d: simhash.text_fingerprint(t) for d, t in texts.items()}
    ids = sorted(d for d in prints if prints[d][1])
    raw = np.stack([np.unpackbits(np.frombuffer(prints[d][0], np.uint8)) for d in ids]).astype(np.int32)
    distance = raw.sum(1)[:, None] + raw.sum(1)[None, :] - 2 * raw @ raw.T
    pairs = [(ids[i], ids[j]) for i, j in np.argwhere(distance <= simhash.RADIUS) if i < j]
    found = np.mean([out[a].group_id == out[b].group_id for a, b in pairs])
    assert len(pairs) > 100 and found >= 0.95
    near = set(pairs)
    groups = defaultdict(list)
    for d, r in out.items():
        groups[r.group_id].append(d)
    for group, members in groups.items():
        assert group == min(members) and [d for d in members if out[d].keep] == [group]
        assert all(out[d].group_size == len(members) for d in members)
        # Each member is tied to the rest by pairs within the radius.
        reached, frontier = {members[0]}, [members[0]]
        while frontier:
            a = frontier.pop()
            for b in members:
                if b not in reached and ((min(a, b), max(a, b)) in near or texts[a] == texts[b]):
                    reached.add(b)
                    frontier.append(b)
        assert reached == set(members)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {d for d, r in out.items() if r.keep}


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    rows = []
    for i in range(1500):
        own = list(base)
        for _ in range(5):
            own[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.group_id for r in out).most_common(1)[0][1] >= 1480


def test_edge_cases(spark):
    long = "alpha beta gamma " * 60_000
    rows = [(1, None, "a"), (2, None, "a"), (3, "", "a"), (4, "", "b"), (5, "%% $$", "a"), (6, "%%  $$", "a"), (7, long, "a"), (8, "gamma alpha beta", "b"), (None, "some other words here now", "a"), (9, "some other words here now", "a"), (9, "some other words here now", "a"), (None, "nobody has an id in here", "a"), (None, "nobody has an id in here", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    group = defaultdict(set)
    for r in out:
        group[r.doc_id].add((r.group_id, r.group_size))
    assert group[1] == {(1, 1)} and group[2] == {(2, 1)} and group[3] == group[4] == {(3, 2)}
    assert group[5] == {(5, 1)} and group[6] == {(6, 1)} and group[7] == group[8] == {(7, 2)}
    assert group[9] == {(9, 3)} and group[None] == {(9, 3), (None, 2)}
    assert Counter(r.doc_id for r in out if r.keep) == Counter({1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 9: 1, None: 1})
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 5, 6, 7, 9, None])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_recall_at_the_radius_at_any_size():
    for n in (1_000, 1_000_000, 10_000_000, 3_000_000_000):
        bits, tables = simhash.shard_plan(n)
        assert all(1 - (1 - (1 - d / simhash.BITS) ** bits) ** tables >= 0.95 for d in range(simhash.RADIUS + 1))


def test_pairs_near_the_radius_meet_under_the_plan_of_a_large_corpus():
    rng = np.random.RandomState(11)
    bits, tables = simhash.shard_plan(10_000_000)
    masks = simhash._masks(bits, tables)
    met = []
    for trial in range(400):
        flips = np.zeros(simhash.BITS, bool)
        flips[rng.permutation(simhash.BITS)[: 33 + trial % 8]] = True
        met.append(any(not flips[m].any() for m in masks))
    assert np.mean(met) >= 0.9


def test_maps_among_the_columns(spark):
    rows = [(2, "one two three four", {"a": 1}), (1, "one two three four", {"b": 2}), (1, "one two three four", {"b": 2}), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    assert sorted((r.doc_id, r.m) for r in simhash.drop_near_duplicates(docs).collect()) == [(1, {"b": 2}), (3, None)]


def flipped(fp, bits):
    value = int.from_bytes(fp, "big")
    for b in bits:
        value ^= 1 << int(b)
    return value.to_bytes(32, "big")


def test_cross_pairs_against_all_pairs():
    rng = np.random.RandomState(3)
    for radius, n in ((40, 1500), (40, 60), (9, 400), (0, 100)):
        seeds = [rng.bytes(32) for _ in range(n // 4)]
        fps = [flipped(s, rng.permutation(256)[: rng.randint(0, radius + 6)]) for s in seeds for _ in range(4)]
        raw = np.frombuffer(b"".join(fps), np.uint8).reshape(-1, 32)
        bits = np.unpackbits(raw, axis=1).astype(np.int32)
        distance = bits.sum(1)[:, None] + bits.sum(1)[None, :] - 2 * bits @ bits.T
        group = rng.randint(0, n // 2, n)
        want = {(i, j) for i, j in np.argwhere(distance <= radius).tolist() if group[i] != group[j]}
        got = {p for a, b in simhash.cross_pairs(raw, group, raw, group, radius) for p in zip(a.tolist(), b.tolist())}
        assert got == want and want


def test_followers_of_different_leaders_are_linked(spark):
    """Chains of links at the radius itself, whatever shards hold them: no link is lost."""
    rng = np.random.RandomState(5)
    fps = []
    for _ in range(300):
        steps = rng.permutation(256)[:120].reshape(3, 40)
        chain = [rng.bytes(32)]
        for s in steps:
            chain.append(flipped(chain[-1], s))
        fps += chain
    lone = [rng.bytes(32) for _ in range(400)]
    table = spark.createDataFrame([(bytearray(f), True) for f in fps + lone], "fp binary, wordy boolean")
    for recall in (simhash.RECALL, 0.01):
        root = {bytes(r.fp): bytes(r.root) for r in simhash._rooted(table, simhash.RADIUS, simhash.DESIGN, recall).collect()}
        for i in range(0, len(fps), 4):
            assert {root[f] for f in fps[i : i + 4]} == {min(fps[i : i + 4])}
        assert all(root[f] == f for f in lone)
    # a and b follow leaders of their own in one shard: their link is in no tree.
    base = bytes(32)
    x, y = flipped(base, range(40)), flipped(base, range(40, 75))
    first, last = flipped(base, range(216, 256)), flipped(y, range(100, 140))
    table = spark.createDataFrame([(bytearray(f), True) for f in (base, x, y, first, last)], "fp binary, wordy boolean")
    assert len({bytes(r.root) for r in simhash._rooted(table, simhash.RADIUS, simhash.DESIGN, simhash.RECALL).collect()}) == 1


def test_shares_of_the_second_pass_find_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_GROUP", 8)
    monkeypatch.setattr(simhash, "CANDIDATES_AT_ONCE", 50)
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 2, (12, 256), dtype=np.uint8)
    flat = np.repeat(seeds, 25, axis=0) ^ (rng.random((300, 256)) < rng.choice([0.01, 0.05, 0.09], (300, 1)))
    raw = np.packbits(flat.astype(np.uint8), axis=1)
    group = np.where(rng.random(300) < 0.5, np.arange(300) // 25, 100 + rng.integers(0, 40, 300))
    near = np.unpackbits(raw[:, None] ^ raw[None], axis=2).sum(axis=2, dtype=np.int64) <= simhash.RADIUS
    wanted = {(i, j) for i, j in np.argwhere(near & (group[:, None] != group[None])).tolist() if i < j}
    plan = simhash.part_plan(1 << 20, simhash.RADIUS)
    assert sum(t + 1 for _, _, t in plan) == simhash.RADIUS + 1 and len(plan) >= 16
    got = set()
    for share in range(5):
        for a, b in simhash.cross_pairs(raw, group, raw, group, simhash.RADIUS, plan[share::5], True):
            got.update((min(p), max(p)) for p in zip(a.tolist(), b.tolist()))
    assert wanted == got and len(wanted) > 500
