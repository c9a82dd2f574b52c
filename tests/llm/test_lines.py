import random
from collections import Counter, defaultdict

from millrace.llm import lines


def test_templates_against_every_pair():
    rng = random.Random(3)
    for n in (4, 7, 12, 40):
        base = [bytes(rng.randrange(256) for _ in range(n)) for _ in range(20)]
        sigs = []
        for _ in range(300):
            s = bytearray(rng.choice(base))
            for _ in range(rng.randrange(0, max(2, n // 3))):
                s[rng.randrange(n)] = rng.randrange(256)
            sigs.append(bytes(s))
        made, expected, exact = [], [], {}
        for s in sigs:
            if s not in exact:
                scores = [sum(a == b for a, b in zip(m, s)) for m in made]
                best = max(range(len(made)), key=lambda i: (scores[i], -i), default=-1)
                if best >= 0 and scores[best] >= n - min(int(0.25 * n + 1e-9), max(0, n - lines.MIN_CONSTANT)):
                    made[best] = [a if a == b else -1 for a, b in zip(made[best], s)]
                else:
                    best = len(made)
                    made.append(list(s))
                exact[s] = best
            expected.append(exact[s])
        assert lines.templates(sigs, 0.75) == expected


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, _mr_key string, leaf int")


def test_passages_go_and_clean_lines_stay(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for d in range(12):
        own = "\n".join(" ".join(word() for _ in range(60)) for _ in range(5))
        footer = f"Page {d} of {d + 40} was printed at {d}:00 on paper"
        rows.append((d, own + "\n" + passage + "\n" + footer + ("\nEnd of it" if d < 9 else "\nThat is it"), "k", d))  # too few for a short line
    got = {r.doc_id: r for r in lines.drop_recurring(_docs(spark, rows), counts=True).collect()}
    for d, text, _, _ in rows:
        assert got[d].text == "\n".join(text.split("\n")[:5] + text.split("\n")[-1:])
        assert (got[d].n_lines, got[d].n_dropped) == (8, 2)


def test_edge_cases(spark):
    long = "\n".join(f"unique line number{i} x{i} y{i} z{i}" for i in range(1)) + "\n" + "w " * 100_000
    same = "one two three four five\nsix seven eight nine ten"
    rows = [(1, None, "a", 1), (2, "", "a", 1), (None, same, "a", 1), (3, same, "b", 2), (3, same, "b", 2), (4, same, "c", 3), (5, long, "d", 4), (6, "\n\n", "e", 5)]
    out = lines.drop_recurring(_docs(spark, rows))
    assert out.columns == ["doc_id", "text", "_mr_key", "leaf"]
    assert Counter(map(tuple, out.collect())) == Counter(rows)  # copies count once
    assert lines.drop_recurring(_docs(spark, rows).limit(0)).count() == 0
    own = "same words in this line of boilerplate"
    whole = [(i, f"{_own(i)}\n{own}" if i < 3 else own, "k", i) for i in range(4)]
    kept = {r.doc_id: r.text for r in lines.drop_recurring(_docs(spark, whole)).collect()}
    assert kept == {0: _own(0), 1: _own(1), 2: _own(2), 3: ""}  # nothing but boilerplate: empty


def _anchors(text):
    tokens = text.split()
    grams = [" ".join(tokens[i : i + lines.GRAM]) for i in range(len(tokens) - lines.GRAM + 1)]
    hashed = [int(h) for h in lines.run_hashes(lines.word_hashes(tokens), lines.GRAM)]
    width = lines.PASSAGE - lines.GRAM + 1
    if len(grams) < width:
        return set(grams)
    return {grams[min(range(i, i + width), key=hashed.__getitem__)] for i in range(len(grams) - width + 1)}


def _votes(texts):
    """Groups of texts that have COPY_ANCHORS of the anchors of either in common, over all pairs."""
    own = {t: _anchors(t) for t in texts}
    holders, parent = defaultdict(set), {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for t, found in own.items():
        for a in found:
            holders[a].add(t)
    for t, found in own.items():
        for u, n in Counter(u for a in found for u in holders[a]).items():
            if n >= lines.COPY_ANCHORS * max(len(found), len(own[u])):
                parent[root(t)] = root(u)
    return {t: root(t) for t in texts}


def brute_force(texts):
    """The texts without their boilerplate lines."""
    vote = _votes(set(texts))

    def masked(line):  # (leaf, words with the variable ones masked, whether by template)
        words = line.split()
        shape = tuple("<*>" if any(c.isdigit() for c in w) else w for w in words)
        template = len(words) >= lines.MIN_TOKENS and 2 * shape.count("<*>") <= len(words)
        return (len(words), *shape[: lines.LEADING]), shape if template else tuple(words), template

    leaves, exact = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for t in set(texts):
        for line in set(t.split("\n")):
            leaf, shape, template = masked(line)
            if shape:
                (leaves[leaf][shape] if template else exact[shape]).add(vote[t])
    gone = {(False, s) for s, users in exact.items() if len(users) >= lines.SHORT_DOCS}
    for leaf in leaves.values():  # in the operator's order, which is that of the hashes
        keys = sorted(leaf, key=lambda s: lines.line_hashes(" ".join(s).replace("<*>", "0"))[1:3])
        joined = lines.templates(keys, lines.SIMILARITY)
        users = defaultdict(set)
        for k, t in zip(keys, joined):
            users[t] |= leaf[k]
        gone |= {(True, k) for k, t in zip(keys, joined) if len(users[t]) >= lines.MIN_DOCS}
    return ["\n".join(line for line in text.split("\n") if (masked(line)[2], masked(line)[1]) not in gone) for text in texts]


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.text for r in lines.drop_recurring(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [got[d] for d in texts] == brute_force(list(texts.values()))


def test_prose_of_a_leaf_stays(spark):
    places = ["London", "bed", "Paris", "work", "Rome", "sleep"]
    rows = [(i, f"I went to {p}\nalpha beta gamma delta epsilon zeta {p} eta", "k", i) for i, p in enumerate(places)]
    got = {r.doc_id: r.text for r in lines.drop_recurring(_docs(spark, [(d, t + "\n" + _own(d), k, n) for d, t, k, n in rows])).collect()}
    assert all(t.split("\n")[0] == f"I went to {places[d]}" for d, t in got.items())
    assert all(len(t.split("\n")) == 2 for t in got.values())  # seven of eight words agree


def _own(d, n=120):
    rng = random.Random(d)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))


def test_short_lines_and_supports(spark):
    rows = [(d, f"Share this page\n{_own(d)}\nsome words of a footer that all have", "k", d) for d in range(12)]
    docs = _docs(spark, rows)
    assert all(r.text == _own(r.doc_id) for r in lines.drop_recurring(docs).collect())
    few = {r.doc_id: r.text for r in lines.drop_recurring(docs.filter("doc_id < 9")).collect()}
    assert all(t == f"Share this page\n{_own(d)}" for d, t in few.items())
    assert Counter(r.text for r in lines.drop_recurring(docs, min_docs=13, short_docs=13).collect()) == Counter(r[1] for r in rows)


def test_counts_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b", 77, 5)], "doc_id long, text string, n_lines int, N_DROPPED int")
    got = lines.drop_recurring(docs, counts=True)
    assert got.columns == ["doc_id", "text", "n_lines", "N_DROPPED", "n_lines_", "n_dropped_"]
    assert tuple(got.first()) == (1, "a b", 77, 5, 1, 0)


def test_passages_within_lines_of_two_documents(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, short, own = words(55), words(49), [words(90) for _ in range(8)]
    folded = "\n".join([" ".join(passage.split()[:20]), " ".join(passage.split()[20:])])
    copy = words(300)
    near = copy.split()
    near[150] = "changed"
    rows = [
        (0, f"{own[0]} {passage} {own[1]}\n{own[2]}", "k", 0),
        (1, f"{own[3]}\n{own[4]} {folded} {own[5]}", "k", 1),
        (2, f"{own[6]} {short} x", "k", 2),
        (3, f"{own[7]} {short} y", "k", 3),
        (4, copy, "k", 4),
        (5, " ".join(near), "k", 5),
    ]
    got = {r.doc_id: r.text for r in lines.drop_recurring(_docs(spark, rows), passage=lines.PASSAGE).collect()}
    assert got[0] == f"{own[0]} {own[1]}\n{own[2]}"
    assert got[1] == f"{own[3]}\n{own[4]}\n{own[5]}"
    assert all(got[d] == rows[d][1] for d in (2, 3, 4, 5))


def test_texts_meet_their_drops_in_one_join(spark, sf):
    """Texts that lose lines, those that keep all and nulls: two reads of the table and one shuffle of texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for passage in (None, lines.PASSAGE):
        out = lines.drop_recurring(docs, counts=True, passage=passage)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("documents.parquet") == 2
