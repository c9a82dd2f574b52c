import random
from collections import Counter

import numpy as np

from millrace.llm import language as lid


def test_page_evidence():
    got = lid.page_evidence("https://user@Blog.Example.fr:80/de/1?x", "<!DOCTYPE html><html class=a lang='fr-CA'><script>no</script><!-- no --><p>Un&nbsp;mot &amp; deux</p>")
    assert (got["declared"], got["host"], got["path"]) == ("fr", "blog.example.fr", "de") and got["text"].split() == ["Un", "mot", "&", "deux"]
    assert lid.page_evidence(None, None) == {"text": None, "declared": None, "host": None, "path": None}
    assert lid.page_evidence("not an address", "")["host"] is None
    assert lid.page_evidence("http://a.org/english/x", "<p>")["path"] is None


def _make(rng, letters, n):
    return " ".join("".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


def _tables(spark):
    rng = random.Random(9)
    kinds = {"aa": "bcdfg", "bb": "klmnp", "cc": "rstvz"}
    rows, truth = [], {}
    for i in range(240):
        truth[i] = rng.choice(sorted(kinds))
        rows.append((i, _make(rng, kinds[truth[i]], rng.randrange(8, 40)), truth[i], f"h{i % 7}.x.{truth[i]}", "k"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string")
    return docs, truth, kinds, rng


def test_fusion_against_brute_force(spark):
    docs, truth, _, _ = _tables(spark)
    model = lid.train(docs)
    rows = lid.documents_as_rows(docs, [docs.doc_id])
    light = lid.score_texts(rows, model, "text", "scores", "top", False)
    n = len(model.languages) + 1
    got = {r.doc_id: r.p for r in lid.Evidence(light, n).posterior(light, {k: k for k in ("scores", "top", "declared", "host", "path")}, "p").collect()}
    data = light.collect()
    counts = {}
    for level in (lambda h: h, lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]):
        tally = {}
        for r in data:
            tally.setdefault(level(r.host), np.zeros(n))[r.top] += 1
        counts[level("a.b.c")] = (level, tally)
    whole = sum(counts["c"][1].values())
    languages = whole[:-1].sum()
    root = np.append((1 - lid.UNKNOWN) * (whole[:-1] + 1) / (languages + n - 1), lid.UNKNOWN)
    shrink = lambda c, p: (c + lid.KAPPA * p) / (c.sum() + lid.KAPPA)

    def likelihood(value, values):
        c = values[value]
        totals = sum(values.values())
        share = c.sum() / totals.sum()
        return np.log(np.append((c[:-1] + lid.KAPPA * share) / (totals[:-1] + lid.KAPPA), share))

    declared = {}
    for r in data:
        declared.setdefault(r.declared, np.zeros(n))[r.top] += 1
    for r in data:
        levels = [counts["a.b.c"], counts["b.c"], counts["c"]]
        own = levels[0][1][r.host] - np.eye(n)[r.top]
        up = shrink(levels[1][1][levels[1][0](r.host)], shrink(levels[2][1][levels[2][0](r.host)], root))
        logit = np.log(shrink(own, up) + 1e-12) + np.array(r.scores) + likelihood(r.declared, declared) + likelihood(r.host.split(".")[-1], levels[2][1])
        p = np.exp(logit - logit.max())
        assert np.allclose(got[r.doc_id], p / p.sum(), atol=1e-9)


def test_held_out_accuracy_and_rejection(spark):
    docs, truth, kinds, rng = _tables(spark)
    model = lid.train(docs.filter("doc_id % 2 = 0"), per_language=20)
    odd = lid.documents_as_rows(docs.filter("doc_id % 2 = 1"), [docs.doc_id]).selectExpr("doc_id", "text", "cast(null as string) declared", "cast(null as string) host", "path")
    out = lid.identify(odd, model, ["doc_id"]).collect()
    assert np.mean([r.language == truth[r.doc_id] and r.accepted for r in out]) >= 0.98
    junk = [(i, "".join(rng.choice("qwxyjhqwx") for _ in range(300)), None, None, None) for i in range(10)] + [(20, None, "aa", None, None), (21, "", "aa", "h1.x.aa", None), (22, "123 %%%", None, None, None)]
    rows = spark.createDataFrame(junk, "doc_id long, text string, declared string, host string, path string")
    judged = {r.doc_id: r for r in lid.identify(rows, model, ["doc_id"]).collect()}
    assert len(judged) == 13 and not any(r.accepted for r in judged.values())
    assert all(judged[i].language == "und" for i in range(10)) and judged[22].text_language is None


def test_edge_cases(spark):
    docs, truth, kinds, _ = _tables(spark)
    more = spark.createDataFrame([(None, "bacada fe gi", "aa", None, "k"), (900, None, "aa", "h0.x.aa", "k"), (901, "", None, None, "k"), (902, "kalami " * 60_000, None, "", "k"), (903, "kalami no", "zz", "h", "k"), (903, "kalami no", "zz", "h", "k")], docs.schema)
    both = docs.union(more)
    kept = lid.keep_identified(both)
    assert kept.columns == both.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[900] == ids[901] == 0 and ids[902] == 1 and ids[903] == 2 and ids[None] == 1 and sum(ids.values()) == 244
    assert lid.keep_identified(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://h0.x.aa/aa/1", "<html lang=aa><p>bacada fegibo</p>"), (None, None, None), (2, "::", "")], "page_id long, url string, html string")
    out = lid.corpus_languages(both, pages).collect()
    assert len(out) == both.count() + 3
    assert {(r.page_id, r.language, r.accepted) for r in out if r.page_id == 1} == {(1, "aa", True)}
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source")
    assert lid.keep_identified(unlabelled).count() == 0


def test_every_clean_document_stays(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    out = lid.corpus_languages(docs, pages).collect()
    of_docs = [r for r in out if r.doc_id is not None]
    assert np.mean([r.accepted for r in of_docs]) >= 0.995 and np.mean([r.language == r.declared for r in of_docs]) >= 0.99
    of_pages = [r for r in out if r.page_id is not None]
    assert np.mean([r.language == r.declared for r in of_pages]) >= 0.98


def test_no_language_is_lost_to_copies_or_counts(spark):
    rng = random.Random(4)
    letters = "bcdfghjklmnpqrstvwxz"
    rows = [(i, "un seul texte de tous", "fr-CA", "s", "k") for i in range(3000)]
    rows += [(i, _make(rng, letters[:5], 20), "en_GB", "s", "k") for i in range(300)]
    rows += [(i, _make(rng, letters[5:9], 20), "eng", "s", "k") for i in range(3)]
    rows += [(i, _make(rng, letters[i % 20] + letters[i // 20] + "hk", 20), f"q{chr(97 + i // 26)}{chr(97 + i % 26)}", "s", "k") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string")
    model = lid.train(docs)
    assert {"fr", "en"} < set(model.languages) and len(model.languages) == 82
    kept = Counter(r.lang for r in lid.keep_identified(docs).collect())
    assert kept["fr-CA"] == 3000 and kept["en_GB"] == 300 and len(kept) >= 82


def test_a_language_of_one_text_takes_no_junk(spark):
    docs, truth, kinds, rng = _tables(spark)
    rare = spark.createDataFrame([(999, _make(rng, "hjqwx", 12), "rare", "s", "k")], docs.schema)
    both = docs.union(rare)
    junk = [(i, "".join(rng.choice("ÀÉÎÕÜßñçøåþ") for _ in range(200)), None, None, None) for i in range(10)]
    rows = spark.createDataFrame(junk, "doc_id long, text string, declared string, host string, path string")
    model = lid.train(both)
    assert "rare" in model.languages and not any(r.accepted for r in lid.identify(rows, model, ["doc_id"]).collect())
    assert {r.doc_id for r in lid.keep_identified(both).collect()} == set(truth) | {999}


def test_trigram_likelihoods_against_counts(spark):
    docs, truth, _, _ = _tables(spark)
    model = lid.train(docs)
    rows = docs.collect()
    plain = {name: Counter() for name in sorted(set(truth.values()))}
    for r in rows:
        plain[r.lang].update(lid.trigrams(r.text)[0].tolist())
    used = len(set().union(*plain.values()))
    most = max(sum(c.values()) for c in plain.values())
    for j, name in enumerate(model.languages):
        total = sum(plain[name].values())
        for gram in set().union(*plain.values()):
            expected = np.log(plain[name][gram] / (total + used) + 0.5 / (most + used))
            assert abs(model.trigram[model.row[gram], j] - expected) < 1e-4


def test_registered_domains(spark):
    hosts = [("a.b.co.uk", "b.co.uk"), ("b.co.uk", "b.co.uk"), ("x.y.com", "y.com"), ("com", "com"), ("co.uk", "co.uk"), (None, None)]
    df = spark.createDataFrame(hosts, "host string, expected string")
    assert all(r.d == r.expected for r in df.select(lid.domain(df.host).alias("d"), "expected").collect())


def test_string_ids(spark):
    docs, _, _, _ = _tables(spark)
    docs = docs.selectExpr("concat('d', doc_id) doc_id", "text", "lang", "source")
    pages = spark.createDataFrame([("p1", "http://h0.x.aa/aa/1", "<html lang=aa><p>bacada fegibo</p>")], "page_id string, url string, html string")
    out = lid.corpus_languages(docs, pages).collect()
    assert {r.page_id for r in out} == {None, "p1"} and "d7" in {r.doc_id for r in out}
