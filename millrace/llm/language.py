"""Language identification by Bayesian fusion of evidence.

Text: character trigrams under a smoothed model of each language that has a labelled
text, trained on a bounded sample (``per_language`` distinct texts), against a background
of independent characters ("und": no known language).  A text may switch: each segment
of it comes from another of the models with a small probability, so a quoted passage or
a key costs its language little.  Log-likelihoods are tempered, since trigrams aren't
independent.

Declared language, address suffix and path: how often each value goes with each text
language, counted over all rows.  Host: the share of each language on the host,
smoothed towards its registered domain, that towards its top-level domain, and that
towards the whole corpus; a row's own vote is taken off its host's count.  All counts
are grouped aggregations; the posterior is the normalised product, in the JVM.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fresh, map_batches, quoted
from millrace.plans.lineage import working_table
from millrace.plans.shipping import share, worker_cache

BUCKETS = 1 << 17
PER_LANGUAGE = 400
TEMPER = 0.5
#: Trigrams of a segment, and the probability that it isn't of the text's language.
SEGMENT = 32
SWITCH = 0.05
SMOOTHING = 0.5
#: Weight of the parent level, in rows.
KAPPA = 20.0
#: Prior share of texts in no known language.
UNKNOWN = 0.02
ACCEPT = 0.5
#: Rows of an evidence table up to which it is broadcast.
BROADCAST_ROWS = 100_000
UND = "und"
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unk", "unknown", "none", "null", "mul", "zxx", "mis", "xx", "x")
#: Three-letter codes and their two-letter forms.
SHORT_CODES = dict(pair.split(":") for pair in "eng:en fra:fr fre:fr deu:de ger:de spa:es ita:it por:pt nld:nl dut:nl rus:ru zho:zh chi:zh jpn:ja kor:ko ara:ar pol:pl tur:tr swe:sv dan:da fin:fi nor:no ces:cs cze:cs ell:el gre:el hun:hu ron:ro rum:ro ukr:uk heb:he hin:hi vie:vi tha:th ind:id".split())
#: Second-level labels under which country suffixes register names.
REGISTRIES = ("co", "com", "org", "net", "gov", "edu", "ac", "or", "ne", "go", "gob", "gouv")


def _letters() -> np.ndarray:
    """Code point -> itself where it is a letter, else a space (0)."""
    cache = worker_cache()
    if "letters" not in cache:
        table = np.arange(0x30000, dtype=np.uint32)
        table[[not chr(i).isalpha() for i in range(0x30000)]] = 0
        cache["letters"] = table
    return cache["letters"]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, hash of the last character) of each trigram with a letter in it."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    code = np.where(raw < len(table), table[np.minimum(raw, len(table) - 1)], raw)
    kept = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]  # runs of spaces are one
    if len(kept) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = (kept[i : len(kept) - 2 + i].astype(np.int64) for i in range(3))
    use = (b != 0) | ((a != 0) & (c != 0))
    mixed = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0x7FFFFFFFFFFF
    return ((mixed ^ (mixed >> 17)) % BUCKETS)[use], (b % 65536)[use]


class Model:
    """Log-probabilities of trigrams in each language and of single characters.

    Only trigrams that occur have a row, so a model takes four bytes for each of them
    and each language.  A trigram that a language lacks is as unlikely in all of them,
    however few examples one has: else texts of no language would go to the rarest.
    """

    def __init__(self, languages: list[str], buckets: np.ndarray, counts: np.ndarray, single: np.ndarray) -> None:
        """``counts`` has a row for each of ``buckets`` and a column for each language."""
        self.languages = languages
        used = max(1, len(buckets))
        self.row = np.full(BUCKETS, used, np.int32)
        self.row[buckets] = np.arange(len(buckets), dtype=np.int32)
        sums = counts.sum(axis=0) if len(buckets) else np.zeros(len(languages))
        most = sums.max() if len(sums) else 0.0
        unseen = SMOOTHING / (most + SMOOTHING * 2 * used)
        self.trigram = np.full((used + 1, len(languages)), math.log(unseen), np.float32)
        if len(buckets):
            self.trigram[:-1] = np.log(counts / (sums + SMOOTHING * 2 * used) + unseen)
        single = single + 0.1
        # A trigram of independent characters: the third power of one character's share,
        # but not less than a quarter of an even share of the trigrams seen, or characters
        # foreign to all languages would pass for one of them.
        self.single = np.maximum(3 * np.log(single / single.sum()), -np.log(4.0 * used)).astype(np.float32)

    def scores(self, text: str) -> np.ndarray | None:
        """Tempered log-likelihoods, the background last; None without a trigram."""
        grams, middle = trigrams(text)
        if not len(grams):
            return None
        n = len(self.languages)
        total = np.zeros(n + 1)
        for at in range(0, len(grams), SEGMENT * 2048):
            part, own = grams[at : at + SEGMENT * 2048], middle[at : at + SEGMENT * 2048]
            cuts = np.arange(0, len(part), SEGMENT)
            sums = np.empty((len(cuts), n + 1))
            sums[:, :-1] = np.add.reduceat(self.trigram[self.row[part]], cuts, axis=0)
            sums[:, -1] = np.add.reduceat(self.single[own], cuts)
            most = sums.max(axis=1, keepdims=True)
            raised = np.exp(sums - most)
            rest = raised.sum(axis=1, keepdims=True) - raised
            total += (np.log((1 - SWITCH) * raised + SWITCH / max(n, 1) * rest + 1e-300) + most).sum(axis=0)
        total *= TEMPER
        return total - total.max()


def language_code(value: Column) -> Column:
    """A declared language as its primary subtag, three letters as two where both exist; null if it names none."""
    primary = F.regexp_extract(F.lower(F.trim(value)), r"^([^\s\-_;,.]+)", 1)
    folded = F.coalesce(F.create_map(*[F.lit(x) for pair in SHORT_CODES.items() for x in pair])[primary], primary)
    return F.when(~folded.isin(*NO_LANGUAGE), folded)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from the ``per_language`` distinct labelled texts with the least hashes in each language.

    Every language with a labelled text gets a model, whatever the number of its
    texts or copies.  Texts stay on the executors: the driver gets counts of trigrams.
    """
    known = docs.select(language_code(quoted(lang)).alias("lang"), quoted(text).alias("text")).filter("lang is not null and text is not null and trim(text) <> ''").withColumn("h", F.xxhash64("text", F.lit(5)))
    # Copies fall together on the map side, and of each language the least hashes are kept there too.
    distinct = known.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = working_table(distinct.select("lang", "h", F.row_number().over(order).alias("r")).filter(F.col("r") <= per_language).select("lang", "h"), "language-sample")
    texts = known.join(_sized(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held: dict[str, list[np.ndarray]] = {}
        for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams, middle = trigrams(t)
            counts = held.setdefault(name, [np.zeros(BUCKETS, np.int64), np.zeros(65536, np.int64)])
            counts[0] += np.bincount(grams, minlength=BUCKETS)
            counts[1] += np.bincount(middle, minlength=65536)
        parts = []
        for name, counts in held.items():
            for single, own in enumerate(counts):
                at = np.flatnonzero(own)
                parts.append(pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), single, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "single", "bucket", "n"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts and sum(p.num_rows for p in parts) else None

    found = map_batches(texts, run, "lang string, single int, bucket int, n long").groupBy("lang", "single", "bucket").agg(F.sum("n").alias("n")).toArrow()
    name, single, bucket, n = (found.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    languages, column = np.unique(name.astype(str), return_inverse=True)
    characters = np.bincount(bucket[single == 1], n[single == 1], 65536)
    buckets, row = np.unique(bucket[single == 0], return_inverse=True)
    counts = np.zeros((len(buckets), len(languages)))
    counts[row, column[single == 0]] = n[single == 0]
    return Model(languages.tolist(), buckets, counts, characters)


_SKIP = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", re.IGNORECASE | re.DOTALL)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)
_META = re.compile(r"<meta\b[^>]*?http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)
_ADDRESS = re.compile(r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?(?:/([A-Za-z]{2,3})(?=[/?#\-_]|$))?", re.IGNORECASE)


def page_text(html: str) -> str:
    """A page's visible text."""
    return entities.unescape(_TAG.sub(" ", _SKIP.sub(" ", html)))


def page_evidence(url: str | None, html: str | None) -> dict:
    """Text, declared language, host and path language of a page."""
    declared = (_LANG.search(html) or _META.search(html)) if html else None
    address = _ADDRESS.match(url) if url else None
    host = address[1].lower().strip(".") if address else None
    return {"text": None if html is None else page_text(html), "declared": declared[1].lower() if declared else None, "host": host or None, "path": address[2].lower() if address and address[2] else None}


def pages_as_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, text, declared, host, path) of web pages."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [page_evidence(u, h) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in ("text", "declared", "host", "path"))], names=["page_id", "text", "declared", "host", "path"])

    rows = pages.select(quoted(page_id).alias("page_id"), quoted(url).alias("url"), quoted(html).alias("html"))
    schema = T.StructType([T.StructField("page_id", rows.schema[0].dataType), *(T.StructField(k, T.StringType()) for k in ("text", "declared", "host", "path"))])
    return map_batches(rows, run, schema).withColumn("declared", language_code(F.col("declared")))


def score_texts(rows: DataFrame, model: Model, text: str, scores: str, top: str, keep_text: bool) -> DataFrame:
    """``rows`` with each text's scores (null without evidence) and best language (-1)."""
    shared = share(rows.sparkSession, model)
    names = rows.columns
    place = names.index(text)
    kept = [i for i in range(len(names)) if keep_text or i != place]
    schema = T.StructType([*(rows.schema.fields[i] for i in kept), T.StructField(scores, T.ArrayType(T.DoubleType())), T.StructField(top, T.IntegerType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared()
        found = [own.scores(t) if t else None for t in batch.column(place).to_pylist()]
        best = [-1 if f is None else int(f.argmax()) for f in found]
        columns = [batch.column(i) for i in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array([None if f is None else f.tolist() for f in found], pa.list_(pa.float64())), pa.array(best, pa.int32())], names=[*(names[i] for i in kept), scores, top])

    return map_batches(rows, run, schema)


def _tally(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, top, n): rows of each text language (background last) with each key."""
    return scored.filter(" and ".join(f"{k} is not null" for k in keys) + " and top >= 0").groupBy(*keys, "top").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _arrays(tally: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, c): a tally with an array of the ``n`` languages' counts for each key."""
    summed = tally.groupBy(*keys, "top").agg(F.sum("n").alias("n"))
    held = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("top", "n"))).alias("m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.col("m")[j], F.lit(0.0))).alias("c"))


def _shrink(counts: Column, parent: Column) -> Column:
    """Shares of a level, drawn towards its parent's by KAPPA rows."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda c, p: (c + KAPPA * p) / (total + KAPPA))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sized(table: DataFrame) -> DataFrame:
    """A broadcast table if it is small; a larger one is joined by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


class Evidence:
    """The counted tables, ready to join."""

    def __init__(self, scored: DataFrame, n: int) -> None:
        """``scored`` has columns declared, host, path, top."""
        self.n = n
        levels = scored.withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
        whole = scored.filter("top >= 0").groupBy("top").agg(F.count(F.lit(1)).alias("n")).collect()
        counts = [0.0] * n
        for r in whole:
            counts[r.top] = float(r.n)
        languages = sum(counts[:-1])
        # The background's prior is fixed; the languages share the rest, smoothed by one row each.
        self.corpus = [(1 - UNKNOWN) * (c + 1) / (languages + n - 1) for c in counts[:-1]] + [UNKNOWN]
        root = F.array(*[F.lit(x) for x in self.corpus])
        tally = working_table(_tally(levels, ["host", "domain", "suffix"]), "language-hosts")
        by_suffix = _arrays(tally, ["suffix"], n).select("suffix", _shrink(F.col("c"), root).alias("up"))
        by_domain = _arrays(tally, ["domain", "suffix"], n).join(by_suffix, "suffix").select("domain", _shrink(F.col("c"), F.col("up")).alias("up"))
        hosts = _arrays(tally, ["host", "domain"], n)
        self.hosts = working_table(hosts.join(by_domain, "domain").select(F.col("host").alias("key"), "c", "up", F.aggregate("c", F.lit(0.0), lambda a, x: a + x).alias("n")), "language-hosts")
        self.values = {name: working_table(self._likelihoods(working_table(_tally(levels, [name]), "language-" + name), name, n), "language-" + name) for name in ("declared", "suffix", "path")}

    @staticmethod
    def _likelihoods(tally: DataFrame, name: str, n: int) -> DataFrame:
        """log P(value | language), drawn towards P(value) by KAPPA rows."""
        totals = [0.0] * n
        for r in tally.groupBy("top").agg(F.sum("n").alias("n")).collect():
            totals[r.top] = r.n
        whole, each = max(sum(totals), 1.0), F.array(*[F.lit(x) for x in totals])
        counts = _arrays(tally, [name], n).select(F.col(name).alias("key"), "c", F.aggregate("c", F.lit(0.0), lambda a, x: a + x).alias("own"))
        # The background says nothing of what is declared.
        share = F.col("own") / whole
        return counts.select("key", F.transform("c", lambda x, j: F.when(j == n - 1, F.log(share)).otherwise(F.log((x + KAPPA * share) / (F.get(each, j) + KAPPA)))).alias("l"))

    def posterior(self, rows: DataFrame, columns: dict[str, str], out: str) -> DataFrame:
        """``rows`` with the array ``out`` of posterior probabilities.

        ``columns`` names the columns of scores, top, declared, host and path.
        """
        n, names = self.n, columns
        key, c, up, rows_of_host, *logs = fresh(rows, "key", "c", "up", "n", "l0", "l1", "l2")
        host = F.col(names["host"])
        joined = rows.join(_sized(self.hosts.select(F.col("key").alias(key), F.col("c").alias(c), F.col("up").alias(up), F.col("n").alias(rows_of_host))), host == F.col(key), "left").drop(key)
        values = {"declared": F.col(names["declared"]), "suffix": suffix(host), "path": F.col(names["path"])}
        for log, (name, value) in zip(logs, values.items()):
            table = self.values[name].select(F.col("key").alias(key), F.col("l").alias(log))
            joined = joined.join(_sized(table), value == F.col(key), "left").drop(key)
        root = F.array(*[F.lit(x) for x in self.corpus])
        top, scores = F.col(names["top"]), F.col(names["scores"])

        def logit(j: Column) -> Column:
            own = F.greatest(F.get(c, j) - (top == j).cast("double"), F.lit(0.0))
            prior = F.coalesce((own + KAPPA * F.get(up, j)) / (F.col(rows_of_host) - (top >= 0).cast("double") + KAPPA), F.get(root, j))
            parts = [F.coalesce(F.get(x, j), F.lit(0.0)) for x in (scores, *logs)]
            return F.log(prior + 1e-12) + parts[0] + parts[1] + parts[2] + parts[3]

        logits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), logit)
        raised = _let(logits, lambda t: _let(F.array_max(t), lambda m: F.transform(t, lambda x: F.exp(x - m))))
        shares = _let(raised, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda whole: F.transform(e, lambda x: x / whole)))
        return joined.withColumn(out, shares).drop(c, up, rows_of_host, *logs)


def suffix(host: Column) -> Column:
    """Last label of a host's name."""
    return F.when(host.isNotNull(), F.substring_index(host, ".", -1))


def domain(host: Column) -> Column:
    """The registered name of a host: its last two labels, three under a country's registry (``co.uk``)."""
    registry = host.rlike(r"(^|\.)(" + "|".join(REGISTRIES) + r")\.[a-z]{2}$")
    return F.when(host.isNotNull(), F.when(registry, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)))


def identify(rows: DataFrame, model: Model, carried: list[str], accept: float = ACCEPT) -> DataFrame:
    """Language of rows (carried columns, text, declared, host, path).

    Returns the carried columns and ``language``, ``probability``, ``text_language``
    (by text alone; null without a letter), ``declared``, ``host``, ``accepted``.  A row is
    accepted if its language is known, its text has a letter and its probability is ``accept`` at least.
    """
    light = working_table(score_texts(rows.select(*carried, "text", "declared", "host", "path"), model, "text", "scores", "top", False), "language-scores")
    n = len(model.languages) + 1
    evidence = Evidence(light, n)
    done = evidence.posterior(light, {k: k for k in ("scores", "top", "declared", "host", "path")}, "p")
    names = F.array(*[F.lit(x) for x in [*model.languages, UND]])
    at = F.array_position("p", F.array_max("p")).cast("int")
    done = done.withColumn("at", at)
    language = F.element_at(names, F.col("at"))
    probability = F.element_at("p", F.col("at"))
    return done.select(*carried, language.alias("language"), F.round(probability, 6).alias("probability"), F.when(F.col("top") >= 0, F.element_at(names, F.col("top") + 1)).alias("text_language"), "declared", "host", ((language != UND) & (probability >= accept) & (F.col("top") >= 0)).alias("accepted"))


def documents_as_rows(docs: DataFrame, carried: list[Column], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents as rows: their stated language is declared, their source the host."""
    return docs.select(*carried, quoted(text).alias("text"), language_code(quoted(lang)).alias("declared"), F.lower(quoted(source)).alias("host"), F.lit(None).cast("string").alias("path"))


def corpus_languages(docs: DataFrame, pages: DataFrame, per_language: int = PER_LANGUAGE, accept: float = ACCEPT) -> DataFrame:
    """Languages of all documents and all pages, one row each.

    Columns: doc_id (null for a page), page_id (null for a document), language,
    probability, text_language, declared, host, accepted.  Defined results: a null
    or empty text, or one without a letter, is judged by its other evidence and not
    accepted; null ids, addresses and declarations leave that evidence out; equal
    probabilities go to the first language by name; repeated rows repeat their
    result; with no labelled document nothing is accepted; empty tables give no
    rows; other columns are ignored.  Texts are read whole.
    """
    model = train(docs, per_language=per_language)
    none = {c: F.lit(None).cast(d.schema[c].dataType).alias(c) for c, d in (("doc_id", docs), ("page_id", pages))}
    a = documents_as_rows(docs, [F.col("doc_id"), none["page_id"]])
    b = pages_as_rows(pages).select(none["doc_id"], "page_id", "text", "declared", "host", "path")
    return identify(a.unionByName(b), model, ["doc_id", "page_id"], accept)


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", per_language: int = PER_LANGUAGE, accept: float = ACCEPT) -> DataFrame:
    """The documents whose language is accepted, all columns kept.

    Defined results: null and empty texts and those without a letter go; a null
    ``lang`` or ``source`` leaves that evidence out; equal probabilities go to the
    first language by name, and a tie with no language keeps the document; repeated
    rows are judged alike; with no labelled document none stays; an empty table gives
    an empty one; clashing names of other columns are harmless.  Texts are read whole,
    once, and lie beside their scores until the evidence is counted.
    """
    model = train(docs, text, lang, per_language)
    n = len(model.languages) + 1
    declared, host, path, scores, top, p = fresh(docs, "declared", "host", "path", "scores", "top", "p")
    tagged = docs.withColumn(declared, language_code(quoted(lang))).withColumn(host, F.lower(quoted(source))).withColumn(path, F.lit(None).cast("string"))
    scored = working_table(score_texts(tagged, model, text, scores, top, True), "language-scores")
    evidence = Evidence(scored.select(F.col(declared).alias("declared"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(top).alias("top")), n)
    done = evidence.posterior(scored.filter(F.col(top) >= 0), {"scores": scores, "top": top, "declared": declared, "host": host, "path": path}, p)
    kept = _let(F.col(p), lambda q: F.array_max(q) == F.array_max(F.slice(q, 1, max(n - 1, 1)))) if n > 1 else F.lit(False)
    return done.filter(kept & (F.array_max(F.col(p)) >= accept)).select(*[quoted(c) for c in docs.columns])
