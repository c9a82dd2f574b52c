"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded, seeded sample of the labelled documents (``per_class`` of
either class; texts that repeat count once).  Terms are words, their stems of four
to six letters, and bursts of a stem (two, three or five of its words in a text, as
inflected insults come), chosen by chi-square against the labels.  Document
frequencies are counted over all documents.

The examples lie in blocks of an inverted index that knows each term's greatest
weight in each block.  For a query the sum of those is a bound on every cosine in
the block; blocks are opened from the greatest bound down until it falls below the
k-th cosine found, so the k nearest are exact.  Cosine-weighted votes are turned
into a probability by a logistic fit on leave-one-out votes, weighted to the share
of toxic rows among all labels.

Only the index (bounded by ``per_class`` and ``max_terms``) goes to the workers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, quoted, words
from millrace.plans.shipping import share, worker_cache

PER_CLASS = 2000
K = 15
BLOCK = 64
MIN_CHI2 = 30.0
MIN_EXAMPLES = 5
MAX_TERMS = 4096
STEMS = (4, 5, 6)
BURSTS = (2, 3, 5)
THRESHOLD = 0.5


def term_names(word: str) -> list[str]:
    """A word's terms: itself and its stems."""
    return ["=" + word, *(f"{n}{word[:n]}" for n in STEMS if len(word) >= n)]


def all_terms(text: str) -> set[str]:
    """Every term of a text, bursts included."""
    stems: Counter = Counter(t for w in words(text) for t in term_names(w))
    return set(stems) | {f"{t}*{n}" for t, c in stems.items() if t[0] != "=" for n in BURSTS if c >= n}


class TermIds(dict):
    """word -> its base terms among those chosen, filled as words come up."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.known = len(vocabulary)
        self.bases: dict[str, int] = {}
        self.meanings: list[list[tuple[int, int]]] = []
        for name, i in sorted(vocabulary.items()):
            base, star, least = (name, "", "1") if name[0] == "=" else name.partition("*")
            at = self.bases.setdefault(base, len(self.meanings))
            if at == len(self.meanings):
                self.meanings.append([])
            self.meanings[at].append((int(least) if star else 1, i))

    def __missing__(self, word: str) -> tuple:
        found = tuple(self.bases[t] for t in term_names(word) if t in self.bases)
        if len(self) > 200_000:
            self.clear()
        self[word] = found
        return found


def term_counts(text: str, ids: TermIds) -> dict[int, int]:
    """Frequency of each chosen term in a whole text; a burst has frequency 1."""
    counts: Counter = Counter()
    for found in filter(None, map(ids.__getitem__, words(text))):
        counts.update(found)
    return {i: (n if least == 1 else 1) for b, n in counts.items() for least, i in ids.meanings[b] if n >= least}


def choose_terms(texts: list[str], toxic: list[int], min_chi2: float = MIN_CHI2, least: int = MIN_EXAMPLES, most: int = MAX_TERMS) -> list[str]:
    """Terms whose presence depends on the label, strongest first."""
    seen = (Counter(), Counter())
    for text, label in zip(texts, toxic):
        seen[label].update(all_terms(text))
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    scored = []
    for t in seen[1].keys() | seen[0].keys():
        a, b = seen[1][t], seen[0][t]
        if a + b < least:
            continue
        c, d = n1 - a, n0 - b
        below = (a + b) * (c + d) * (a + c) * (b + d)
        chi2 = (n1 + n0) * (a * d - b * c) ** 2 / below if below else 0.0
        if chi2 >= min_chi2:
            scored.append((-chi2, t))
    return [t for _, t in sorted(scored)[:most]]


class Index:
    """Block-max inverted index of example vectors."""

    def __init__(self, terms: list[str], idf: np.ndarray, vectors: list[dict[int, float]], doc_ids: list, toxic: list[int], block: int = BLOCK) -> None:
        # Examples of one leading term lie together, which keeps the blocks' bounds low.
        order = sorted(range(len(vectors)), key=lambda i: (min(vectors[i], key=lambda t: (-vectors[i][t], t)), i))
        self.terms, self.idf, self.block = terms, idf, block
        self.doc_ids = [doc_ids[i] for i in order]
        self.toxic = [toxic[i] for i in order]
        self.blocks = -(-len(order) // block)
        postings: dict[int, list[tuple[int, float]]] = {}
        for place, i in enumerate(order):
            for t, w in vectors[i].items():
                postings.setdefault(t, []).append((place, w))
        self.postings: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        self.most: dict[int, np.ndarray] = {}
        for t, own in postings.items():
            most, by_block = np.zeros(self.blocks), {}
            for place, w in own:
                by_block.setdefault(place // block, []).append((place % block, w))
                most[place // block] = max(most[place // block], w)
            self.most[t] = most
            self.postings[t] = {b: (np.array([p for p, _ in e]), np.array([w for _, w in e])) for b, e in by_block.items()}
        self.base = 0.0
        self.slope = (0.0, 0.0)

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        """Unit TF-IDF vector; empty if no chosen term occurs."""
        raw = {t: (1 + math.log(n)) * float(self.idf[t]) for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def nearest(self, q: dict[int, float], k: int = K, own: object = None) -> list[tuple[float, int]]:
        """The k greatest (cosine, place), none of document ``own``; ties: the first place."""
        known = [(t, w) for t, w in sorted(q.items()) if t in self.most]
        if not known:
            return []
        bound = np.zeros(self.blocks)
        for t, w in known:
            bound += w * self.most[t]
        heap: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(heap) == k and bound[b] < heap[0][0] - 1e-9):
                break
            scores = np.zeros(self.block)
            for t, w in known:
                found = self.postings[t].get(b)
                if found is not None:
                    scores[found[0]] += w * found[1]
            for p in np.flatnonzero(scores > 0).tolist():
                place = b * self.block + p
                if own is not None and self.doc_ids[place] == own:
                    continue
                entry = (round(float(scores[p]), 9), -place)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        return [(s, -p) for s, p in sorted(heap, reverse=True)]

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        """Cosine-weighted share of toxic neighbours; None without a neighbour."""
        total = sum(s for s, _ in near)
        return sum(s for s, p in near if self.toxic[p]) / total if total > 0 else None

    def probability(self, vote: float | None) -> float:
        if vote is None:
            return self.base
        a, b = self.slope
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * vote + b))))


def calibrate(votes: list[float], toxic: list[int], weights: list[float]) -> tuple[float, float]:
    """Weighted logistic fit of labels on votes, with a light prior on the slope."""
    x, y, w = np.array(votes), np.array(toxic, float), np.array(weights)
    a, b = 4.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 0.01 * a, (w * (p - y)).sum() + 0.01 * b])
        h = w * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def document_frequencies(docs: DataFrame, text: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each chosen term occurs, and their number."""
    n = len(vocabulary)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, ids = np.zeros(n + 1, dtype=np.int64), 0, TermIds(vocabulary)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t is not None:
                    rows += 1
                    for f in term_counts(t, ids):
                        total[f] += 1
        total[n] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    found = docs.select(quoted(text).alias("text")).mapInArrow(partial, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n + 1, dtype=np.int64)
    for r in found:  # bounded by the vocabulary
        counts[r.term] = r.n
    return counts[:n], int(counts[n])


def examples(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, per_class: int) -> tuple[list[tuple[int, str, int]], float | None]:
    """The bounded sample of (doc_id, text, toxic), and the toxic share of all labels."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    share = clean.agg(F.avg("toxic")).first()[0]
    ranked = [clean.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = ranked[0].union(ranked[1])
    texts = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).filter("text is not null")
    # At most 2 * per_class ids, whatever the size of the tables.
    rows = texts.join(F.broadcast(chosen), "doc_id").collect()
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.text)):
        if r.text not in seen:
            seen.add(r.text)
            out.append((r.doc_id, r.text, r.toxic))
    return out, share


def build(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, k: int = K) -> Index | float | None:
    """The calibrated index; a bare toxic share where the labels can't separate."""
    rows, share = examples(docs, labels, doc_id, text, per_class)
    toxic = [r[2] for r in rows]
    if not rows or len(set(toxic)) < 2:
        return share
    terms = choose_terms([r[1] for r in rows], toxic)
    if not terms:
        return share
    vocabulary = {t: i for i, t in enumerate(terms)}
    df, n = document_frequencies(docs, text, vocabulary)
    idf = np.log((n + 1) / (df + 1)) + 1
    ids = TermIds(vocabulary)
    probe = Index(terms, idf, [], [], [])
    vectors = [probe.vector(term_counts(r[1], ids)) for r in rows]
    with_terms = [i for i, v in enumerate(vectors) if v]
    index = Index(terms, idf, [vectors[i] for i in with_terms], [rows[i][0] for i in with_terms], [toxic[i] for i in with_terms])
    weight = {1: share / (sum(toxic) / len(toxic)), 0: (1 - share) / (1 - sum(toxic) / len(toxic))}
    votes, truth, weights, bare = [], [], [], [1e-3, 1e-3]
    for r, v in zip(rows, vectors):
        vote = index.vote(index.nearest(v, k, r[0])) if v else None
        if vote is None:
            bare[r[2]] += weight[r[2]]
        else:
            votes.append(vote)
            truth.append(r[2])
            weights.append(weight[r[2]])
    index.base = bare[1] / (bare[0] + bare[1])
    index.slope = calibrate(votes, truth, weights) if votes else (4.0, -2.0)
    return index


SCHEMA = "doc_id long, score double, toxic boolean, neighbours array<struct<doc_id:long,cosine:double,toxic:int>>"


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic, neighbours) of every document.

    ``score`` is the calibrated probability, ``neighbours`` the evidence, nearest
    first.  Defined results: a null text has a null score and verdict; a text
    without a chosen term (an empty one too) has the toxic share of such examples
    and no neighbours; a document is never its own neighbour; equal cosines go by
    place in the index; null doc_ids and repeated rows are scored as they are; with
    no labels the score is null, with one class the share of it; an empty table
    gives no rows; other columns are ignored.  Texts are read whole.
    """
    model = build(docs, labels, doc_id, text, per_class, k)
    shared = share(docs.sparkSession, model)
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("toxic", pa.bool_()), ("neighbours", pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared()
        plain = not hasattr(index, "postings")  # classes sent by value differ by message
        cache = worker_cache()
        if not plain and cache.get("toxic_for") is not index:
            cache["toxic_for"], cache["toxic_ids"] = index, TermIds({t: i for i, t in enumerate(index.terms)})
        ids = cache.get("toxic_ids")
        scores, near = [], []
        own_ids = batch.column(0).to_pylist()
        for d, t in zip(own_ids, batch.column(1).to_pylist()):
            if t is None or plain:
                scores.append(None if t is None else index)
                near.append([])
                continue
            counts = term_counts(t, ids)
            found = index.nearest(index.vector(counts), k, d) if counts else []
            scores.append(index.probability(index.vote(found)))
            near.append([{"doc_id": index.doc_ids[p], "cosine": s, "toxic": index.toxic[p]} for s, p in found])
        verdict = [None if s is None else s >= threshold for s in scores]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(verdict, pa.bool_()), pa.array(near, arrow.field("neighbours").type)], schema=arrow)

    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    return map_batches(rows, run, SCHEMA)
