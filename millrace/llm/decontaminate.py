"""Benchmark decontamination with BM25 and block-max pruning.

Test items are cut into segments of about ``SEGMENT`` words and indexed with BM25
impacts, each divided by the segment's score for itself, so that one threshold holds
for all.  Every document is read whole as passages of two ``SEGMENT``s that overlap
by one; every passage is a query.  Its terms' postings name blocks of segments and
the greatest impact in each; where their sum stays below the pivot the block is
skipped, and only the rest is scored exactly, so nothing above the threshold is
missed.  A hit then has to hold the item's question and its answer, as word trigrams,
and a short item word for word.

The index goes to the workers in shards of ``SHARD_SEGMENTS`` at most (some 40 MB),
with term statistics of all items; only a benchmark of more words than four million
means another pass over the documents, and none a larger broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import map_batches, quoted, words
from millrace.plans.lineage import working_table
from millrace.plans.shipping import share

SEGMENT = 64
SHARD_SEGMENTS = 65_536
BLOCK = 8
#: Share of a segment's score, in its commonest terms, that has no postings.
REST = 0.3
THRESHOLD = 0.6
OVERLAP = 0.5
#: An item of fewer words than LEAST_WORDS can't be told from chance and is held by
#: nothing; one of fewer than EXACT_WORDS must be there word for word.
LEAST_WORDS = 6
EXACT_WORDS = 12
K1, B = 1.2, 0.75
#: Words of documents that are scored in one go.
CHUNK_WORDS = 200_000

_ANSWER = re.compile(r"(?:^|[\n.?!]\s*)(?:answer|a|réponse|antwort|respuesta)\s*[:=]\s*", re.IGNORECASE)


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer.

    The answer follows the last answer mark; without one it is the last sentence,
    and of a single sentence the last quarter of the words.
    """
    marks = list(_ANSWER.finditer(text))
    if marks and words(text[: marks[-1].start()]) and words(text[marks[-1].end() :]):
        return words(text[: marks[-1].start()]), words(text[marks[-1].end() :])
    sentences = [w for w in map(words, re.split(r"[.?!\n]+", text)) if w]
    if len(sentences) > 1:
        return sum(sentences[:-1], []), sentences[-1]
    whole = sentences[0] if sentences else []
    cut = len(whole) - max(1, len(whole) // 4) if len(whole) > 1 else 0
    return whole[:cut], whole[cut:]


def segments(item: list[str], size: int = SEGMENT) -> list[list[str]]:
    """An item's words in runs of ``size``; a short rest joins the run before."""
    out = [item[i : i + size] for i in range(0, len(item), size)]
    if len(out) > 1 and len(out[-1]) < size // 4:
        out[-2:] = [out[-2] + out[-1]]
    return out


def impacts(segment: list[str], df: dict[str, int], n: int, average: float) -> dict[str, float]:
    """BM25 weight of each term of a segment, as a share of the segment's score for itself."""
    tf = Counter(segment)
    norm = K1 * (1 - B + B * len(segment) / average)
    raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
    total = sum(raw.values())
    return {t: v / total for t, v in raw.items()}


class Index:
    """Inverted index of a shard of segments: block postings of their telling terms, and the segments themselves.

    A segment's commonest terms, up to ``REST`` of its score, have no postings: what is
    left must then come to ``threshold`` less that rest, which is the pivot condition of
    WAND with the lists in a fixed order.  Postings name blocks of ``BLOCK`` segments
    with the greatest impact in them.  Its size follows the segments' words alone.
    """

    def __init__(self, items: list[tuple[object, str]], df: dict[str, int], n: int, average: float, threshold: float) -> None:
        self.items, self.threshold = items, threshold
        self.parts = [question_answer(t) for _, t in items]
        made, self.owner = [], []
        for i, (_, text) in enumerate(items):
            for seg in segments(words(text)):
                self.owner.append(i)
                made.append(impacts(seg, df, n, average))
        self.ids = {t: k for k, t in enumerate(sorted({t for s in made for t in s}))}
        self.blocks = -(-len(made) // BLOCK)
        self.need = np.full(self.blocks, np.inf)
        self.terms = np.array([self.ids[t] for s in made for t in s], np.int32)
        self.weights = np.array([v for s in made for v in s.values()])
        self.begin = np.concatenate([[0], np.cumsum([len(s) for s in made])]).astype(np.int64)
        most: dict[tuple[int, int], float] = {}
        for j, s in enumerate(made):
            rest = 0.0
            for t, v in sorted(s.items(), key=lambda e: (e[1], e[0])):  # the least telling first
                if rest + v <= REST:
                    rest += v
                    continue
                key = (self.ids[t], j // BLOCK)
                most[key] = max(most.get(key, 0.0), v)
            self.need[j // BLOCK] = min(self.need[j // BLOCK], threshold - rest)
        listed = sorted(most)
        self.list_begin = np.searchsorted(np.array([t for t, _ in listed], np.int64), np.arange(len(self.ids) + 1))
        self.list_block = np.array([b for _, b in listed], np.int64)
        self.list_most = np.array([most[k] for k in listed])

    def passages(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, float]]:
        """(document, half-window, segment, score) of every passage and segment at or above the threshold."""
        if not self.ids:
            return
        get, v = self.ids.get, len(self.ids)
        halves = [max(1, -(-len(d) // SEGMENT)) for d in docs]
        starts = np.concatenate([[0], np.cumsum(halves)])
        keys = []
        for at, d in zip(starts.tolist(), docs):
            ids = np.fromiter(map(get, d, repeat(-1)), np.int64, len(d))
            known = np.flatnonzero(ids >= 0)
            keys.append((at + known // SEGMENT) * v + ids[known])
        distinct = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        if not len(distinct):
            return
        half, term = distinct // v, distinct % v
        begin = np.searchsorted(half, np.arange(starts[-1] + 1))
        end = np.append(begin[1:], len(half))
        follows = np.ones(starts[-1], bool)
        follows[starts[1:] - 1] = False  # a document's last half stands alone
        # Each term's postings, summed by half and block: bounds on the segments' scores.
        count = self.list_begin[term + 1] - self.list_begin[term]
        place = np.repeat(self.list_begin[term] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        cell, inverse = np.unique(np.repeat(half, count) * self.blocks + self.list_block[place], return_inverse=True)
        if not len(cell):
            return
        bound = np.bincount(inverse, self.list_most[place], len(cell))
        # A passage is a half and the one after it.
        back = cell - self.blocks
        shared = (back >= 0) & follows[np.maximum(back // self.blocks, 0)]
        both, inverse = np.unique(np.concatenate([cell, back[shared]]), return_inverse=True)
        bound = np.bincount(inverse, np.concatenate([bound, bound[shared]]), len(both))
        opened = both[bound >= self.need[both % self.blocks] - 1e-9]
        mark, last, doc = np.zeros(v), -1, 0
        for h, b in zip((opened // self.blocks).tolist(), (opened % self.blocks).tolist()):
            if h != last:
                mark[:] = 0
                mark[term[begin[h] : end[h + 1] if follows[h] else end[h]]] = 1
                last, doc = h, int(np.searchsorted(starts, h, side="right")) - 1
            first, stop = b * BLOCK, min((b + 1) * BLOCK, len(self.owner))
            a, z = self.begin[first], self.begin[stop]
            scores = np.add.reduceat(self.weights[a:z] * mark[self.terms[a:z]], self.begin[first:stop] - a)
            for j in np.flatnonzero(scores >= self.threshold).tolist():
                yield doc, h - int(starts[doc]), first + j, float(scores[j])

    def verified(self, doc: list[str], half: int, item: int) -> tuple[float, float]:
        """Shares of the question's and the answer's trigrams near a passage; 0 where a short item isn't there whole."""
        question, answer = self.parts[item]
        around = len(question) + len(answer)
        region = doc[max(0, half * SEGMENT - around) : (half + 2) * SEGMENT + around]
        if around < EXACT_WORDS and (around < LEAST_WORDS or not contiguous(question + answer, region)):
            return 0.0, 0.0
        return overlap(question, region), overlap(answer, region)


def contiguous(part: list[str], region: list[str]) -> bool:
    """Whether a run of words occurs in a region."""
    return any(region[i : i + len(part)] == part for i, w in enumerate(region) if w == part[0])


def overlap(part: list[str], region: list[str]) -> float:
    """Share of a part's trigrams (or its whole, if shorter) in a region; 0 for an empty part."""
    n = min(3, len(part))
    if not n:
        return 0.0
    grams = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    there = set(zip(*(region[i:] for i in range(n))))
    return len(grams & there) / len(grams)


def find(index: Index, docs: list[list[str]], least: float) -> dict[int, dict[int, tuple]]:
    """For each document its verified items: (score, half, question share, answer share) of the best passage."""
    found: dict[int, dict[int, tuple]] = defaultdict(dict)
    tried: dict[tuple, tuple] = {}
    for d, half, segment, score in index.passages(docs):
        item = index.owner[segment]
        key = (d, half, item)
        if key not in tried:
            tried[key] = index.verified(docs[d], half, item)
        q, a = tried[key]
        if q >= least and a >= least:
            entry = (score, -half, q, a)
            if item not in found[d] or entry > found[d][item]:
                found[d][item] = entry
    return {d: own for d, own in found.items() if own}


def in_chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Rows and their words, so many at a time that they hold about ``CHUNK_WORDS``."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        w = words(t) if t else []
        if w:
            rows.append(i)
            held.append(w)
            size += len(w)
            if size >= CHUNK_WORDS:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def build(items: DataFrame, item_id: str, text: str, shard_segments: int, threshold: float) -> Iterator[Index]:
    """Index shards over every item that has a word, one at a time."""
    rows = items.select(quoted(item_id).alias("item_id"), quoted(text).alias("text")).filter("text is not null")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {"item_id": [], "text": [], "sizes": [], "terms": []}
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = segments(words(t))
            if own:
                out["item_id"].append(i)
                out["text"].append(t)
                out["sizes"].append([len(s) for s in own])
                out["terms"].append([w for s in own for w in sorted(set(s))])
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("item_id", batch.schema.field(0).type), ("text", pa.string()), ("sizes", pa.list_(pa.int32())), ("terms", pa.list_(pa.string()))]))

    made = working_table(map_batches(rows, cut, f"item_id {rows.schema[0].dataType.simpleString()}, text string, sizes array<int>, terms array<string>"), "benchmark")
    n, total = made.select(F.explode("sizes").alias("s")).agg(F.count(F.lit(1)), F.sum("s")).first()
    if not n:
        return
    shards = -(-n // shard_segments)
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("text", "item_id"), F.lit(shards)))
    counts = made.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    for s in range(shards):
        own = dealt.filter(F.col("shard") == s)
        needed = own.select(F.explode("terms").alias("term")).distinct()
        df = {r.term: r.n for r in counts.join(needed, "term").collect()}
        listed = sorted((tuple(r) for r in own.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        if listed:
            yield Index(listed, df, n, total / n, threshold)


SCHEMA = "passage int, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, least: float = OVERLAP, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """Every document and test item it holds: (doc_id, item_id, passage, score, question_overlap, answer_overlap).

    ``passage`` is the word at which the best passage starts (ties: the first).
    Defined results: null and empty texts hold nothing, items of fewer than LEAST_WORDS
    words are held by nothing, and those under EXACT_WORDS only where they stand word for word; null ids are carried; a repeated document repeats its rows and a
    repeated item its own; empty tables give no rows; other columns are ignored.
    Texts are read whole.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    item_type = items.select(quoted(item_id)).schema[0].dataType
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, item_id {item_type.simpleString()}, {SCHEMA}"
    ids_of_items = to_arrow_type(item_type)
    parts = []
    for index in build(items, item_id, item_text, shard_segments, threshold):
        shared = share(docs.sparkSession, index)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            own, ids = shared(), batch.column(0).to_pylist()
            arrow = pa.schema([("doc_id", batch.schema.field(0).type), ("item_id", ids_of_items), ("passage", pa.int32()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
            out: list[tuple] = []
            for at, held in in_chunks(batch.column(1).to_pylist()):
                for d, hits in find(own, held, least).items():
                    out += [(ids[at[d]], own.items[i][0], -half * SEGMENT, score, q, a) for i, (score, half, q, a) in sorted(hits.items())]
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)

        parts.append(map_batches(rows, run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, least: float = OVERLAP, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """The documents that hold no test item, all columns kept.

    Defined results: null and empty texts stay; ids aren't read, so null, equal or
    repeated ones change nothing and repeated rows are judged alike; an empty table
    gives an empty one and an empty benchmark drops nothing; clashing names of other
    columns are harmless.  Texts are read whole, in passages.
    """
    place = docs.columns.index(text)
    for index in build(items, item_id, item_text, shard_segments, threshold):
        shared = share(docs.sparkSession, index)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            for at, held in in_chunks(batch.column(place).to_pylist()):
                for d in find(shared(), held, least):
                    keep[at[d]] = False
            return batch.filter(pa.array(keep))

        docs = map_batches(docs, run, docs.schema)
    return docs
