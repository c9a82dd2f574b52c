"""Language-model scores by Ziv-Merhav cross-parsing.

Reference text is every document labelled as good, copies once.  A document is factored
against all of it but its own text (and so its exact copies'), by a suffix array in the
shared folder (``suffixes``).  With ``shard_chars`` the reference text is dealt by
content hash to shards of about so many characters instead and a document meets one
of them that its own content cannot be in: an estimate in memory of bounded size, which
no query uses.

Over word tokens the index gives the longest match at each position; greedy
phrases count c.  With n words and N reference words, ``cross_bits`` = c log2(N) / n
is the cross entropy a word, and ``relative_entropy`` takes off the document's own
entropy by incremental (LZ78) parsing, k log2(k) / n for its k phrases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import suffixes
from millrace.llm.common import quoted, words

#: Characters of documents that one group scores, at most about.
GROUP_CHARS = 8_000_000
#: Words of documents that are parsed at once, or one document: more share a search for their word pairs, but take memory.
WORDS_AT_ONCE = 1_300_000
#: Ids of good documents up to which they are broadcast.
BROADCAST_IDS = 8_000_000


class SuffixAutomaton:
    """Suffix automaton of several sequences; no match spans two of them."""

    def __init__(self, sequences: Iterator[list]) -> None:
        self.next: list[dict] = [{}]
        link, length = [-1], [0]
        nxt = self.next
        for sequence in sequences:
            last = 0
            for w in sequence:
                have = nxt[last].get(w)
                if have is not None:  # seen after another sequence's prefix
                    if length[have] == length[last] + 1:
                        last = have
                        continue
                    copy = len(nxt)
                    nxt.append(nxt[have].copy())
                    length.append(length[last] + 1)
                    link.append(link[have])
                    link[have] = copy
                    p = last
                    while p >= 0 and nxt[p].get(w) == have:
                        nxt[p][w] = copy
                        p = link[p]
                    last = copy
                    continue
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    if length[q] == length[p] + 1:
                        link[new] = q
                    else:
                        copy = len(nxt)
                        nxt.append(nxt[q].copy())
                        length.append(length[p] + 1)
                        link.append(link[q])
                        link[q] = link[new] = copy
                        while p >= 0 and nxt[p].get(w) == q:
                            nxt[p][w] = copy
                            p = link[p]
                last = new

    def phrases(self, sequence: list) -> int:
        """Greedy longest matches that make up ``sequence``; an unknown symbol is one."""
        count, at, n, nxt = 0, 0, len(sequence), self.next
        root = nxt[0]
        while at < n:
            here = root.get(sequence[at])
            at += 1
            count += 1
            while here is not None and at < n:
                here = nxt[here].get(sequence[at])
                if here is not None:
                    at += 1
        return count


def lz78(sequence: list) -> int:
    """Phrases of incremental parsing."""
    seen: dict = {}
    node, count, made = 0, 0, 0
    for w in sequence:
        key = (node, w)
        nxt = seen.get(key)
        if nxt is None:
            made += 1
            seen[key] = made
            count += 1
            node = 0
        else:
            node = nxt
    return count + (node != 0)


def bits(phrases: int, own: int, n: int, reference: int) -> tuple[float, float]:
    """(cross_bits, relative_entropy) a word."""
    cross = phrases * math.log2(max(reference, 2)) / n
    return cross, cross - own * math.log2(max(own, 2)) / n


SCHEMA = "doc_id long, n_words int, phrases int, self_phrases int, cross_bits double, relative_entropy double"


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int32()), ("phrases", pa.int32()), ("self_phrases", pa.int32()), ("cross_bits", pa.float64()), ("relative_entropy", pa.float64())])


def placement(shards: int, content, row):
    """(reference shard, scoring shard) columns; never the same.

    The first rests on the text alone, so copies share it; the second on the row
    too, so the copies of a text are scored all over.
    """
    own = F.pmod(F.xxhash64(content, F.lit(1)), F.lit(shards))
    away = F.pmod(F.xxhash64(content, row, F.lit(2)), F.lit(shards - 1)) + 1
    return own, F.pmod(own + away, F.lit(shards))


def _portions(sizes: list[int], most: int) -> list[list[int]]:
    """Places of texts of about equal size together, ``most`` words each time or one text: a long text alone isn't waited for by short ones."""
    out, held = [], most + 1
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if held + sizes[i] > most:
            out.append([])
            held = 0
        out[-1].append(i)
        held += sizes[i]
    return out


def _score_whole(rows: DataFrame, good: DataFrame) -> DataFrame:
    """``score`` of rows (doc_id, text) against all texts of the ids in ``good``."""
    index = suffixes.build(rows.filter("text is not null").join(good, "doc_id", "left_semi").select("text").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            whole = [i for i, t in enumerate(texts) if t is not None]
            kept = [texts[i] for i in whole]
            hashed = [suffixes.word_hashes(t) for t in kept]
            phrases, sizes = [len(h) for h in hashed], [0] * len(kept)
            for part in _portions(phrases, WORDS_AT_ONCE) if index else ():
                for i, c, size in zip(part, *suffixes.count_phrases(index, [kept[i] for i in part], [hashed[i] for i in part])):
                    phrases[i], sizes[i] = c, size
            out: list[tuple] = [(d, *[None] * (len(NAMES) - 1)) for d in ids]
            for i, h, c, size in zip(whole, hashed, phrases, sizes):
                n, k = len(h), lz78(h.tolist())
                out[i] = (ids[i], n, int(c), k, *(bits(int(c), k, n, int(size)) if n else (None, None)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), ARROW)], schema=ARROW)

    return rows.mapInArrow(run, SCHEMA)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_chars: int | None = None, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Scores of every document: (doc_id, n_words, phrases, self_phrases, cross_bits, relative_entropy).

    Defined results: a null text has nulls; a text without a word has 0 words and
    phrases and null scores; where nothing is labelled good every word is a phrase;
    repeated rows have equal scores; null doc_ids are carried and never reference;
    an empty table gives no rows; other columns are ignored.  Texts are read whole.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n_good = good.count()
    if shard_chars is None:
        return _score_whole(rows, F.broadcast(good) if n_good <= BROADCAST_IDS else good)
    total, n = rows.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    share = min(1.0, n_good / max(n, 1))
    shards = max(2, math.ceil((total or 0) * share / shard_chars))
    copies = max(1, math.ceil((total or 0) / shards / group_chars))
    marks = good.withColumn("good", F.lit(1))
    if n_good <= BROADCAST_IDS:  # eight bytes an id; more of them meet the texts in a shuffle
        marks = F.broadcast(marks)
    marked = rows.join(marks, "doc_id", "left")
    own, away = placement(shards, F.col("text"), F.col("doc_id"))
    query = F.struct((away * copies + F.pmod(F.xxhash64("text", "doc_id", F.lit(3)), F.lit(copies))).alias("part"), F.lit(1).alias("kind"))
    reference = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: F.struct((own * copies + c).alias("part"), F.lit(0).alias("kind")))
    spread = marked.filter("text is not null").withColumn("to", F.explode(F.when(F.col("good") == 1, F.concat(F.array(query), reference)).otherwise(F.array(query))))
    dealt = spread.select(F.col("to.part").alias("part"), F.col("to.kind").alias("kind"), "doc_id", "text")

    names, arrow = NAMES, ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A part's reference texts come first and only distinct ones are kept; its
        # queries then pass by one batch at a time.
        part, known, distinct, automaton, size = None, {}, {}, None, 0
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for p, kind, d, t in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "doc_id", "text"))):
                if p != part:
                    part, known, distinct, automaton, size = p, {}, {}, None, 0
                if not kind:
                    if t not in distinct:
                        distinct[t] = [known.setdefault(w, len(known)) for w in words(t)]
                    continue
                if automaton is None:
                    size = sum(map(len, distinct.values()))
                    automaton = SuffixAutomaton(iter(distinct.values()))
                    distinct = {}
                sequence = [known.get(w, w) for w in words(t)]
                n = len(sequence)
                c, k = automaton.phrases(sequence), lz78(sequence)
                cross, relative = bits(c, k, n, size) if n else (None, None)
                for name, value in zip(names, (d, n, c, k, cross, relative)):
                    out[name].append(value)
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    scored = dealt.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, SCHEMA)
    nulls = rows.filter("text is null").select("doc_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")[1:]])
    return scored.unionByName(nulls)
