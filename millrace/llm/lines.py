"""Dropping lines whose log template recurs across documents.

A fixed-depth tree files each line by its count of tokens and then by its leading
tokens, of which those with a digit are variable.  In a leaf, lines join the
template with which they agree at ``similarity`` of the positions at least, and at
MIN_CONSTANT of them; where a line differs from its template the position becomes
variable.  A template that ``min_docs`` documents or more use is boilerplate and its
lines go.  Lines too short for that, or of variable tokens for more than half, recur
by their exact text only, in ``short_docs`` documents.

Texts that are copies of each other have one vote together: those with COPY_ANCHORS
of their anchors in common (see below).  A text of nothing but boilerplate has its own.

A line travels as hashes: 128 bits of its tokens and two bytes for each of them, enough
to compare positions; lines that differ in variable tokens only are one row.  A leaf
that too few documents use is pruned before anything is compared.  In a leaf the
templates are found through exact runs of positions: of d + 1 runs one must agree
whole where d positions at most differ, so no line is held against every template.

With ``passage``, a run of that many words or more that two dissimilar texts share goes
too, wherever it lies in its lines.  Every window of ``passage`` words holds its
least-hashed run of GRAM words (an anchor), so texts that share a window share that run
and one of SIDES longer runs around it.  Only texts with such a run in common with
others are read again, for the windows around it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import fresh, key_filter, map_batches, portions, quoted, sorted_runs, text_buffers
from millrace.llm.simhash import components
from millrace.plans.lineage import working_table
from millrace.plans.shipping import worker_cache

LEADING = 3
MIN_TOKENS = 4
MIN_CONSTANT = 6
MIN_DOCS = 3
SHORT_DOCS = 10
SIMILARITY = 0.75
PASSAGE = 50
GRAM = 6
SIDES = 4
COPY_ANCHORS = 0.3
#: Holders of one anchor that are put in order together, at most about.
HOLDERS = 100_000
#: Rows of a table of busy leaves or of votes up to which it is broadcast.
BROADCAST_ROWS = 200_000
#: Words are runs of other bytes than ASCII white space.
_TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGIT = np.isin(np.arange(256), np.arange(48, 58)).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
_VARIABLE = np.uint64(0x5851F42D4C957F2D)
#: Of a run's hash the bits that order runs; the others hold its place.
_PLACE = np.uint64((1 << 30) - 1)
_LONG = 1 << 16


def _weights() -> tuple[np.ndarray, np.ndarray]:
    """(64 bits for each byte, none for white space; a weight for each place in a word)."""
    cache = worker_cache()
    if "line_weights" not in cache:
        of_byte = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        of_byte[_SPACE] = 0
        cache["line_weights"] = of_byte, _mixed(np.arange(1, _LONG + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return cache["line_weights"]


def tokenised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64 bits of each word, its text, its line) of texts in one buffer; the last bit says that a word is variable.

    Lines are numbered through all texts, each of which has one at least.
    """
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = solid & edge[:-1]
    begins[1:] |= solid[1:] & ~solid[:-1]
    begins = np.flatnonzero(begins)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_byte, of_place = _weights()
    found = np.empty(len(begins), np.uint64)
    variable = np.empty(len(begins), np.uint8)
    at = 0
    while at < len(begins):  # a quarter of a megabyte at a time, or one word
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + (1 << 18))))
        low, high = int(begins[at]), int(begins[end]) if end < len(begins) else len(data)
        first, part = begins[at:end] - low, data[low:high]
        place = np.arange(high - low) - np.repeat(first, np.diff(first, append=high - low))
        weight = of_place[place & (_LONG - 1)]
        if len(place) > _LONG:
            weight = weight + (place >> 16).astype(np.uint64) * np.uint64(_BASE)
        found[at:end] = np.add.reduceat(of_byte[part] * weight, first)
        variable[at:end] = np.maximum.reduceat(_DIGIT[part], first)
        at = end
    text = np.searchsorted(offsets, begins, "right") - 1
    line = np.searchsorted(np.flatnonzero(data == 10), begins) + text
    return _mixed(found) & ~np.uint64(1) | variable, text, line


def word_hashes(tokens: list[str]) -> np.ndarray:
    """64 bits of each token."""
    data = np.frombuffer(" ".join(tokens).encode("utf-8", "surrogatepass"), np.uint8)
    return tokenised(data, np.array([0, len(data)]))[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashed_lines(words: np.ndarray, sizes: np.ndarray, min_tokens: int, leading: int) -> tuple[np.ndarray, ...]:
    """(leaf, h1, h2, whether by template, two bytes of each word) of lines of ``sizes`` > 0 words."""
    first = np.cumsum(sizes) - sizes
    variable = (words & np.uint64(1)).astype(np.int64)
    by_template = (sizes >= min_tokens) & (2 * np.add.reduceat(variable, first) <= sizes)
    masked = np.where(variable > 0, _VARIABLE, words)
    of_line = np.where(np.repeat(by_template, sizes), masked, words)
    place = (np.arange(len(words)) - np.repeat(first, sizes)).astype(np.uint64)
    parts = [np.add.reduceat(_mixed(of_line * np.uint64(odd) + place * np.uint64(_BASE)), first) for odd in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
    h1, h2 = (_mixed(x + sizes.astype(np.uint64)).view(np.int64) for x in parts)
    leaf = sizes.astype(np.uint64)
    for k in range(leading):
        token = masked[np.minimum(first + k, len(words) - 1)]
        leaf = _mixed(leaf * np.uint64(_BASE) + np.where(sizes > k, token, np.uint64(0)))
    return np.where(by_template, leaf.view(np.int64), h1), h1, h2, by_template, (masked >> np.uint64(20)).astype(np.uint16)


def line_hashes(line: str, min_tokens: int = MIN_TOKENS, leading: int = LEADING) -> tuple[int, int, int, tuple] | None:
    """(leaf, 128 bits of the line, its words' signature, empty if it recurs by exact text only); None without a token."""
    words = word_hashes(line.split())
    if not len(words):
        return None
    leaf, h1, h2, by_template, short = hashed_lines(words, np.array([len(words)]), min_tokens, leading)
    return int(leaf[0]), int(h1[0]), int(h2[0]), tuple(short.tolist()) if by_template[0] else ()


def slack(n: int, similarity: float) -> int:
    """How many of ``n`` positions may differ."""
    return max(0, min(int((1 - similarity) * n + 1e-9), n - MIN_CONSTANT))


def templates(signatures: list, similarity: float) -> list[int]:
    """Number of the template that each line of one leaf joins, in order."""
    n = len(signatures[0])
    differ = slack(n, similarity)
    runs = differ + 1
    bounds = [(i * n // runs, (i + 1) * n // runs) for i in range(runs)]
    index: dict[tuple, list[int]] = defaultdict(list)
    made: list[list[int]] = []
    joined: list[int] = []
    exact: dict = {}
    for s in signatures:
        if s in exact:
            joined.append(exact[s])
            continue
        candidates = set()
        for i, (a, z) in enumerate(bounds):
            candidates.update(index.get((i, s[a:z]), ()))
        best, most = -1, n - differ - 1
        for c in sorted(candidates):
            same = sum(map(eq, made[c], s))
            if same > most:
                best, most = c, same
        if best < 0:
            best = len(made)
            made.append(list(s))
            for i, (a, z) in enumerate(bounds):
                index[i, s[a:z]].append(best)
        else:
            made[best] = [x if x == y else -1 for x, y in zip(made[best], s)]
        exact[s] = best
        joined.append(best)
    return joined


def recurring(rows: list[tuple], similarity: float, min_docs: int, short_docs: int) -> list[bool]:
    """Whether each line of a leaf is boilerplate: (signature, votes), of the votes as many as are needed at most."""
    if not len(rows[0][0]):
        return [len(votes) >= short_docs for _, votes in rows]
    joined = templates([r[0] for r in rows], similarity)
    users: dict[int, set] = defaultdict(set)
    for t, (_, votes) in zip(joined, rows):
        users[t].update(votes)
    return [len(users[t]) >= min_docs for t in joined]


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words: a polynomial, by Horner's rule in doubling steps."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    done, value, half, step, base, left = 0, None, words, 1, _BASE, length  # half: runs of ``step`` words
    while left:
        if left & 1:
            if value is None:
                value = half
            else:
                n = len(words) - done - step + 1
                value = value[:n] * np.uint64(base) + half[done : done + n]
            done += step
        left >>= 1
        if left:
            half = half[: len(half) - step] * np.uint64(base) + half[step:]
            base, step = base * base & (1 << 64) - 1, step * 2
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def windows(words: np.ndarray, ends: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each run of GRAM words, place of the least in each window of ``passage`` words, windows within a text).

    ``ends`` is for each word where its text ends.  Of equal runs the first counts.
    """
    grams = run_hashes(words, min(GRAM, passage))
    width = passage - min(GRAM, passage) + 1
    least, have = grams & ~_PLACE | np.arange(len(grams)).astype(np.uint64), 1
    if len(grams) < width:
        return grams, np.zeros(0, np.int64), np.zeros(0, np.int64)
    while have < width:  # minima of windows of twice the width, until it is reached
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    inside = np.flatnonzero(np.arange(len(least)) + passage <= ends[: len(least)])
    return grams, (least[inside] & _PLACE).astype(np.int64), inside


def anchors(words: np.ndarray, sizes: np.ndarray, passage: int, sides: bool = True) -> tuple[np.ndarray, ...]:
    """(text, anchor, SIDES hashes of longer runs around it, if asked for), without repeats.

    A text shorter than a window (``sizes`` is each text's count of words) has all its
    runs as anchors.  A window around an anchor has a part of its other words before it;
    by that part, in steps, it holds one of the longer runs whole, which are shorter
    than a window by a step.  Where the text has no room for such a run its hash is 0.
    """
    gram = min(GRAM, passage)
    step = -(-(passage - gram) // SIDES)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    grams, least, _ = windows(words, ends, passage)
    chosen = np.repeat(sizes < passage, sizes)[: len(grams)] & (np.arange(len(grams)) + gram <= ends[: len(grams)])
    chosen[least] = True
    at = np.flatnonzero(chosen)
    begin, end = (ends - np.repeat(sizes, sizes))[at], ends[at]
    runs = run_hashes(words, passage - step)
    found = [text[at], grams[at]]
    for j in range(SIDES if sides else 0):
        start = at - j * step
        fits = (start >= begin) & (start + passage - step <= end)
        found.append(np.where(fits, runs[np.clip(start, 0, len(runs) - 1)], np.uint64(0)) if len(runs) else np.zeros(len(at), np.uint64))
    order = np.lexsort(found[::-1])
    found = [x[order] for x in found]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([x[1:] != x[:-1] for x in found], axis=0)
    return tuple(x[new] for x in found)


def _owned(owner: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """64 bits of a text's number and values of it."""
    mixed = owner.astype(np.uint64) * np.uint64(_BASE)
    for v in values:
        mixed = _mixed(mixed + v.view(np.uint64))
    return mixed


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of the elements of a list column; null lists have none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _line_table(texts: DataFrame, min_tokens: int, leading: int, passage: int | None) -> DataFrame:
    """(leaf, h1, h2, sig, doc, size, side2 ..) of the distinct lines of each text, and with a null sig its anchors (h1) with their sides (leaf, h2, side2 ..).

    ``size`` is the number of the text's distinct anchors.
    """

    names = ["leaf", "h1", "h2", "sig", "doc", "size", *(f"side{j}" for j in range(2, SIDES))]

    def part(keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[pa.RecordBatch]:
        words, text, line = tokenised(data, offsets)
        if not len(words):
            return []
        size = np.bincount(line)
        size = size[size > 0]
        owner = text[np.cumsum(size) - size]
        leaf, h1, h2, by_template, short = hashed_lines(words, size, min_tokens, leading)
        order = np.lexsort((h2, h1, owner))  # of equal lines of a text one is enough
        same = np.concatenate([[False], (owner[order][1:] == owner[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])])
        flags = np.zeros(len(size), bool)
        flags[order[~same]] = True
        keep = np.flatnonzero(flags)
        data = short[np.repeat(flags & by_template, size)]
        ends = np.concatenate([[0], np.cumsum(np.where(by_template[keep], 2 * size[keep], 0))]).astype(np.int32)
        sig = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        lines = pa.RecordBatch.from_arrays([pa.array(leaf[keep]), pa.array(h1[keep]), pa.array(h2[keep]), sig, pa.array(keys[owner[keep]]), pa.nulls(len(keep), pa.int32()), *[pa.nulls(len(keep), pa.int64())] * (SIDES - 2)], names=names)
        own, *hashes = anchors(words, np.bincount(text, minlength=len(keys)), passage or PASSAGE, passage is not None)
        new = np.append(True, (own[1:] != own[:-1]) | (hashes[0][1:] != hashes[0][:-1]))[: len(own)]
        count = np.bincount(own[new], minlength=len(keys)).astype(np.int32)
        anchor, *sides = (pa.array(x.view(np.int64)) for x in hashes)
        sides = sides or [pa.nulls(len(own), pa.int64())] * SIDES
        return [lines, pa.RecordBatch.from_arrays([sides[0], anchor, sides[1], pa.nulls(len(own), pa.binary()), pa.array(keys[own]), pa.array(count[own]), *sides[2:]], names=names)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = text_buffers(batch.column(1))
        made = [x for a, z in portions(offsets) for x in part(keys[a:z], data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])]
        return pa.Table.from_batches(made).combine_chunks().to_batches()[0] if made else None

    return map_batches(texts, run, "leaf long, h1 long, h2 long, sig binary, doc long, size int, " + ", ".join(f"side{j} long" for j in range(2, SIDES)))


def shared_anchors(marks: DataFrame) -> DataFrame:
    """The rows of anchors that several texts hold, with the first holder (first) and the number of rows (n)."""
    held = marks.groupBy("h1").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).filter("first <> last").drop("last")
    held = working_table(held, "line-held")
    known = key_filter(held, "h1")
    return (marks.filter(known("h1")) if known else marks).join(held, "h1")


def copies(shared: DataFrame) -> DataFrame:
    """(doc, vote): the text as whose copy a text counts, for texts (doc) that have one.

    Each text is held against the first holder of its anchors and the holder before
    it; two that share COPY_ANCHORS of the anchors of either are in one group.
    """
    # An anchor of a large part of all texts is cut into parts, each with its own order.
    part = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / HOLDERS))
    placed = shared.select("h1", part.alias("part"), "doc", F.col("first").alias("a")).distinct().repartition("h1", "part")
    before = Window.partitionBy("h1", "part").orderBy("doc")
    others = placed.select("doc", "a", F.lag("doc").over(before).alias("b")).select("doc", F.explode(F.array_distinct(F.array("a", "b"))).alias("other")).filter("other <> doc")
    common = others.groupBy("doc", "other").agg(F.count(F.lit(1)).alias("n"))
    sizes = shared.groupBy("doc").agg(F.first("size").alias("size"))
    known = common.join(sizes, "doc").join(sizes.select(F.col("doc").alias("other"), F.col("size").alias("size_other")), "other")
    edges = known.filter(F.col("n") >= COPY_ANCHORS * F.greatest("size", "size_other")).select(F.col("doc").alias("a"), F.col("other").alias("b"))
    return components(edges).select(F.col("fp").alias("doc"), F.col("root").alias("vote"))


def _voted(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """``rows`` with the vote of their text."""
    return rows.join(votes, "doc", "left").withColumn("vote", F.coalesce("vote", "doc"))


def shared_passages(texts: DataFrame, shared: DataFrame, votes: DataFrame, passage: int) -> DataFrame:
    """(doc, passages): for each text key the hashes of its windows that a dissimilar text has too."""

    def of_several(rows: DataFrame, h: str) -> DataFrame:
        return rows.groupBy(h).agg(F.min("vote").alias("a"), F.max("vote").alias("b")).filter("a <> b").select(h)

    sides = _voted(shared, votes).select("doc", "vote", "h1", F.explode(F.array("leaf", "h2", *(f"side{j}" for j in range(2, SIDES)))).alias("side")).filter("side <> 0")
    wanted = sides.join(of_several(sides, "side"), "side").groupBy("doc").agg(F.first("vote").alias("vote"), F.collect_set("h1").alias("marks"))

    def part(begin: int, data: np.ndarray, offsets: np.ndarray, marked: pa.ListArray) -> np.ndarray:
        words, text, _ = tokenised(data, offsets)
        sizes = np.bincount(text, minlength=len(marked))
        grams, least, inside = windows(words, np.repeat(np.cumsum(sizes), sizes), passage)
        owner, marks = _flat(marked)
        known = np.isin(_owned(text[inside], grams[least]), _owned(owner, marks.to_numpy(zero_copy_only=False)))
        inside = inside[known]
        found = np.stack([begin + text[inside], run_hashes(words, passage)[inside].view(np.int64)]) if len(inside) else np.zeros((2, 0), np.int64)
        return np.unique(found, axis=1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc, vote = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "vote"))
        data, offsets = text_buffers(batch.column("text"))
        made = [part(a, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], batch.column("marks").slice(a, z - a)) for a, z in portions(offsets)]
        row, win = np.concatenate(made, axis=1) if made else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(win), pa.array(doc[row]), pa.array(vote[row])], names=["win", "doc", "vote"])

    wanted = working_table(wanted, "line-wanted")
    held = key_filter(wanted, "doc")
    # Copies of a text fall together on the map side, so no hot text meets its marks.
    once = (texts.filter(held("doc")) if held else texts).dropDuplicates(["doc"])
    # The vote travels with its text: windows are many rows, to be joined with no other table.
    table = working_table(map_batches(once.join(wanted.hint("merge"), "doc").select("doc", "vote", "text", "marks"), run, "win long, doc long, vote long"), "line-windows")
    return table.select("win", "doc").join(of_several(table, "win"), "win").groupBy("doc").agg(F.collect_list("win").alias("passages"))


def boilerplate(texts: DataFrame, similarity: float, min_docs: int, short_docs: int, min_tokens: int, leading: int, passage: int | None) -> DataFrame:
    """(doc, drop, passages): for each text key the hashes of its lines and passages to drop."""
    table = working_table(_line_table(texts, min_tokens, leading, passage), "line-hashes")
    lines, marks = table.filter("sig is not null"), table.filter("sig is null").drop("sig")
    shared = working_table(shared_anchors(marks), "line-anchors")
    votes = working_table(copies(shared), "line-votes")
    votes = F.broadcast(votes) if votes.count() <= BROADCAST_ROWS else votes
    needed = F.when(F.max(F.length("sig")) > 0, min_docs).otherwise(short_docs)
    busy = working_table(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"), needed.alias("needed")).filter("n >= needed and a <> b").select("leaf"), "line-leaves")
    kept = lines.join(F.broadcast(busy) if busy.count() <= BROADCAST_ROWS else busy, "leaf")
    kept = working_table(_voted(kept.dropDuplicates(["leaf", "h1", "h2", "doc"]), votes), "line-rows")
    # Of a line's votes as many are kept as can matter, before the shuffle too.
    most = max(min_docs, short_docs)
    ranked = kept.select("leaf", "h1", "h2", "sig", "vote").distinct().withColumn("r", F.row_number().over(Window.partitionBy("leaf", "h1", "h2").orderBy("vote")))
    distinct = ranked.filter(F.col("r") <= most).groupBy("leaf", "h1", "h2").agg(F.first("sig").alias("sig"), F.collect_list("vote").alias("votes"))

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2 = [], []
        for _, parts in sorted_runs(batches, "leaf"):
            by_length: dict[int, list] = defaultdict(list)
            for p in parts:
                for sig, votes, a, b in zip(*(p.column(c).to_pylist() for c in ("sig", "votes", "h1", "h2"))):
                    by_length[len(sig)].append((tuple(np.frombuffer(sig, np.uint16).tolist()), votes, a, b))
            for own in by_length.values():
                for r, gone in zip(own, recurring([r[:2] for r in own], similarity, min_docs, short_docs)):
                    if gone:
                        h1.append(r[2])
                        h2.append(r[3])
            if len(h1) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["h1", "h2"])
                h1, h2 = [], []
        if h1:
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["h1", "h2"])

    gone = distinct.repartition("leaf").sortWithinPartitions("leaf", "h1", "h2").mapInArrow(cluster, "h1 long, h2 long").distinct()
    drops = kept.select("h1", "h2", "doc").join(gone, ["h1", "h2"]).groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    if passage is None:
        return drops.withColumn("passages", F.lit(None).cast("array<bigint>"))
    return drops.join(shared_passages(texts, shared, votes, passage), "doc", "full")


def _without(line: str, gone: list[bool]) -> str:
    """A line without some of its words; each goes with the space after it."""
    out, at = [], 0
    spans = [m.span() for m in _TOKEN.finditer(line)]
    for i, (start, _) in enumerate(spans):
        if gone[i]:
            out.append(line[at:start])
            at = spans[i + 1][0] if i + 1 < len(spans) else len(line)
    return "".join([*out, line[at:]]).rstrip() if gone[-1] else "".join([*out, line[at:]])


def _cleaned(column: pa.Array, drops: pa.ListArray, passages: pa.ListArray, min_tokens: int, leading: int, passage: int | None) -> tuple[list, list, list]:
    """(text, lines it had, lines it lost) of each text."""
    data, offsets = text_buffers(column)
    words, text, line = tokenised(data, offsets)
    ends = np.append(np.searchsorted(np.flatnonzero(data == 10), offsets[1:]) + np.arange(1, len(column) + 1), 0)  # of each text's lines
    size = np.bincount(line, minlength=ends[-2] if len(column) else 0)
    used = np.flatnonzero(size)
    goes, spliced = np.zeros(len(size), bool), np.zeros(len(words) + 1, np.int64)
    if len(used):
        owner = text[np.cumsum(size[used]) - size[used]]
        _, h1, h2, _, _ = hashed_lines(words, size[used], min_tokens, leading)
        of, gone = _flat(drops)
        goes[used] = np.isin(_owned(owner, h1, h2), _owned(of, *(gone.field(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))))
        of, wins = _flat(passages)
        if len(of):
            runs = run_hashes(words, passage)
            hit = np.isin(_owned(text[: len(runs)], runs), _owned(of, wins.to_numpy(zero_copy_only=False)))
            spliced[: len(hit)] += hit
            spliced[passage : passage + len(hit)] -= hit
    marks = (np.cumsum(spliced) > 0).tolist()
    stops = np.cumsum(size).tolist()
    size, goes = size.tolist(), goes.tolist()
    texts, counts, dropped, at = [], [], [], 0
    for whole, end in zip(column.to_pylist(), ends.tolist()):
        lines, kept = whole.split("\n"), []
        for one, k in zip(lines, range(at, end)):
            marked = marks[stops[k] - size[k] : stops[k]]
            if goes[k] or marked and all(marked):
                continue
            kept.append(_without(one, marked) if any(marked) else one)
        at = end
        texts.append("\n".join(kept))
        counts.append(len(lines))
        dropped.append(len(lines) - len(kept))
    return texts, counts, dropped


def drop_recurring(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS, min_tokens: int = MIN_TOKENS, leading: int = LEADING, counts: bool = False, passage: int | None = None) -> DataFrame:
    """The documents with recurring lines and passages dropped; all columns kept.

    ``min_docs`` (2 or more) is the support of a template, ``short_docs`` that of a line
    of fewer than ``min_tokens`` tokens or of mostly variable ones, by exact text.
    Copies, exact and near, count once, so they make nothing recur.  With
    ``passage``, runs of that many words that a text shares with one that isn't its
    copy go, also within a line.  With ``counts`` two columns more say how many
    lines the document had (``n_lines``) and lost (``n_dropped``); where a column
    has such a name already the new one ends in an underscore.

    Defined results: null and empty texts stay as they are; decisions rest on texts
    alone, so null ids, ties and repeated rows change nothing and repeated rows get
    the same result; a text of nothing but boilerplate becomes empty; an empty table
    gives an empty one; clashing names of other columns are harmless.  Texts are
    read whole.
    """
    if min_docs < 2 or short_docs < 2:
        raise ValueError("what one document holds doesn't recur: min_docs and short_docs are 2 or more")
    key, drop, spliced = fresh(docs, "key", "drop", "passages")
    keyed = docs.withColumn(key, F.when(quoted(text).isNotNull(), F.xxhash64(quoted(text))))
    texts = keyed.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), quoted(text).alias("text"))
    drops = boilerplate(texts, similarity, min_docs, short_docs, min_tokens, leading, passage).withColumnsRenamed({"doc": key, "drop": drop, "passages": spliced})
    drops = working_table(drops, "line-drops")
    held = key_filter(drops, key)
    names = docs.columns
    position = names.index(text)
    extra: list[str] = []
    for name in ("n_lines", "n_dropped") if counts else ():
        while name.lower() in {c.lower() for c in names + extra}:
            name += "_"
        extra.append(name)
    fields = [*docs.schema.fields]
    fields[position] = T.StructField(text, T.StringType())
    schema = T.StructType([*fields, *(T.StructField(c, T.IntegerType()) for c in extra)])
    # Plain rows pass by; documents that may lose something are shuffled once, and those that do are rewritten.
    loses = F.col(key).isNotNull()
    if held:
        # The key of no text is any number, so that the filter sees none that is null.
        keyed = keyed.withColumn(key, F.coalesce(key, F.lit(0)))
        loses = quoted(text).isNotNull() & held(key)
    columns = [quoted(c) for c in names]
    plain = keyed.filter(~loses).select(*columns)
    if counts:
        plain = plain.select(*columns, F.when(quoted(text).isNull(), 0).otherwise(F.size(F.split(quoted(text), "\n", -1))).alias(extra[0]), F.lit(0).alias(extra[1]))
    touched = keyed.filter(loses).join(drops.hint("merge"), key, "left").select(*columns, F.col(drop), F.col(spliced))

    def cleaned(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(len(names))]
        data, at = text_buffers(columns[position])
        texts, n, gone = [], [], []
        for a, z in portions(at):
            parts = _cleaned(*(c.slice(a, z - a) for c in (columns[position], batch.column(len(names)), batch.column(len(names) + 1))), min_tokens, leading, passage)
            for held, new in zip((texts, n, gone), parts):
                held += new
        columns[position] = pa.array(texts, pa.string())
        if counts:
            columns += [pa.array(n, pa.int32()), pa.array(gone, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, *extra])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(len(names))]
        columns[position] = columns[position].cast(pa.string())
        if counts:
            n = pc.fill_null(pc.add(pc.count_substring(columns[position], "\n"), 1), 0)
            columns += [n.cast(pa.int32()), pa.array(np.zeros(batch.num_rows, np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=[*names, *extra])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        loses = pc.or_(*(batch.column(i).is_valid() for i in (len(names), len(names) + 1)))
        parts = [fn(rows) for fn, rows in ((cleaned, batch.filter(loses)), (whole, batch.filter(pc.invert(loses)))) if rows.num_rows]
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return plain.union(map_batches(touched, run, schema))
