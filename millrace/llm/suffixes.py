"""Suffix array over the words of a whole collection of texts, in files that workers map.

Words are 64-bit hashes, texts end in a 0, so no match spans two of them.  Pieces of
the array are sorted by one task each (a range of leading word pairs) and stand one
after the other, so a search costs the logarithm of the collection and no worker holds
it: pages are read from the shared folder as they are touched.  The distinct leading
pairs stand in a table of their own, so most phrases need no search of the array.
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import words
from millrace.plans.lineage import working_folder
from millrace.plans.shipping import worker_cache

#: Suffixes that one task sorts, about.
PIECE = 4_000_000
#: Words of the collection that a task looks through at once.
SCAN = 1 << 22
#: Words that tied suffixes are compared over at once, and depth from which that pays.
STRIDE, DEEP = 32, 4
#: Files of the table of leading pairs.
PARTS = ("words", "pairs", "rows")


def mounted(uri: str) -> str:
    """A path that Python can map of a folder's URI."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for LM scores, not {uri}")
    return unquote(parts.path) if parts.scheme else uri


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return h


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, none of them 0."""
    cache = worker_cache().setdefault("suffix_words", _WordHashes())
    if len(cache) > 200_000:
        cache.clear()
    found = words(text)
    return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))


def text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def sort_suffixes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions ``at`` in the order of the words that follow up to the text's end; ``text`` has STRIDE zeros more at its end."""
    out = at.copy()
    slots, label = np.arange(len(at)), np.zeros(len(at), np.int64)
    depth, rounds = np.zeros(len(at), np.int64), 0
    while len(slots):
        pos = out[slots]
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        if rounds >= DEEP:  # what all of a group have in common needs no sorting
            rows = np.diff(np.r_[first, len(slots)])
            for begin, end in _portions(first, len(slots)):
                span = slice(first[begin], first[end] if end < len(first) else len(slots))
                ahead = text[(pos[span] + depth[span])[:, None] + np.arange(STRIDE)]
                lead = np.repeat(first[begin:end] - first[begin], rows[begin:end])
                differ = (ahead != ahead[lead]) | (ahead == 0)
                common = np.where(differ.any(axis=1), differ.argmax(axis=1), STRIDE - 1)
                depth[span] += np.repeat(np.minimum.reduceat(common, first[begin:end] - first[begin]), rows[begin:end])
        word = text[pos + depth]
        order = np.lexsort((word, label))  # keeps labels in place, and depths with them
        word = word[order]
        out[slots] = pos[order]
        label = np.cumsum(np.r_[True, (word[1:] != word[:-1]) | (label[1:] != label[:-1])]) - 1
        tied = (np.bincount(label)[label] > 1) & (word != 0)
        slots, label, depth, rounds = slots[tied], label[tied], depth[tied] + 1, rounds + 1
    return out


def _portions(first: np.ndarray, rows: int, size: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of groups of ``size`` rows at most, or of one group."""
    at, ends = 0, np.r_[first[1:], rows]
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(ends, first[at] + size, "right")))
        yield at, end
        at = end


def leading_pairs(text: np.ndarray, array: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct first words, keys of the distinct leading pairs, first row of each) of sorted suffixes.

    A key is the place of the first word, in ``bits`` bits, and as much of the second word
    as it has room for: keys don't fall, but pairs of one first word may share one.
    """
    one, two = text[array], text[array + 1]
    word = np.ones(len(array), bool)
    word[1:] = one[1:] != one[:-1]
    pair = word.copy()
    pair[1:] |= two[1:] != two[:-1]
    first = np.flatnonzero(pair)
    return one[word], pair_keys(np.cumsum(word[first]) - 1, two[first], bits), first.astype(array.dtype)


def pair_keys(place: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    return place.astype(np.uint64) << np.uint64(64 - bits) | second >> np.uint64(bits)


class Suffixes:
    """What a worker needs to know to open the files."""

    def __init__(self, folder: str, n_words: int, wide: bool) -> None:
        self.folder, self.n_words, self.wide = folder, n_words, wide
        self.bits = n_words.bit_length()

    def open(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, suffix array, rows of text hash, first position, words)."""
        held = worker_cache().setdefault("suffix_files", {})
        if self.folder not in held:
            held.clear()
            kinds = (("text", np.uint64), ("suffixes", np.int64 if self.wide else np.uint32), ("texts", np.uint64))
            text, array, texts = (np.asarray(np.memmap(f"{self.folder}/{name}", kind, "r")) for name, kind in kinds)
            held[self.folder] = text, array, texts.reshape(-1, 3)
        return held[self.folder]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``leading_pairs`` of the whole array, with its end as the last row."""
        if not self.folder:  # an array that has no files
            text, array, _ = self.open()
            distinct, keys, rows = leading_pairs(text, array, self.bits)
            return distinct, keys, np.append(rows, len(array))
        held = worker_cache().setdefault("suffix_pairs", {})
        if self.folder not in held:
            held.clear()
            kinds = (("words", np.uint64), ("pairs", np.uint64), ("rows", np.int64 if self.wide else np.uint32))
            held[self.folder] = tuple(np.asarray(np.memmap(f"{self.folder}/{name}", kind, "r")) for name, kind in kinds)
        return held[self.folder]


def build(texts: DataFrame) -> Suffixes | None:
    """Index of distinct texts (one column); None where they hold no word."""
    spark = texts.sparkSession
    folder = mounted(working_folder(spark, "suffixes"))
    os.makedirs(folder, exist_ok=True)

    def write_words(batches):
        name, at, rows = f"words-{uuid.uuid4().hex}", 0, []  # a task that runs again writes a file of its own
        with open(f"{folder}/{name}", "wb") as out:
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    hashed = word_hashes(t)
                    if len(hashed):
                        out.write(hashed.tobytes() + bytes(8))
                        rows.append((text_hash(t), at, len(hashed)))
                        at += len(hashed) + 1
        if rows:
            np.array(rows, np.uint64).tofile(f"{folder}/{name}.texts")
            yield pa.RecordBatch.from_pydict({"name": [name], "n": [at]})

    found = texts.mapInArrow(write_words, "name string, n long").collect()
    n = sum(r.n for r in found)
    if not n:
        return None
    begin, index = 0, []
    with open(f"{folder}/text", "wb") as out:
        for r in found:
            with open(f"{folder}/{r.name}", "rb") as part:
                shutil.copyfileobj(part, out, 1 << 22)
            rows = np.fromfile(f"{folder}/{r.name}.texts", np.uint64).reshape(-1, 3)
            rows[:, 1] += np.uint64(begin)
            index.append(rows)
            begin += r.n
            os.unlink(f"{folder}/{r.name}")
        out.write(bytes(8 * STRIDE))
    index = np.concatenate(index)
    index[np.argsort(index[:, 0])].tofile(f"{folder}/texts")
    wide = n >= 1 << 32
    whole = Suffixes(folder, n - len(index), wide)
    bits, place = whole.bits, np.int64 if wide else np.uint32
    text = np.asarray(np.memmap(f"{folder}/text", np.uint64, "r"))
    at = np.sort(np.random.RandomState(1).randint(0, n, min(n, 200_000)))
    pieces = math.ceil(n / PIECE)
    drawn = np.stack([text[at], text[at + 1]], axis=1)
    drawn = drawn[np.lexsort((drawn[:, 1], drawn[:, 0]))]
    cuts = np.unique(drawn[[len(drawn) * k // pieces for k in range(1, pieces)]], axis=0) if pieces > 1 else drawn[:0]
    cuts = [(0, 0), *map(tuple, cuts[cuts[:, 0] != 0].tolist()), None]

    def sort_piece(batches):
        text = np.asarray(np.memmap(f"{folder}/text", np.uint64, "r"))
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, high = cuts[k], cuts[k + 1]
                at = []
                for begin in range(0, n, SCAN):
                    one, two = text[begin : min(begin + SCAN, n)], text[begin + 1 : min(begin + SCAN, n) + 1]
                    inside = one >= np.uint64(low[0])
                    inside &= (one != low[0]) | (two >= np.uint64(low[1]))
                    if high is not None:
                        inside &= (one < np.uint64(high[0])) | ((one == np.uint64(high[0])) & (two < np.uint64(high[1])))
                    at.append(np.flatnonzero(inside & (one != 0)) + begin)
                name = f"piece-{uuid.uuid4().hex}"
                array = sort_suffixes(text, np.concatenate(at)).astype(place)
                array.tofile(f"{folder}/{name}")
                for part, values in zip(PARTS, leading_pairs(text, array, bits)):
                    values.tofile(f"{folder}/{name}.{part}")
                yield pa.RecordBatch.from_pydict({"k": [k], "name": [name]})

    made = spark.range(0, len(cuts) - 1, 1, len(cuts) - 1).mapInArrow(sort_piece, "k long, name string").collect()
    begin, seen, last = 0, 0, None
    with ExitStack() as files:
        out, *tables = (files.enter_context(open(f"{folder}/{name}", "wb")) for name in ("suffixes", *PARTS))
        for r in sorted(made):
            with open(f"{folder}/{r.name}", "rb") as part:
                shutil.copyfileobj(part, out, 1 << 22)
            distinct, keys, rows = (np.fromfile(f"{folder}/{r.name}.{part}", kind) for part, kind in zip(PARTS, (np.uint64, np.uint64, place)))
            again = len(distinct) > 0 and distinct[0] == last  # a word's pairs may go on in the next piece
            keys += np.uint64(seen - again) << np.uint64(64 - bits)
            for table, values in zip(tables, (distinct[int(again) :], keys, rows + place(begin))):
                values.tofile(table)
            begin, seen, last = begin + os.path.getsize(f"{folder}/{r.name}") // place().itemsize, seen + len(distinct) - again, distinct[-1] if len(distinct) else last
            for name in (r.name, *(f"{r.name}.{part}" for part in PARTS)):
                os.unlink(f"{folder}/{name}")
        np.array([begin], place).tofile(tables[-1])
    for r in found:
        os.unlink(f"{folder}/{r.name}.texts")
    return whole


def _narrow(text, array, low, high, depth, word) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ranges [low, high) whose suffixes have ``word`` at ``depth``."""
    k = len(low)
    left, right = np.concatenate([low, low]), np.concatenate([high, high])
    depth, word = np.concatenate([depth, depth]), np.concatenate([word, word])
    beyond = np.arange(2 * k) >= k
    todo = np.flatnonzero(left < right)
    while len(todo):
        middle = (left[todo] + right[todo]) >> 1
        value, wanted = text[array[middle] + depth[todo]], word[todo]
        up = (value < wanted) | (beyond[todo] & (value == wanted))
        left[todo[up]] = middle[up] + 1
        right[todo[~up]] = middle[~up]
        todo = todo[left[todo] < right[todo]]
    return left[:k], left[k:]


def _pair_rows(index: Suffixes, flat: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the rows that begin with each word of ``flat`` and the next; none at the places ``last``."""
    text, array, _ = index.open()
    distinct, keys, rows = index.pairs()
    # Looked up in order, so that what neighbours touch is still at hand.
    order = np.argsort(flat)
    ordered = flat[order]
    found = np.minimum(np.searchsorted(distinct, ordered), len(distinct) - 1)
    place = np.empty(len(flat), np.int64)
    place[order] = np.where(distinct[found] == ordered, found, -1)
    has = place >= 0
    has[:-1] &= has[1:]
    has[last] = False
    paired = np.flatnonzero(has)
    second = flat[paired + 1]
    wanted = pair_keys(place[paired], second, index.bits)
    order = np.argsort(wanted)
    wanted, second = wanted[order], second[order]
    new = np.ones(len(wanted), bool)
    new[1:] = (wanted[1:] != wanted[:-1]) | (second[1:] != second[:-1])
    run = np.cumsum(new) - 1
    wanted, second = wanted[new], second[new]
    at = np.searchsorted(keys, wanted)
    held = np.full(len(wanted), -1)
    todo = np.flatnonzero(at < len(keys))
    while len(todo):  # pairs of one key stand together
        todo = todo[keys[at[todo]] == wanted[todo]]
        same = text[array[rows[at[todo]]] + 1] == second[todo]
        held[todo[same]] = at[todo[same]]
        todo = todo[~same]
        at[todo] += 1
        todo = todo[at[todo] < len(keys)]
    held, paired = held[run], paired[order]
    paired, held = paired[held >= 0], held[held >= 0]
    low, high = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    low[paired], high[paired] = rows[held], rows[held + 1]
    return low, high


def count_phrases(index: Suffixes, texts: list[str], hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(greedy longest matches that make up each text, words of the index beside its own text).

    A text's own words in the index, its exact copies' too, are no match for it.
    """
    text, array, known = index.open()
    n = np.array([len(h) for h in hashed], np.int64)
    flat = np.concatenate([*hashed, np.zeros(0, np.uint64)])
    start = np.cumsum(n) - n
    keys = np.array([text_hash(t) for t in texts], np.uint64)
    place = np.minimum(np.searchsorted(known[:, 0], keys), len(known) - 1)
    own = known[place, 0] == keys
    own_from = np.where(own, known[place, 1].astype(np.int64), -1)
    own_to = np.where(own, own_from + known[place, 2].astype(np.int64), -1)
    low2, high2 = _pair_rows(index, flat, start[n > 0] + n[n > 0] - 1)
    # A pair that occurs once in all is no match for the text that is in the index with it.
    matched = np.flatnonzero(high2 - low2 > np.repeat(own, n))
    stops = np.append(matched, len(flat))  # words that may begin a phrase of two words or more
    ends = start + n
    count, at, depth = np.zeros(len(n), np.int64), start.copy(), np.zeros(len(n), np.int64)
    low, high = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    live = np.flatnonzero(n)
    while len(live):
        fresh = live[depth[live] == 0]
        if len(fresh):  # words that begin no longer phrase, known or not, are phrases of their own
            to = np.minimum(stops[np.searchsorted(stops, at[fresh])], ends[fresh])
            count[fresh] += to - at[fresh]
            at[fresh] = to
            live = live[at[live] < ends[live]]
            if not len(live):
                break
        spot, d = at[live], depth[live]
        new = d == 0
        a, b = np.where(new, low2[spot], low[live]), np.where(new, high2[spot], high[live])
        old = np.flatnonzero(~new)
        if len(old):
            word = flat[spot[old]]
            least, most = text[array[a[old]] + d[old]], text[array[b[old] - 1] + d[old]]
            beside = (word < least) | (word > most)
            b[old[beside]] = a[old[beside]]
            split = ~beside & (least != most)  # ranges that the word leaves as they are, or empties, need no search
            old, word = old[split], word[split]
            a[old], b[old] = _narrow(text, array, a[old], b[old], d[old], word)
        good = a < b
        mine = np.flatnonzero(good & own[live])
        if len(mine):
            s, e = own_from[live[mine]], own_to[live[mine]]
            inside = np.ones(len(mine), bool)
            for r in (a[mine], b[mine] - 1):
                p = array[r].astype(np.int64)
                inside &= (p >= s) & (p < e)
            good[mine[inside]] = False
            for i in np.flatnonzero(inside & (b[mine] - a[mine] > 2)):  # rows between the ends may be others'
                p = array[a[mine[i]] : b[mine[i]]].astype(np.int64)
                good[mine[i]] = bool(((p < s[i]) | (p >= e[i])).any())
        low[live], high[live] = a, b
        # A pair that only the text itself has leaves a phrase of one word; where a longer one ends its next begins.
        at[live] += np.where(new, 1 + good, good)
        depth[live] = np.where(good, d + 1 + new, 0)
        done = at[live] == ends[live]
        count[live] += ~good | done & good
        live = live[~done]
    return count, index.n_words - np.where(own, known[place, 2].astype(np.int64), 0)
