"""SimHash near-duplicate groups through Hamming BK-trees over shards.

Fingerprint: 256 signs of a sum of +-1 vectors, one for each distinct word.  Two
documents are near duplicates at a Hamming distance of ``radius`` at most.

First pass: each fingerprint goes to ``tables`` shards, named by ``bits`` of its
bits (a fixed random choice for each table).  ``shard_plan`` derives both numbers
from the count of distinct fingerprints, so that a shard of unrelated documents
holds a few of them at any size of corpus, and two documents whose distance is
``design`` share a shard with probability ``recall``.

Search: a shard's BK-tree has leaders as nodes, children keyed by the integer
Hamming distance to their parent.  Every fingerprint of the shard is a query; at a
node at distance d only edges d-radius .. d+radius are followed.  A fingerprint
without a leader within the radius becomes one, so the work in a shard of a
million copies grows with its leaders, not with the square of the copies.

Second pass: the first leaves out pairs that share no shard, or share one in which
they follow different leaders.  ``cross_edges`` finds every pair within the radius
whose ends the first pass left in different groups, so groups are those of all pairs.
Fingerprints are dealt to blocks and each pair of blocks is one cell of a grid.  In
a cell the bits are cut into parts with thresholds t such that the t + 1 add up to
radius + 1: of a pair within the radius some part differs in t bits at most, so
looking up all values that near in each part misses none.  All rows of a value are
compared with all rows of the values near it as one table of distances, first over
half of the bits.  A large group's rows of a value are not compared with that group,
so it doesn't cost its square.

Shard trees stay with their shard's rows instead of being broadcast: together they
grow with the corpus, so each is built in the task that has its queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, map_batches, quoted, sorted_runs, text_buffers, text_key, words
from millrace.plans.lineage import checkpoint, working_table
from millrace.plans.shipping import worker_cache

BITS = 256
RADIUS = 40
#: Two fingerprints at this distance meet in a shard with probability RECALL; nearer ones more surely.
DESIGN = RADIUS
RECALL = 0.95
#: Fingerprints of a block at most, and tasks that the second pass is cut into at least, as far as its parts go.
BLOCK_ROWS = 1 << 20
LEAST_TASKS = 16
#: Candidates that are compared at once (their distances stay in a core's cache), and rows of a value from which a group's are taken apart.
CANDIDATES_AT_ONCE = 1 << 17
LARGE_GROUP = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of distinct words given as 64-bit hashes; ties count as ones."""
    lanes = _mix(hashes[:, None] + _GOLDEN * np.arange(1, BITS // 64 + 1, dtype=np.uint64)[None, :])
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(lanes), 4096):
        part = np.ascontiguousarray(lanes[start : start + 4096])
        ones += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones >= len(lanes)).tobytes()


def text_fingerprint(text: str) -> tuple[bytes, bool]:
    """(fingerprint, whether it stands for words).

    A text without any word has a digest of its characters instead and equals
    only its exact copies.
    """
    import hashlib

    import xxhash

    distinct = set(words(text))
    if not distinct:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), False
    cache = worker_cache().setdefault("simhash_words", {})
    if len(cache) > 200_000:
        cache.clear()
    hashed = []
    for w in distinct:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        hashed.append(h)
    return fingerprint(np.array(hashed, dtype=np.uint64)), True


def shard_plan(n: int, design: int = DESIGN, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for ``n`` distinct fingerprints."""
    bits = max(12, math.ceil(math.log2(max(n, 2))) - 2)
    same = (1 - design / BITS) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _masks(bits: int, tables: int) -> np.ndarray:
    return np.stack([np.random.RandomState(7919 + t).permutation(BITS)[:bits] for t in range(tables)])


class BKTree:
    """Fingerprints as integers; children keyed by Hamming distance to the parent."""

    def __init__(self, root: int) -> None:
        self.root: tuple[int, dict] = (root, {})

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [self.root]
        while stack:
            node, children = stack.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            if children:
                if len(children) <= 2 * radius:
                    stack += [c for k, c in children.items() if d - radius <= k <= d + radius]
                else:
                    stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found

    def add(self, value: int) -> None:
        node, children = self.root
        while True:
            d = (node ^ value).bit_count()
            if d == 0:
                return
            nxt = children.get(d)
            if nxt is None:
                children[d] = (value, {})
                return
            node, children = nxt


def shard_edges(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, leader) of one shard, in the order given; pairs of followers are left to ``cross_edges``."""
    tree, edges = BKTree(values[0]), []
    for value in values[1:]:
        leaders = tree.within(value, radius)
        if leaders:
            edges += [(value, leader) for leader in leaders if leader != value]
        else:
            tree.add(value)
    return edges


def part_plan(rows: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, end, threshold) of parts for a search of ``rows`` fingerprints among as many.

    Of two fingerprints within the radius some part differs in its threshold at most,
    as the thresholds plus one add up to radius + 1.  More parts mean fewer values to
    look up and more candidates; the cheapest number is taken, in candidates (measured:
    a value costs about as much as 6,000 of them, a look-up as 200).
    """
    best, plan = math.inf, []
    for k in range(11, 65):
        cuts = [BITS * i // k for i in range(k + 1)]
        widths = [b - a for a, b in zip(cuts, cuts[1:])]
        base, more = divmod(radius + 1, k)
        wide = sorted(range(k), key=lambda i: -widths[i])[:more]
        found = [(cuts[i], cuts[i + 1], base - 1 + (i in wide)) for i in range(k)]
        if any(t >= b - a for a, b, t in found):
            continue
        looked = [sum(math.comb(b - a, j) for j in range(t + 1)) for a, b, t in found]
        cost = sum(min(2 ** (b - a), rows) * (6000 + 200 * n) + rows * rows * n / 2 ** (b - a) for n, (a, b, t) in zip(looked, found) if t >= 0)
        if cost < best:
            best, plan = cost, [f for f in found if f[2] >= 0]
    if not plan:
        raise ValueError(f"no exact search for a radius of {radius} in {BITS} bits")
    return plan


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start .. start + count - 1 of each, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _part(fps: np.ndarray, first: int, end: int) -> np.ndarray:
    """The bits first .. end - 1 of each fingerprint as a number."""
    number = np.zeros(len(fps), dtype=np.int64)
    for byte in range(first // 8, -(-end // 8)):
        number = (number << 8) | fps[:, byte]
    return (number >> (-end % 8)) & ((1 << (end - first)) - 1)


def _stretches(group: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """(first, end, whether of one large group) of the rows begin .. end - 1, which are in order of group."""
    if end - begin < LARGE_GROUP:
        yield begin, end, False
        return
    cuts = np.flatnonzero(group[begin + 1 : end] != group[begin : end - 1]) + begin + 1
    starts, ends = np.r_[begin, cuts], np.r_[cuts, end]
    at = begin
    for i in np.flatnonzero(ends - starts >= LARGE_GROUP):
        if at < starts[i]:
            yield at, int(starts[i]), False
        yield int(starts[i]), int(ends[i]), True
        at = int(ends[i])
    if at < end:
        yield at, end, False


def cross_pairs(left: np.ndarray, left_group: np.ndarray, right: np.ndarray, right_group: np.ndarray, radius: int, parts: list[tuple[int, int, int]] | None = None, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left rows, right rows) of all pairs within the radius and of different groups.

    Fingerprints are rows of BITS // 8 bytes; a pair may come more than once.  ``parts``
    are those of a plan to look at (all of them together miss no pair); ``same`` says that
    right is left, of which each pair is then looked at from one side only.
    """
    for first, end, threshold in part_plan(len(right), radius) if parts is None else parts:
        width = end - first
        mine, theirs = _part(left, first, end), _part(right, first, end)
        left_order, right_order = np.lexsort((left_group, mine)), np.argsort(theirs, kind="stable")
        # The words that the part isn't in come first: they tell most about its candidates.
        picked = [(first // 64 + k) % (BITS // 64) for k in (2, 3, 1, 0)]
        a, b = ([np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint64)[o, k]) for k in picked] for x, o in ((left, left_order), (right, right_order)))
        a_group, b_group = left_group[left_order], right_group[right_order]
        at = np.r_[0, np.cumsum(np.bincount(theirs, minlength=1 << width))]
        values, begins = np.unique(mine[left_order], return_index=True)
        masks = np.array([sum(1 << bit for bit in bits) for n in range(threshold + 1) for bits in combinations(range(width), n)])
        for value, begin, stop in zip(values.tolist(), begins.tolist(), [*begins[1:].tolist(), len(mine)]):
            wanted = value ^ masks
            if same:
                wanted = wanted[wanted >= value]
            low = at[wanted]
            all_near = _spread(low, at[wanted + 1] - low)
            for lower, upper, large in _stretches(a_group, begin, stop):
                near = all_near[b_group[all_near] != a_group[lower]] if large else all_near
                for c in range(0, len(near), CANDIDATES_AT_ONCE):
                    some = near[c : c + CANDIDATES_AT_ONCE]
                    columns = [b[0][some], b[1][some]]
                    step = max(1, CANDIDATES_AT_ONCE // len(some))
                    for r in range(lower, upper, step):
                        last = min(r + step, upper)
                        apart = np.bitwise_count(a[0][r:last, None] ^ columns[0])
                        apart += np.bitwise_count(a[1][r:last, None] ^ columns[1])
                        hit = np.flatnonzero(apart <= radius)
                        if not len(hit):
                            continue
                        i, j = np.divmod(hit, len(some))
                        i, j = i + r, some[j]
                        other = a_group[i] != b_group[j]
                        i, j, d = i[other], j[other], apart.ravel()[hit[other]].astype(np.int64)
                        for k in (2, 3):
                            d += np.bitwise_count(a[k][i] ^ b[k][j])
                        found = d <= radius
                        if found.any():
                            yield left_order[i[found]], right_order[j[found]]


def cross_edges(rooted: DataFrame, n: int, radius: int) -> DataFrame:
    """Distinct (a, b) of roots whose groups hold fingerprints within the radius of each other; rooted has columns fp and root.

    A task looks at some parts of one cell; few cells mean few parts for each.
    """
    blocks = max(math.ceil(n / BLOCK_ROWS), 1)
    plan = part_plan(math.ceil(max(n, 1) / blocks), radius)
    shares = min(len(plan), math.ceil(LEAST_TASKS / (blocks * (blocks + 1) // 2)))
    wide = BITS // 8
    block = F.pmod(F.xxhash64("fp"), F.lit(blocks)).alias("block")
    beside = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("beside")
    low, high = F.least("block", "beside"), F.greatest("block", "beside")
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share")
    # Cells low <= high are numbered in a row, so each task has a partition of its own.
    task = ((high * (high + 1) / 2).cast("long") * shares + low * shares + F.col("share")).alias("task")
    dealt = rooted.select("fp", "root", block).select("fp", "root", "block", beside).select("*", share).select(task, (F.col("block") == high).alias("upper"), (low == high).alias("alone"), "fp", "root")

    def search(batches):
        for task, rows in sorted_runs(batches, "task"):
            fps, roots = (np.concatenate([text_buffers(r.column(c))[0] for r in rows]).reshape(-1, wide) for c in ("fp", "root"))
            names, group = np.unique(np.ascontiguousarray(roots).view(f"V{wide}").ravel(), return_inverse=True)
            alone = rows[0].column("alone")[0].as_py()
            here = np.concatenate([r.column("upper").to_numpy(zero_copy_only=False) for r in rows])
            there = here if alone else ~here
            if not here.any() or not there.any():
                continue
            found: set[tuple[int, int]] = set()
            mine, theirs = group[here], group[there]
            for a, b in cross_pairs(fps[here], mine, fps[there], theirs, radius, plan[int(task) % shares :: shares], alone):
                pairs = np.unique(np.stack([np.minimum(mine[a], theirs[b]), np.maximum(mine[a], theirs[b])], axis=1), axis=0)
                found.update(map(tuple, pairs.tolist()))
            if found:
                left, right = ([names[p[i]].tobytes() for p in found] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    tasks = min(blocks * (blocks + 1) // 2 * shares, 20_000)
    placed = dealt.repartitionById(tasks, F.pmod("task", F.lit(tasks)).cast("int")).sortWithinPartitions("task")
    return placed.mapInArrow(search, "a binary, b binary").distinct()


def _fingerprints(df: DataFrame, text: str, carried: list[str], fp: str, wordy: str) -> DataFrame:
    """Each row's carried columns and its fingerprint (null text: null)."""
    kept = df.select(*[quoted(c) for c in carried], quoted(text).cast("string").alias(fp + "t"))
    schema = kept.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, flags = [], []
        for t in batch.column(len(carried)).to_pylist():
            f, w = (None, None) if t is None else text_fingerprint(t)
            fps.append(f)
            flags.append(w)
        columns = [batch.column(i) for i in range(len(carried))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(fps, pa.binary()), pa.array(flags, pa.bool_())], names=[*carried, fp, wordy])

    from pyspark.sql import types as T

    out = T.StructType([*schema.fields[:-1], T.StructField(fp, T.BinaryType()), T.StructField(wordy, T.BooleanType())])
    return map_batches(kept, run, out)


def candidate_edges(nodes: DataFrame, n: int, radius: int, design: int, recall: float) -> DataFrame:
    """Distinct (a, b) of fingerprints within the radius, not all of them; nodes has column fp."""
    bits, tables = shard_plan(n, design, recall)
    masks = _masks(bits, tables)

    def to_shards(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, BITS // 8)
        flat = np.unpackbits(raw, axis=1)
        weights = (np.int64(1) << np.arange(bits, dtype=np.int64))[None, :]
        keys = np.stack([(flat[:, m].astype(np.int64) * weights).sum(axis=1) * tables + t for t, m in enumerate(masks)])
        fps = pa.array([f for _ in range(tables) for f in batch.column(0).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), fps], names=["shard", "fp"])

    def search(batches):
        left, right = [], []
        for _, parts in sorted_runs(batches, "shard"):
            rows = sum(p.num_rows for p in parts)
            if rows < 2:
                continue
            values = [int.from_bytes(f, "big") for p in parts for f in p.column("fp").to_pylist()]
            for a, b in shard_edges(values, radius):
                left.append(a.to_bytes(BITS // 8, "big"))
                right.append(b.to_bytes(BITS // 8, "big"))
            if len(left) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    shards = map_batches(nodes.select("fp"), to_shards, "shard long, fp binary")
    placed = shards.repartition("shard").sortWithinPartitions("shard", "fp")
    return placed.mapInArrow(search, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint with an edge; root is its group's least.

    Alternating large-star and small-star steps; each round is checkpointed, so no
    lineage grows and a lost executor costs one round at most.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    pairs = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
        pairs = checkpoint(star(star(pairs, True), False))
    return pairs.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def _rooted(fps: DataFrame, radius: int, design: int, recall: float) -> DataFrame:
    """(fp, root) of each distinct fingerprint by all pairs within the radius; fps has columns fp and wordy."""
    nodes = working_table(fps.filter("fp is not null").groupBy("fp").agg(F.first("wordy").alias("wordy")), "simhash-nodes")
    wordy = nodes.filter("wordy")
    n = wordy.count()
    linked = components(candidate_edges(wordy, n, radius, design, recall))
    first = working_table(nodes.join(linked, "fp", "left").select("fp", "wordy", F.coalesce("root", "fp").alias("root")), "simhash-first")
    # Roots are the least of their groups, so the least of joined roots is that of all.
    joined = components(cross_edges(first.filter("wordy"), n, radius)).select(F.col("fp").alias("root"), F.col("root").alias("least"))
    return first.join(joined, "root", "left").select("fp", F.coalesce("least", "root").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, design: int = DESIGN, recall: float = RECALL) -> DataFrame:
    """Group of every document: (doc_id, group_id, group_size, keep).

    ``group_id`` is the least doc_id of the group and ``keep`` marks the row that
    stays.  Defined results: a null text is in no group (group_id its own doc_id,
    size 1, kept); texts without a word (empty ones too) group with exact copies
    only; null doc_ids come last, so a group of nothing else has a null group_id;
    of repeated rows of one doc_id one is kept; an empty table gives no rows; other
    columns, whatever their names, are ignored.  Texts are read whole.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    fps = working_table(_fingerprints(rows, "text", ["doc_id"], "fp", "wordy"), "simhash-fps")
    rooted = working_table(_rooted(fps, radius, design, recall), "simhash-roots")
    # A group is summed up by partial aggregation; no task holds a whole group.
    totals = fps.join(rooted, "fp").groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    counted = fps.groupBy("fp", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.filter("fp is not null").join(rooted, "fp").join(totals, "root")
    grouped = grouped.select("doc_id", "group_id", "group_size", "n", "fp", "root")
    first = grouped.filter(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("root").agg(F.min("fp").alias("kept_fp"))
    marked = grouped.join(first, "root").withColumn("best", F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("fp") == F.col("kept_fp")))
    alone = fps.filter("fp is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    spread = marked.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return spread.select("doc_id", "group_id", "group_size", (F.col("best") & (F.col("k") == 1)).alias("keep")).unionByName(alone)


def _has_map(kind) -> bool:
    return '"type":"map"' in kind.json()


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, design: int = DESIGN, recall: float = RECALL) -> DataFrame:
    """The documents with one row of each near-duplicate group, all columns kept.

    The row with the least doc_id stays (nulls last; ties: the least hash of the
    whole row, maps by their JSON form; rows equal in all columns count as one).  Null
    texts all stay; empty ones are copies of each other; an empty table gives an empty
    one; columns of any name and type are kept.  Texts are read whole.
    """
    key, hashed, fp, wordy, best, root = fresh(docs, "key", "row", "fp", "wordy", "best", "root")
    tagged = docs.withColumn(key, text_key(quoted(text))).withColumn(hashed, F.xxhash64(*[F.to_json(F.struct(quoted(f.name))) if _has_map(f.dataType) else quoted(f.name) for f in docs.schema.fields]))
    small = tagged.select(F.col(key), F.col(hashed), quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    fps = working_table(_fingerprints(small, "text", [key, hashed, "doc_id"], "fp", "wordy"), "simhash-fps")
    rooted = _rooted(fps, radius, design, recall)
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.col(key).alias("key"), F.col(hashed).alias("row"))
    numeric = dict(docs.dtypes)[doc_id] in ("tinyint", "smallint", "int", "bigint")
    if numeric:
        order = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("name"), F.col(key).alias("key"), F.col(hashed).alias("row"))
    best_rows = fps.join(rooted, "fp").groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.key").alias(key), F.col("m.row").alias(hashed))
    stay = tagged.filter(F.col(key).isNotNull()).join(best_rows.select(F.col(key).alias(best), F.col(hashed).alias(root)), (F.col(key) == F.col(best)) & (F.col(hashed) == F.col(root)), "left_semi")
    # Repeated rows are equal in every column and fall together on the map side.
    if any(_has_map(f.dataType) for f in docs.schema.fields):  # maps can't be compared
        stay = stay.dropDuplicates([key, hashed]).select(*[quoted(c) for c in docs.columns])
    else:
        stay = stay.select(*[quoted(c) for c in docs.columns]).dropDuplicates()
    return stay.unionByName(tagged.filter(F.col(key).isNull()).select(*[quoted(c) for c in docs.columns]))
