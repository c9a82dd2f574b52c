"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of ``capacity`` tokens at most.  The plan is best-fit
decreasing over counts, not documents: bins that are equally full are one entry,
so planning costs by distinct lengths whatever the number of documents, and gives
the very bins that best-fit decreasing gives piece by piece.  A plan's run says: the
pieces of one length whose ranks are lo .. lo + n - 1 go to bins b .. b + n - 1 at one
offset.  Pieces then take their slots by joining on rank within length.

Ranks need no global sort: pieces of one length are spread over buckets, ranked in
their bucket, and moved on by the counts of the buckets before.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.common import map_batches, quoted
from millrace.plans.lineage import working_table

CAPACITY = 2048
#: Pieces of one length that one bucket ranks, about.
BUCKET_ROWS = 200_000
#: Runs of a plan up to which it is broadcast; a longer one is joined by shuffle.
BROADCAST_RUNS = 500_000

Run = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs (length, lo, n, bin, offset) and the number of bins.

    Best-fit decreasing: the longest pieces first, each into the fullest bin it
    fits; of equal bins the one opened first, and new bins in order.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> (first bin, bins), in order of bins
    rooms: list[int] = []
    runs: list[Run] = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room > 0:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            insort(free[room], (first, n))

    for length in sorted(histogram, reverse=True):
        left, lo = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError("a length lies outside the capacity")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop(0)
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = room // length
            # Best fit goes on filling a bin while it can, since its room is the least.
            full = min(n, left // each)
            for j in range(each):
                if full:
                    # Piece ranks run bin by bin in best fit; equal pieces are interchangeable.
                    runs.append((length, lo + j * full, full, first, capacity - room + j * length))
            lo, left = lo + full * each, left - full * each
            put(room - each * length, first, full)
            if full < n and left and left < each:
                for j in range(left):
                    runs.append((length, lo + j, 1, first + full, capacity - room + j * length))
                put(room - left * length, first + full, 1)
                lo, left, full = lo + left, 0, full + 1
            put(room, first + full, n - full)
    return runs, bins


def token_lengths(docs: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) of every row whose text is not null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = tokens.encoding(vocabulary).encode_ordinary
        sizes = [None if t is None else len(encode(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return map_batches(rows, run, f"doc_id {kind}, n_tokens long").filter("n_tokens is not null")


def pack_lengths(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Slots of rows (doc_id, n_tokens): (doc_id, piece, bin_id, bin_offset, n_tokens)."""
    spark = sized.sparkSession
    pieces = sized.filter("n_tokens > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece"), "n_tokens")
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece").cast("long") * capacity).cast("int").alias("length"))
    buckets = max(1, -(-pieces.count() // BUCKET_ROWS))
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", spread)
    # Bounded by capacity * buckets, one row for each length and bucket that occurs.
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    frame = pa.table({"run_length": pa.array(table[:, 0].astype(np.int32)), "lo": table[:, 1], "n": table[:, 2], "first_bin": table[:, 3], "bin_offset": pa.array(table[:, 4].astype(np.int32))})
    slots = spark.createDataFrame(frame).withColumn("hi", F.col("lo") + F.col("n")).drop("n")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rn", F.row_number().over(within)).join(starts.drop("n"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rn") - 1 + F.col("start"))
    if len(runs) <= BROADCAST_RUNS:  # a plan's size follows the capacity, not the data
        slots = F.broadcast(slots)
    placed = ranked.join(slots, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", (F.col("first_bin") + F.col("rank") - F.col("lo")).alias("bin_id"), "bin_offset", F.col("length").alias("n_tokens"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Where every piece of every document goes: (doc_id, piece, bin_id, bin_offset, n_tokens).

    A document of more than ``capacity`` tokens has pieces 0, 1, ... of which all but
    the last fill a bin.  Defined results: null texts and texts without a token need
    no slot and have no row; null doc_ids are packed as they are; repeated rows each
    take a slot, and rows that are equal in id, piece and length may change slots;
    an empty table gives no rows; other columns are ignored.  Texts are read whole.
    """
    return pack_lengths(working_table(token_lengths(docs, doc_id, text, vocabulary), "pack-lengths"), capacity)
