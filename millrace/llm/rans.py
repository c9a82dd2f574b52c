"""Token ids as static range asymmetric numeral system (rANS) blocks.

One frequency table, counted over the whole corpus, serves all blocks.  A block
holds up to ``block_tokens`` tokens of consecutive documents in ``LANES``
interleaved 64-bit states that emit 32-bit words; it needs no other block.  Every
``STEPS_PER_SEGMENT`` steps it keeps a checkpoint (the lane states and the count
of words), so its segments decode in parallel too, each under its own CRC-32.

Texts are tokenised once, into a working table of ids; counting and encoding read
that table.  The frequency table is bounded by the vocabulary, not by the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.common import map_batches, quoted
from millrace.plans.lineage import working_table
from millrace.plans.shipping import worker_cache

PRECISION = 20
TOTAL = 1 << PRECISION
LOW = np.uint64(1 << 31)
LANES = 32
STEPS_PER_SEGMENT = 512
BLOCK_TOKENS = LANES * STEPS_PER_SEGMENT * 4
#: Blocks that are encoded side by side, as one wider vector.
TOGETHER = 32

BLOCK_SCHEMA = "kind string, block_crc long, n_tokens int, doc_ids array<long>, pieces array<int>, counts array<int>, states binary, checkpoints binary, segment_crcs array<long>, payload binary"


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2**20, each 1 at least, by largest remainders."""
    counts = np.asarray(counts, dtype=np.float64)
    if len(counts) > TOTAL // 2:
        raise ValueError("the vocabulary is too large for the table's precision")
    share = counts / max(counts.sum(), 1.0) * (TOTAL - len(counts))
    freq = np.floor(share).astype(np.int64) + 1
    short = TOTAL - int(freq.sum())
    order = np.argsort(-(share - np.floor(share)), kind="stable")
    freq[order[: short % len(freq)]] += 1
    freq += short // len(freq)
    return freq.astype(np.uint64)


def table_bytes(freq: np.ndarray) -> bytes:
    return zlib.compress(freq.astype("<u4").tobytes(), 6)


def table_from_bytes(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), "<u4").astype(np.uint64)


def encode_blocks(blocks: list[np.ndarray], freq: np.ndarray) -> list[dict]:
    """States, checkpoints and words of several blocks of token ids."""
    f = np.concatenate([freq, [np.uint64(TOTAL)]])  # the pad has the whole range: it leaves a state as it is
    c = np.concatenate([[np.uint64(0)], np.cumsum(freq)[:-1], [np.uint64(0)]]).astype(np.uint64)
    pad, nb = len(freq), len(blocks)
    steps = max(-(-len(b) // LANES) for b in blocks)
    ids = np.full((nb, steps * LANES), pad, dtype=np.int64)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
    ids = ids.reshape(nb, steps, LANES).transpose(1, 0, 2).reshape(steps, nb * LANES)
    x = np.full(nb * LANES, LOW, dtype=np.uint64)
    owner = np.repeat(np.arange(nb), LANES)
    limit_shift, p, word = np.uint64(63 - PRECISION), np.uint64(PRECISION), np.uint64(32)
    emitted = np.zeros(nb, dtype=np.int64)
    words, owners, marks = [], [], []
    for s in range(steps - 1, -1, -1):
        fs, cs = f[ids[s]], c[ids[s]]
        full = np.flatnonzero(x >> limit_shift >= fs)
        if len(full):
            words.append(x[full].astype(np.uint32))
            owners.append(owner[full])
            emitted += np.bincount(owners[-1], minlength=nb)
            x[full] >>= word
        q = x // fs
        x = (q << p) + (x - q * fs) + cs
        if s and s % STEPS_PER_SEGMENT == 0:
            marks.append((s, x.reshape(nb, LANES).copy(), emitted.copy()))
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    whose = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(whose, kind="stable")
    streams = np.split(flat[order], np.cumsum(np.bincount(whose, minlength=nb))[:-1])
    out = []
    for i, b in enumerate(blocks):
        own = [(s, st[i], n[i]) for s, st, n in reversed(marks) if s * LANES < len(b)]
        packed = b"".join(np.array([s, n], "<u4").tobytes() + st.astype("<u8").tobytes() for s, st, n in own)
        starts = [0, *(s * LANES for s, _, _ in own)]
        crcs = [zlib.crc32(b[a:z].astype("<u4").tobytes()) for a, z in zip(starts, [*starts[1:], len(b)])]
        payload = streams[i].astype("<u4").tobytes()
        out.append({"states": x.reshape(nb, LANES)[i].astype("<u8").tobytes(), "checkpoints": packed, "segment_crcs": crcs, "payload": payload, "block_crc": zlib.crc32(payload)})
    return out


def segments(block: dict) -> list[tuple[int, int, np.ndarray, int]]:
    """(first token, end token, lane states, words below) of each segment."""
    size = 8 + 8 * LANES
    marks = block["checkpoints"]
    words = len(block["payload"]) // 4
    found = [(0, np.frombuffer(block["states"], "<u8").astype(np.uint64), words)]
    for at in range(0, len(marks), size):
        s, n = np.frombuffer(marks[at : at + 8], "<u4")
        found.append((int(s) * LANES, np.frombuffer(marks[at + 8 : at + size], "<u8").astype(np.uint64), int(n)))
    ends = [*(f[0] for f in found[1:]), block["n_tokens"]]
    return [(a, z, st, n) for (a, st, n), z in zip(found, ends)]


def decode_segment(block: dict, k: int, freq: np.ndarray) -> np.ndarray:
    """Token ids of segment ``k`` alone; raises ValueError where a checksum fails."""
    start, end, x, at = segments(block)[k]
    cum = np.concatenate([[np.uint64(0)], np.cumsum(freq)[:-1]]).astype(np.uint64)
    symbol = np.repeat(np.arange(len(freq), dtype=np.int64), freq.astype(np.int64))
    stream = np.frombuffer(block["payload"], "<u4").astype(np.uint64)
    x, out = x.copy(), np.zeros(end - start, dtype=np.int64)
    mask, p, word = np.uint64(TOTAL - 1), np.uint64(PRECISION), np.uint64(32)
    for done in range(0, end - start, LANES):
        n = min(LANES, end - start - done)
        slot = x[:n] & mask
        sym = symbol[slot.astype(np.int64)]
        out[done : done + n] = sym
        x[:n] = freq[sym] * (x[:n] >> p) + slot - cum[sym]
        need = np.flatnonzero(x[:n] < LOW)
        if len(need):
            # The encoder wrote these words lane by lane, so the step's words lie in lane order below ``at``.
            x[need] = (x[need] << word) | stream[at - len(need) : at]
            at -= len(need)
    if zlib.crc32(out.astype("<u4").tobytes()) != block["segment_crcs"][k]:
        raise ValueError("a segment's checksum differs")
    return out


def decode_block(block: dict, freq: np.ndarray) -> np.ndarray:
    """Token ids of a block; its payload's checksum is verified first."""
    if zlib.crc32(block["payload"]) != block["block_crc"]:
        raise ValueError("a block's checksum differs")
    parts = [decode_segment(block, k, freq) for k in range(len(segments(block)))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def token_table(docs: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian 16- or 32-bit integers, null for null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = tokens.encoding(vocabulary)
        wide = "<u2" if encode.max_token_value < 65536 else "<u4"
        ids = [None if t is None else np.array(encode.encode_ordinary(t), wide).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_batches(docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")), run, "doc_id long, ids binary")


def token_counts(ids: DataFrame, n: int, width: str) -> np.ndarray:
    """How often each of ``n`` token ids occurs in all of ``ids``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            joined = b"".join(b for b in batch.column(0).to_pylist() if b)
            total += np.bincount(np.frombuffer(joined, width), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["token", "n"])

    rows = ids.select("ids").mapInArrow(partial, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(n, dtype=np.int64)
    found = rows.toPandas()  # bounded by the vocabulary
    counts[found["token"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = tokens.VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of encoded token ids, and the row of their frequency table.

    One row of kind ``table`` (its payload is the table) and a row of kind
    ``block`` for each block: ``doc_ids``, ``pieces`` and ``counts`` list its
    documents in order, a long document's pieces being numbered from 0 over as many
    blocks as it needs.  Defined results: a null text has count -1 and an empty one
    count 0, so both come back as they were; null doc_ids, ties and repeated rows
    are kept as they are; an empty table gives the table row alone; other columns
    are ignored.  Texts are encoded whole.
    """
    spark = docs.sparkSession
    ids = working_table(token_table(docs, doc_id, text, vocabulary), "rans-ids")
    n = tokens.size(vocabulary)
    width = "<u2" if n <= 65536 else "<u4"
    freq = normalised(token_counts(ids, n, width))
    blob = table_bytes(freq)

    def flush(held: list[dict]) -> pa.RecordBatch:
        table = worker_cache().setdefault("rans_tables", {})
        if blob not in table:
            table.clear()
            table[blob] = table_from_bytes(blob)
        coded = encode_blocks([np.concatenate(h["ids"]) if h["ids"] else np.zeros(0, np.int64) for h in held], table[blob])
        rows = [{"kind": "block", "n_tokens": h["n"], "doc_ids": h["doc_ids"], "pieces": h["pieces"], "counts": h["counts"]} | c for h, c in zip(held, coded)]
        return pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        current: dict | None = None
        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left = None if raw is None else np.frombuffer(raw, width).astype(np.int64)
                piece = 0
                while True:
                    if current is None:
                        current = {"ids": [], "doc_ids": [], "pieces": [], "counts": [], "n": 0}
                    part = None if left is None else left[: block_tokens - current["n"]]
                    size = -1 if part is None else len(part)
                    current["doc_ids"].append(d)
                    current["pieces"].append(piece)
                    current["counts"].append(size)
                    if size > 0:
                        current["ids"].append(part)
                        current["n"] += size
                    if current["n"] >= block_tokens:
                        held.append(current)
                        current = None
                        if len(held) == TOGETHER:
                            yield flush(held)
                            held = []
                    if left is None or size == len(left):
                        break
                    left, piece = left[size:], piece + 1
        if current is not None:
            held.append(current)
        if held:
            yield flush(held)

    blocks = ids.mapInArrow(run, BLOCK_SCHEMA)
    head = spark.createDataFrame([("table", zlib.crc32(blob), len(freq), [], [], [], None, None, [], bytearray(blob))], BLOCK_SCHEMA)
    return head.unionByName(blocks)


def ARROW_SCHEMA() -> pa.Schema:
    return pa.schema([("kind", pa.string()), ("block_crc", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("states", pa.binary()), ("checkpoints", pa.binary()), ("segment_crcs", pa.list_(pa.int64())), ("payload", pa.binary())])


def decode(encoded: DataFrame) -> DataFrame:
    """(doc_id, piece, ids) of every piece in ``encode``'s rows; ids null for null."""
    heads = encoded.filter("kind = 'table'").select("payload").take(1)
    if not heads:
        raise ValueError("the row of the frequency table is missing")
    blob = bytes(heads[0][0])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        freq = table_from_bytes(blob)
        out = {"doc_id": [], "piece": [], "ids": []}
        for block in batch.to_pylist():
            ids, at = decode_block(block, freq), 0
            for d, p, c in zip(block["doc_ids"], block["pieces"], block["counts"]):
                out["doc_id"].append(d)
                out["piece"].append(p)
                out["ids"].append(None if c < 0 else ids[at : at + c].tolist())
                at += max(c, 0)
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    return map_batches(encoded.filter("kind = 'block'"), run, "doc_id long, piece int, ids array<int>")
