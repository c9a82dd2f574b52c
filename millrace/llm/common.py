"""What the operators of this subpackage share."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.shipping import share

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Lower-case word tokens of a whole text."""
    return WORD.findall(text.lower())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``'s, one for each given name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"_mr_{name}"
        while candidate.lower() in taken:
            candidate += "_"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_key(text: Column) -> Column:
    """128 bits of a text's content as a struct of two longs; null for null."""
    return F.when(
        text.isNotNull(),
        F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1), F.length(text)).alias("b")),
    )


#: Rows that a Python function sees at once: its objects, not Arrow's buffers, fill a worker.
ROWS_AT_ONCE = 1000


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from batch to batch (None: no rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = fn(batch.slice(at, ROWS_AT_ONCE))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


#: Bits of the largest filter of keys that is sent to workers: 64 MB.
FILTER_BITS = 1 << 29


def key_filter(keys: DataFrame, name: str) -> Callable[[Column], Column] | None:
    """A condition that holds for every one of ``keys`` (longs) and for few others.

    A bitmap of 16 bits a key, built by partial aggregation and broadcast; None where
    it would be larger than FILTER_BITS.  Rows that fail it need no join with the keys.
    """
    import numpy as np

    bits = 1 << max(15, math.ceil(math.log2(16 * max(keys.count(), 1))))
    if bits > FILTER_BITS:
        return None
    place = F.pmod(F.col(name), F.lit(bits)) + 1
    parts = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    table = np.zeros(bits // 8, np.uint8)
    for b, m in parts.collect():
        table[(b - 1) * 4096 : (b - 1) * 4096 + len(m)] = np.frombuffer(m, np.uint8)
    get = share(keys.sparkSession, table)

    @F.pandas_udf("boolean")
    def held(key: pd.Series) -> pd.Series:
        at = key.to_numpy() % bits
        return pd.Series((get()[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return held


def text_buffers(column: pa.Array) -> tuple:
    """(bytes, offsets) of a string column without nulls, as numpy arrays."""
    import numpy as np

    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def portions(offsets, size: int = 1 << 18):
    """(first, end) of runs of rows of ``size`` bytes at most, or of one row."""
    import numpy as np

    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end
        at = end


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Runs of equal keys in batches that arrive sorted by ``key`` (not null)."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    current: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            value = keys[start]
            if held and value != current:
                yield current, held
                held = []
            current = value
            held.append(batch.slice(start, end - start))
    if held:
        yield current, held
