"""String similarities that Spark lacks, as Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [ch for ch, u in zip(b, used) if u]
    moved = sum(x != y for x, y in zip(mine, theirs)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    base, same = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return base + 0.1 * same * (1 - base)


def damerau(a: str, b: str) -> int:
    """Edits with transpositions of what may have been edited between."""
    last: dict[str, int] = {}
    most = len(a) + len(b)
    d = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        near = 0
        for j in range(1, len(b) + 1):
            k, l = last.get(b[j - 1], 0), near
            same = a[i - 1] == b[j - 1]
            if same:
                near = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + i - k - 1 + 1 + j - l - 1)
        last[a[i - 1]] = i
    return d[-1][-1]


def _pairs(fn, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype="object")

    return run


jaro_similarity = _pairs(jaro, T.DoubleType())
jaro_winkler_similarity = _pairs(jaro_winkler, T.DoubleType())
damerau_levenshtein = _pairs(damerau, T.LongType())


def _single(fn):
    @F.pandas_udf(T.StringType())
    def run(a: pd.Series) -> pd.Series:
        return a.map(fn, na_action="ignore")

    return run


strip_accents = _single(lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)))
nfc_normalize = _single(lambda s: unicodedata.normalize("NFC", s))

#: SQL name -> function, registered on a session by ``sources.tables.prepare_sql``.
UDFS = {
    "jaro_similarity": jaro_similarity,
    "jaro_winkler_similarity": jaro_winkler_similarity,
    "damerau_levenshtein": damerau_levenshtein,
    "strip_accents": strip_accents,
    "nfc_normalize": nfc_normalize,
}
