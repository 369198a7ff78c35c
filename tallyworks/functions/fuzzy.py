"""Name similarity: the normalised indel ratio and the token-set ratio, as Arrow-batched functions.

``ratio`` is 100 * 2 * LCS / (|a| + |b|). ``token_set_ratio`` compares the words two names share with what each adds,
and is 100 when one name's words are all in the other. Block pairs before scoring them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    place: dict[str, int] = {}
    for i, ch in enumerate(a):
        place[ch] = place.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for ch in b:
        match = row & place.get(ch, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one = f"{both} {' '.join(sorted(x - y))}".strip()
    two = f"{both} {' '.join(sorted(y - x))}".strip()
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


def _scorer(score) -> object:
    def scores(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return scores


def ratio_of(a: str | Column, b: str | Column) -> Column:
    return F.pandas_udf(_scorer(ratio), T.DoubleType())(a, b)


def token_set_ratio_of(a: str | Column, b: str | Column) -> Column:
    return F.pandas_udf(_scorer(token_set_ratio), T.DoubleType())(a, b)
