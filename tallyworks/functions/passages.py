"""Passages of long texts under a budget of characters: windows around keywords, taken greedily, overlaps merged."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The budget, what of it goes to a text's begin, the reach of a window, what stands between passages, and
# keywords, the most telling first.
LIMIT, HEAD, RADIUS, BETWEEN = 40_000, 6_000, 1_500, "\n[…]\n"
KEYWORDS = (r"poverty|fpl|fpg|free care|sliding|240 days|120 days", r"charity|discount|eligib", r"collection|application|apply")


class Spans:
    """Disjoint, sorted stretches of a text and the budget that is left for more."""

    def __init__(self, head: int, budget: int) -> None:
        self.starts, self.ends, self.budget = [0], [head], budget

    def take(self, start: int, end: int) -> None:
        """Add a stretch if what it adds, and the mark of a new passage, can be paid for; stretches that touch become one."""
        lo, hi = bisect_left(self.ends, start), bisect_right(self.starts, end)  # those that touch it
        covered = sum(min(end, self.ends[k]) - max(start, self.starts[k]) for k in range(lo, hi))
        cost = end - start - covered
        if not cost:
            return
        cost += len(BETWEEN) if lo == hi else 0
        if cost <= self.budget:
            self.budget -= cost
            self.starts[lo:hi] = [min([start, *self.starts[lo:hi]])]
            self.ends[lo:hi] = [max([end, *self.ends[lo:hi]])]


def chosen(text: str, patterns: Iterable[re.Pattern[str]], limit: int, head: int, radius: int) -> list[tuple[int, int]]:
    """(start, end) of what is kept of a text: all of it within the limit, else its head and windows by keyword."""
    if len(text) <= limit:
        return [(0, len(text))]
    spans = Spans(min(head, len(text)), limit - min(head, len(text)))
    for pattern in patterns:
        for found in pattern.finditer(text):
            spans.take(max(0, found.start() - radius), min(len(text), found.end() + radius))
    return list(zip(spans.starts, spans.ends, strict=True))


def spans_of(text: str | Column, keywords: tuple[str, ...] = KEYWORDS, limit: int = LIMIT, head: int = HEAD, radius: int = RADIUS) -> Column:
    """array of (start, end), code points from 0, ends exclusive: what ``chosen`` keeps; null for a null text.

    The work grows with a text's length and, for each keyword in it, with the passages kept, of which the budget bounds
    the number.
    """
    patterns = [re.compile(k, re.IGNORECASE) for k in keywords]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"start": a, "end": b} for a, b in chosen(t, patterns, limit, head, radius)] for t in texts], dtype=object)

    return each(F.col(text) if isinstance(text, str) else text)


def selected(text: Column, spans: Column) -> Column:
    """The stretches of a text, as written, with BETWEEN between them."""
    return F.array_join(F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), BETWEEN)
