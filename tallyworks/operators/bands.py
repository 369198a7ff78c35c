"""Income bands: arrays of struct(low, high, percent), each open below and closed above."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_STEP = 1


def by_low(bands: Column) -> Column:
    return F.array_sort(bands, lambda a, b: F.when(a["low"] < b["low"], -1).when(a["low"] > b["low"], 1).otherwise(0))


def band_of(bands: Column, value: Column) -> Column:
    """The first band that holds a value; a band from 0 starts at no income at all. Null if none does."""
    inside = F.filter(bands, lambda b: ((value > b["low"]) | ((b["low"] == 0) & (value >= 0))) & (value <= b["high"]))
    return F.get(inside, F.lit(0))


def gaps(bands: Column, covered: Column) -> Column:
    """Ranges (from, to) that no band covers, above ``covered`` (may be null) and between bands, past a label's step."""
    start = F.struct(covered.cast("double").alias("top"), F.array().cast("array<struct<from:double,to:double>>").alias("out"))

    def step(state: Column, b: Column) -> Column:
        low, high = b["low"].cast("double"), b["high"].cast("double")
        gap = (state["top"].isNotNull()) & (low > state["top"] + LABEL_STEP)
        found = F.array(F.struct(state["top"].alias("from"), low.alias("to")))
        return F.struct(
            F.greatest(state["top"], high).alias("top"),
            F.when(gap, F.concat(state["out"], found)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(by_low(bands), start, step, lambda s: s["out"])


def rises(bands: Column) -> Column:
    """Whether some band gives more than the one below it."""
    b = by_low(bands)
    pairs = F.arrays_zip(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))).alias("a"), F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))).alias("b"))
    return F.coalesce(F.exists(pairs, lambda p: p["b"]["percent"] > p["a"]["percent"]), F.lit(False))


def overlaps(bands: Column) -> Column:
    """Whether some band starts below the end of the one before it, or ends before it starts."""
    b = by_low(bands)
    pairs = F.arrays_zip(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))).alias("a"), F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))).alias("b"))
    return F.coalesce(F.exists(pairs, lambda p: p["b"]["low"] < p["a"]["high"]) | F.exists(b, lambda x: x["high"] <= x["low"]), F.lit(False))
