"""Record linkage: cascades of equi-joins, blocked fuzzy matches, scored candidates and recursive origins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.operators.names import best_names
from tallyworks.store import materialise


@dataclass(frozen=True)
class Level:
    """One step of a cascade: rows meet where ``left`` and ``right`` expressions are equal, the first by ``order`` wins."""

    method: str
    confidence: float
    left: list[Column]
    right: list[Column]


def cascade(rows: DataFrame, key: str, targets: DataFrame, target: str, order: str, levels: list[Level]) -> DataFrame:
    """(key, target, method, confidence): the first level at which a row finds a target; unmatched rows have nulls.

    Each level joins only what the earlier ones left, blank or null expressions meet nothing, and of several
    targets the first in ``order`` is taken.
    """
    left_over = rows
    found = None
    for level in levels:
        names = [f"__k{i}" for i in range(len(level.left))]
        a = left_over.select(key, *[x.cast("string").alias(n) for x, n in zip(level.left, names, strict=True)])
        b = targets.select(F.col(target).alias("__target"), F.col(order).alias("__order"), *[x.cast("string").alias(n) for x, n in zip(level.right, names, strict=True)])
        filled = F.lit(True)
        for n in names:
            filled = filled & (F.col(n) != "")
        first = b.where(filled).groupBy(*names).agg(F.min_by("__target", "__order").alias("target"))
        got = a.join(first, names).select(key, "target", F.lit(level.method).alias("method"), F.lit(level.confidence).alias("confidence"))
        found = got if found is None else found.unionByName(got)
        left_over = left_over.join(got.select(key), key, "left_anti")
    return rows.select(key).join(found, key, "left")


def fuzzy_block(rows: DataFrame, key: str, name: Column, block: list[Column], targets: DataFrame, target: str, target_name: Column, target_block: list[Column], least: float) -> DataFrame:
    """(key, target, score): the best token-set score of at least ``least`` within equal, filled blocks."""
    names = [f"__b{i}" for i in range(len(block))]
    a = rows.select(key, name.alias("__a"), *[c.alias(n) for c, n in zip(block, names, strict=True)])
    b = targets.select(target, target_name.alias("__b"), *[c.alias(n) for c, n in zip(target_block, names, strict=True)])
    return best_names(a, key, F.col("__a"), b, target, F.col("__b"), names, [target], least=least, digits=12).drop("place")


def top_candidates(scored: DataFrame, key: str, score: str, tie: Column, n: int = 3, sure: float = 75.0, lead: float = 10.0) -> DataFrame:
    """The n best rows of each key with their place, and whether the first is confident.

    It is if its score is at least ``sure`` and it leads the second by ``lead`` or has no second.
    """
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), tie)
    ranked = scored.where(F.col(score) > 0).withColumn("place", F.row_number().over(w)).withColumn("__next", F.lead(score).over(w)).where(F.col("place") <= n)
    confident = (F.col("place") == 1) & (F.col(score) >= sure) & (F.col("__next").isNull() | (F.col(score) - F.col("__next") >= lead))
    return ranked.withColumn("confident", confident).drop("__next")


def first_of_each(targets: DataFrame, features: list[str], target: str, n: int = 3) -> DataFrame:
    """The first ``n`` targets of each combination of features: where scores only depend on features, no other can be among the best ``n``.

    Partial sorts keep at most ``n`` ids a combination before anything is shuffled together.
    """
    place = F.row_number().over(Window.partitionBy(*features).orderBy(target))
    return targets.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def origins(loans: DataFrame) -> DataFrame:
    """(borrower, origin) of (borrower, lender) edges: the lenders that borrow from nobody, through any chain.

    Chains are followed one step a round until no new pair turns up; cycles end because no pair is followed twice.
    A borrower whose chain only runs in a circle has its own lender as origin.
    """
    step = loans.select("borrower", F.col("lender").alias("at")).distinct()
    seen = materialise(step)
    fresh = seen
    while True:
        further = fresh.join(loans.select(F.col("borrower").alias("at"), "lender"), "at").select("borrower", F.col("lender").alias("at")).distinct()
        fresh = materialise(further.join(seen, ["borrower", "at"], "left_anti"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    roots = loans.select(F.col("borrower").alias("at")).distinct()
    found = seen.join(roots, "at", "left_anti").select("borrower", F.col("at").alias("origin"))
    return found.unionByName(step.join(found, "borrower", "left_anti").select("borrower", F.col("at").alias("origin")))
