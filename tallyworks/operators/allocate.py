"""Share-weighted allocation of place totals to providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def service_counts(rows: DataFrame, provider: str, place: str, cases: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three aggregates of one scan: cases by (provider, place), by place over all providers, suppressed by provider.

    Blank places are not counted; a null count is a suppressed row, counted even where its place is blank.
    """
    placed = rows.where(F.col(cases).isNotNull() & (F.coalesce(F.col(place).cast("string"), F.lit("")) != ""))
    by_pair = placed.groupBy(provider, place).agg(F.sum(cases).alias("cases"))
    by_place = by_pair.groupBy(place).agg(F.sum("cases").alias("place_cases"))
    suppressed = rows.groupBy(provider).agg(F.count_if(F.col(cases).isNull()).alias("suppressed"))
    return by_pair, by_place, suppressed


def allocate(by_pair: DataFrame, by_place: DataFrame, weights: DataFrame, provider: str, place: str, weight: str) -> DataFrame:
    """(provider, served, places): each place's weight by the share of its cases that a provider has.

    A place without a weight counts as zero, one without cases is skipped; see ``with_all_providers`` for providers
    without any. ``weights`` has one row per place.
    """
    part = F.coalesce(F.col(weight), F.lit(0)) * F.col("cases") / F.nullif(F.col("place_cases"), F.lit(0))
    joined = by_pair.join(by_place, place).join(weights.select(place, weight), place, "left")
    return joined.groupBy(provider).agg(F.sum(part).alias("served"), F.count("*").alias("places"))


def with_all_providers(providers: DataFrame, served: DataFrame, provider: str) -> DataFrame:
    """Every provider's row of ``allocate``; one without places has a null served and 0 places."""
    return providers.select(provider).distinct().join(served, provider, "left").withColumn("places", F.coalesce("places", F.lit(0)))


def dual_part(whole: str, dual: str, of: str) -> Column:
    """whole * dual / of; null unless all are known and ``of`` is not zero."""
    return F.try_divide(F.col(whole) * F.col(dual), F.col(of))
