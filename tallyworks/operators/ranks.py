"""Ranks and choices of one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.operators.skew import join_counted
from tallyworks.store import materialise

GAP = 0.25
FULL_YEAR_DAYS = 300
#: Different values of a range.
RANGE = 100_000


def percentile_ranks(df: DataFrame, value: str, out: str, peers: str | None = None) -> DataFrame:
    """Add the share of the other rows with a strictly lower value; ties share it.

    Null values are not ranked and not counted, and a value without others to compare with has no rank. ``peers``
    names a column for how many are ranked. ``df`` is worked out once, into a table. Ranks come from counts per distinct
    value, so the rows themselves are never gathered: the running sum is taken in two levels, ranges of about RANGE
    different values and values within one, and rows of a very frequent value get its rank where they lie.
    """
    rows = materialise(df)
    counts = materialise(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n")))
    different, everything = counts.agg(F.count("*"), F.sum("__n")).first()
    ranged = counts.repartitionByRange(max(1, -(-different // RANGE)), "__v").withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged) if different > RANGE else ranged  # ranges are drawn from a sample, and must not be drawn twice
    inner = Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(F.sum("__n").alias("__size"))  # one row a range from here on
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"))
    low = F.coalesce(F.sum("__n").over(inner), F.lit(0))
    others = F.lit((everything or 0) - 1)
    ranks = ranged.withColumn("__low", low).join(F.broadcast(bases), "__part").select(
        F.col("__v").alias(value), "__n", ((F.col("__base") + F.col("__low")) / F.nullif(others, F.lit(0))).alias(out),
        *([F.when(others > 0, others + 1).alias(peers)] if peers else []),
    )
    return join_counted(rows, ranks, [value], "__n", everything or 0, "left").select(*df.columns, out, *([peers] if peers else []))


def gap_label(gap: str | Column) -> Column:
    """How a promise compares with what is delivered, from the difference of their ranks."""
    g = F.col(gap) if isinstance(gap, str) else gap
    return F.when(g >= GAP, "promises_more").when(g <= -GAP, "promises_less").when(g.isNotNull(), "delivers")


def third_label(rank: str | Column) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r >= 2 / 3, "high").when(r >= 1 / 3, "medium").when(r.isNotNull(), "low")


def share_percent(part: str | Column, whole: str | Column, places: int = 4) -> Column:
    """part of whole in percent; null unless both are known and the whole is positive."""
    p, w = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.when(w > 0, F.bround(p / w * 100, places))


def sum_of_known(*parts: str | Column) -> Column:
    """The sum of the parts that are known; null only if none is."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.when(F.coalesce(*cols).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0))))


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should end in a tie-breaker."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Each key's row of the highest version, by a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__top"))
    return top.select(*keys, *[F.col("__top")[c].alias(c) for c in rest])


def one_report_per_year(reports: DataFrame, key: str, begin: str, end: str, tie: list[Column]) -> DataFrame:
    """One report per key and fiscal year, the year its period ends in: the longest, then the latest."""
    dated = reports.withColumns({"fiscal_year": F.year(end), "period_days": F.datediff(end, begin)})
    return best_row(dated, [key, "fiscal_year"], [F.col("period_days").desc(), F.col(end).desc(), *tie])


def best_report(reports: DataFrame, key: str) -> DataFrame:
    """Each key's newest report of a full year, else its newest of any length."""
    full = (F.col("period_days") >= FULL_YEAR_DAYS).cast("int")
    return best_row(reports, [key], [full.desc(), F.col("fiscal_year").desc()])
