"""Versioned facts in long form: (key, version, path, value, ...). Diffs, upserts, conflicts and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paths that two readings must agree on before a sheet is published.
CRITICAL_PATHS = [
    "eligibility.free_care_max_fpl",
    "eligibility.discount_tiers",
    "eligibility.assistance_ceiling_fpl",
    "apply.window_days_from_first_bill",
    "programs.presumptive",
]
REVIEW_PERCENT = 400


def version_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, old, new) of the keys whose values differ; a missing row counts as null."""
    a = old.select(*keys, F.col(value).alias("old"))
    b = new.select(*keys, F.col(value).alias("new"))
    return a.join(b, keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], owned: list[str]) -> DataFrame:
    """``base`` with the ``owned`` columns of ``delta``, row by row; new keys are added, other columns stay.

    ``delta`` has one row per key, so two jobs can own different columns of the same row.
    """
    d = delta.select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in owned])
    out = base.join(d, keys, "full")
    values = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in owned else F.col(c) for c in base.columns if c not in keys]
    return out.select(*keys, *values)


def append_changed(versions: DataFrame, new: DataFrame, keys: list[str], path: str, value: str) -> DataFrame:
    """``new`` facts as the next version of each key that has any difference from its latest; unchanged keys are left out."""
    latest = versions.groupBy(*keys).agg(F.max("version").alias("version"))
    current = versions.join(latest, [*keys, "version"])
    changed = version_diff(current, new, [*keys, path], value).select(*keys).distinct()
    nextv = (F.coalesce(F.col("version"), F.lit(0)) + 1).alias("version")
    return new.join(changed, keys, "left_semi").join(latest, keys, "left").select(*keys, nextv, path, value)


def conflicts(first: DataFrame, second: DataFrame, third: DataFrame, keys: list[str], paths: list[str]) -> DataFrame:
    """(keys, path, first, second, third, verdict) of the critical paths on which two readings differ.

    A third reading settles it if it agrees with one of them; else the conflict stays open.
    """
    def of(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("path").isin(paths)).select(*keys, "path", F.col("value").alias(name))

    both = of(first, "first").join(of(second, "second"), [*keys, "path"]).where("first is not null and second is not null and first <> second")
    verdict = F.when(F.col("third") == F.col("first"), "primary").when(F.col("third") == F.col("second"), "secondary").otherwise("unsettled")
    return both.join(of(third, "third"), [*keys, "path"], "left").withColumn("verdict", verdict)


def inconsistencies(free: Column, tiers: Column, ceiling: Column, ruled: Column) -> Column:
    """Messages about income rules that contradict each other, in a fixed order."""
    from tallyworks.operators import bands

    has = F.coalesce(F.size(tiers) > 0, F.lit(False))
    tops = F.coalesce(F.array_max(F.transform(tiers, lambda b: b["high"])), F.lit(None).cast("double"))
    lowest = F.array_min(F.transform(tiers, lambda b: b["low"]))
    below = (ceiling < F.greatest(tops, free)) & ~ceiling.eqNullSafe(ruled)
    return F.array_compact(
        F.array(
            F.when(has & bands.rises(tiers), "discount rises with income"),
            F.when(below, "ceiling below own rules"),
            F.when(has & (F.size(bands.gaps(tiers, free)) > 0), "incomes without a rule"),
            F.when(has & (free > lowest), "free limit above first band"),
            F.when(~has & (free > REVIEW_PERCENT), "free limit reads like a ceiling"),
        )
    )


def status(n_conflicts: Column, n_holds: Column, free: Column, tiers: Column, ceiling: Column, problems: Column) -> Column:
    """published, unless there is a conflict, a hold, no income rule at all or an inconsistency."""
    ruleless = free.isNull() & ceiling.isNull() & tiers.isNull()
    return F.when((n_conflicts > 0) | (n_holds > 0) | ruleless | (F.size(problems) > 0), "held").otherwise("published")


def carry_over(new: DataFrame, previous: DataFrame, keys: list[str], layer: str = "reported") -> DataFrame:
    """``new`` facts and, where a path is missing, the previous version's facts of one layer."""
    old = previous.where(F.col("layer") == layer).join(new.select(*keys, "path"), [*keys, "path"], "left_anti")
    return new.unionByName(old.select(*new.columns))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that rejects; null if none does. The order of the rules is their meaning."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules])


def file_once(open_items: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New items whose keys no item has yet, open or closed, each once."""
    return new.dropDuplicates(keys).join(open_items.select(*keys), keys, "left_anti")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side beyond those of the other, counting repeats, with their sign."""
    cols = left.columns
    gone = left.exceptAll(right.select(*cols)).withColumn("sign", F.lit("-"))
    come = right.select(*cols).exceptAll(left).withColumn("sign", F.lit("+"))
    return gone.unionByName(come)
