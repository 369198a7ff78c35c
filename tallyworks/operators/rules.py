"""Decision tables: poverty percentages, eligibility, deadlines, triage, payees, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.operators import bands

# Poverty guidelines of 2026 by region, base and for each further person.
GUIDELINES = {"contiguous": (15960, 5680), "AK": (19950, 7100), "HI": (18360, 6530)}
WINDOW_DAYS = 240
WAIT_DAYS = 120
# Reasons for a denial that lie with the application, in the order they are told.
CASE_ISSUES = ["incomplete", "late", "unsigned", "income_too_high", "missing_documents", "assets_too_high"]
CHECK_INS = [14, 30, 45]
RETENTION_ABANDONED_DAYS = 1


def poverty_guideline(state: Column, size: Column) -> Column:
    """Yearly income at the poverty line of a household of at least one."""
    people = F.greatest(size, F.lit(1)) - 1
    line = lambda k: F.lit(GUIDELINES[k][0]) + people * GUIDELINES[k][1]
    s = F.upper(state)
    return F.when(s == "AK", line("AK")).when(s == "HI", line("HI")).otherwise(line("contiguous")).cast("decimal(18,2)")


def fpl_percent(income: Column, size: Column, state: Column) -> Column:
    """Income in percent of the poverty line, two decimals, halves up; a negative income is an error."""
    amount = F.when(income < 0, F.raise_error(F.lit("income is negative"))).otherwise(income).cast("decimal(18,2)")
    return F.round(amount * 100 / poverty_guideline(state, size), 2).cast("decimal(18,2)")


def eligibility(
    percent: Column, state: Column, programs: Column, residency: Column, free_limit: Column, tiers: Column, ceiling: Column, presumptive: Column
) -> Column:
    """struct(tier, discount): the first rule that decides, in this order.

    Residents of other states are not eligible. Members of a listed programme get free care, or assistance where a
    ceiling is all that is documented. Without income rules it is unknown, without an income more information is
    needed. A ceiling alone gives assistance up to it. A paid band decides before the free limit. An income that no
    band names below the top is unknown; above it, not eligible.
    """
    has_tiers = F.coalesce(F.size(tiers) > 0, F.lit(False))
    only_ceiling = free_limit.isNull() & ~has_tiers & ceiling.isNotNull()
    enrolled = F.coalesce(F.arrays_overlap(F.transform(programs, lambda p: F.lower(p)), F.transform(presumptive, lambda p: F.lower(p))), F.lit(False))
    elsewhere = residency.isNotNull() & ~F.coalesce(F.exists(residency, lambda s: F.upper(s) == F.upper(state)), F.lit(False))
    band = bands.band_of(tiers, percent)
    top = F.coalesce(F.when(has_tiers, F.array_max(F.transform(tiers, lambda b: b["high"]))), free_limit)
    out = lambda tier, discount=None: F.struct(F.lit(tier).alias("tier"), F.lit(discount).cast("double").alias("discount"))
    return (
        F.when(elsewhere, out("not_eligible"))
        .when(enrolled & only_ceiling, out("assistance"))
        .when(enrolled, out("free", 100.0))
        .when(free_limit.isNull() & ~has_tiers & ceiling.isNull(), out("unknown"))
        .when(percent.isNull(), out("needs_info"))
        .when(only_ceiling & (percent <= ceiling), out("assistance"))
        .when(only_ceiling, out("not_eligible"))
        .when(has_tiers & band.isNotNull(), F.struct(F.lit("discount").alias("tier"), band["percent"].cast("double").alias("discount")))
        .when(percent <= free_limit, out("free", 100.0))
        .when(percent <= top, out("unknown"))
        .otherwise(out("not_eligible"))
    )


def deadlines(first: Column, today: Column, window: Column, wait: Column, notice: Column, confirmed: Column) -> dict[str, Column]:
    """The last day to apply, the first day of collections, days left, and whether a notice came too early.

    The last is null without a notice or while the first bill's date is not confirmed.
    """
    last = F.date_add(first, F.greatest(F.coalesce(window, F.lit(WINDOW_DAYS)), F.lit(WINDOW_DAYS)).cast("int"))
    collect = F.date_add(first, F.greatest(F.coalesce(wait, F.lit(WAIT_DAYS)), F.lit(WAIT_DAYS)).cast("int"))
    return {
        "application_deadline": last, "collections_from": collect, "days_left": F.datediff(last, today),
        "notice_too_early": F.when(confirmed & notice.isNotNull(), notice < collect),
    }


def triage(tier: Column, decision: Column, reasons: Column, requested: Column, expected: Column, changed: Column) -> Column:
    """struct(kind, matched, new_documents, slip, rescout): what an outcome says about the prediction.

    ``matched`` is null where the outcome doesn't test it. ``changed`` says that the rules have a newer version.
    """
    fresh = F.filter(F.array_except(requested, expected), lambda d: d != "other")
    case = (F.size(reasons) > 0) & (F.size(F.array_except(reasons, F.array(*map(F.lit, CASE_ISSUES)))) == 0)
    denied, partial = decision == "denied", decision == "partial"

    def out(kind: Column | str, matched: bool | None, new: Column = fresh, slip: Column | None = None, rescout: Column | bool = False) -> Column:
        return F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(matched).cast("boolean").alias("matched"), new.alias("new_documents"),
            (F.lit(None).cast("string") if slip is None else slip).alias("slip"), (F.lit(rescout) if isinstance(rescout, bool) else rescout).alias("rescout"),
        )

    none = F.array().cast("array<string>")
    return (
        F.when(decision == "more_info", out(F.when(F.size(fresh) > 0, "sheet_missing").otherwise("matched"), None))
        .when((tier == "not_eligible") & denied, out("matched", True, none))
        .when(tier == "not_eligible", out("sheet_wrong", False, none, rescout=~changed))
        .when((decision == "approved") | (partial & tier.isin("discount", "assistance")), out("matched", True))
        .when(denied & case, out("case_issue", None))
        .when(denied & (tier == "assistance"), out("case_issue", None))
        .when(changed, out("sheet_wrong", False))
        .otherwise(out("hospital_slip", False, slip=F.when(partial, "partial_despite_free").otherwise("denied_despite_policy"), rescout=True))
    )


def priority(staleness: Column, demand: Column, accuracy: Column) -> Column:
    """Days since the last look by demand by inaccuracy (half where unknown), each with a floor."""
    doubt = F.greatest(F.lit(0.2), 1.0 - F.coalesce(accuracy, F.lit(0.5)))
    return F.bround(F.greatest(F.lit(1), staleness) * F.greatest(F.lit(1), demand) * doubt, 2)


def weighted_priority(score: Column, weight: float, rank: Column) -> Column:
    """A priority raised by an exposure rank; unranked rows keep theirs."""
    return F.bround(score * (1 + weight * F.coalesce(rank, F.lit(0.0))), 2)


def due_check_in(days: Column, answered: Column) -> Column:
    """The latest check-in day that has come and was not answered; null if none."""
    return F.array_max(F.filter(F.array(*map(F.lit, CHECK_INS)), lambda d: (d <= days) & ~F.array_contains(answered, d)))


def respond_deadline(respond_by: Column, decided: Column, within: Column) -> Column:
    return F.coalesce(respond_by, F.date_add(decided, within))


def flag_level(cases: Column) -> Column:
    """What a number of different cases allows: 5 public, 3 internal, else nothing."""
    return F.when(cases >= 5, "public").when(cases >= 3, "internal")


def purge(cases: DataFrame, today: Column, link_days: int) -> DataFrame:
    """Cases without those past their link's life and those abandoned new and unsealed for more than a day."""
    age = F.datediff(today, F.to_date("updated_at"))
    abandoned = (F.col("status") == "new") & F.col("sealed").isNull() & (age > RETENTION_ABANDONED_DAYS)
    return cases.where(~F.coalesce((age > link_days) | abandoned, F.lit(False)))
