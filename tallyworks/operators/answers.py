"""Cases answered from bill to deadline, and the ledger's figures as people say them.

``answered`` puts the rules in their order: cost-sharing that no one may bill, the hospital's published sheet, the payee,
the household's income, the clocks that the bill has started. Every case comes back with the step that it has reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.operators import cases as of_cases
from tallyworks.operators import rules

# Statuses of cases that no answer is due to yet, tiers that are predictions, and documents where a sheet names none.
UNREAD = ["new", "bill_read"]
PREDICTED = ["free", "discount", "assistance", "not_eligible"]
DEFAULT_DOCUMENTS = ["proof_of_income", "photo_id"]


def deadline_anchor(first: Column, stated: Column, is_first: Column, collections: Column) -> dict[str, Column]:
    """``anchor``, the day from which the clocks run, and ``confirmed``, whether it is known to be the first bill's.

    A first bill's date that was entered is; a statement's own date is if it is marked as the first and has no
    collection language.
    """
    sure = first.isNotNull() | (F.coalesce(is_first, F.lit(False)) & ~F.coalesce(collections, F.lit(False)))
    return {"anchor": F.coalesce(first, stated), "confirmed": sure & F.coalesce(first, stated).isNotNull()}


def answered(cases: DataFrame, sheets: DataFrame, listed: DataFrame, today: Column) -> DataFrame:
    """One row a case: ``step``, ``tier``, ``discount``, ``payee``, the clocks, and ``predicts``, whether it is kept as a prediction.

    Steps in order, the first that holds: unread (no answer is due), cost_sharing (no one may bill it, whatever the
    sheet), no_hospital, needs_scouting (no sheet), under_review (the newest sheet is held; an older published one
    doesn't answer), ship and payee_request (an outside payee that the hospital's list doesn't name), answered.

    ``cases``: case_id, status, state, ccn, programs, size, income, payee_kind, payee_name, statement_date,
    first_statement_date, is_first_statement, collection_notice, collection_notice_date, predicted (already).
    ``sheets``: ccn, version, status, free, tiers, ceiling, residency, presumptive, window_days, wait_days.
    ``listed``: ccn, provider, place. Today is a date.
    """
    c = F.col
    rest = [x for x in sheets.columns if x != "ccn"]
    newest = sheets.groupBy("ccn").agg(F.max_by(F.struct(*rest), "version").alias("s"))
    routes = of_cases.payee_routes(cases.select("case_id", "ccn", "payee_kind", "payee_name"), listed, "case_id").select("case_id", "route", c("listed").alias("__listed"))
    rows = cases.join(newest, "ccn", "left").join(routes, "case_id", "left")
    protected = of_cases.cost_sharing_protected(c("programs"))
    step = (
        F.when(c("status").isin(UNREAD), "unread").when(protected, "cost_sharing").when(c("ccn").isNull(), "no_hospital").when(c("s").isNull(), "needs_scouting")
        .when(c("s.status") != "published", "under_review").when(c("route").isin("ship", "payee_request"), c("route")).otherwise("answered")
    )
    percent = rules.fpl_percent(c("income"), F.coalesce(F.nullif("size", F.lit(0)), F.lit(1)), c("state"))
    decided = rules.eligibility(percent, c("state"), F.coalesce("programs", F.array().cast("array<string>")), c("s.residency"), c("s.free"), c("s.tiers"), c("s.ceiling"), c("s.presumptive"))
    rows = rows.withColumns({"step": step, **deadline_anchor(c("first_statement_date"), c("statement_date"), c("is_first_statement"), c("collection_notice"))})
    is_answer = c("step") == "answered"
    rows = rows.withColumn("__d", F.when(is_answer, decided))
    outside = c("payee_kind").isin(of_cases.OUTSIDE_POLICY)
    payee = F.when(c("step").isin("ship", "payee_request") | ((c("step") == "cost_sharing") & outside), c("payee_name")).when(is_answer & (c("route") == "covered"), c("__listed"))
    clocks = rules.deadlines(c("anchor"), today, c("s.window_days"), c("s.wait_days"), c("collection_notice_date"), c("confirmed"))
    return rows.select(
        "case_id", "step", c("__d.tier").alias("tier"), c("__d.discount").alias("discount"), payee.alias("payee"), *[F.when(is_answer & c("anchor").isNotNull(), v).alias(k) for k, v in clocks.items()],
        F.coalesce(is_answer & c("__d.tier").isin(PREDICTED) & ~F.coalesce("predicted", F.lit(False)), F.lit(False)).alias("predicts"),
    )


# Least ranks and the fractions that they are told as, from the top down.
ABOVE = [(0.9, "9 in 10"), (0.8, "4 in 5"), (0.75, "3 in 4"), (0.67, "2 in 3"), (0.55, "half of")]
BELOW = [(0.33, "half of"), (0.25, "2 in 3"), (0.2, "3 in 4"), (0.1, "4 in 5")]
MIDDLE, MOST = 0.45, "9 in 10"


def rank_phrase(rank: Column, noun: str = "nonprofit hospitals") -> Column:
    """A rank as a fraction of hospitals that this one is above or below; empty without a rank."""
    told = F.when(rank.isNull(), "")
    for floor, words in ABOVE:
        told = told.when(rank >= floor, f"above {words} {noun}")
    told = told.when(rank > MIDDLE, f"about the middle of {noun}")
    for floor, words in BELOW:
        told = told.when(rank >= floor, f"below {words} {noun}")
    return told.otherwise(f"below {MOST} {noun}")


def number_phrase(value: Column) -> Column:
    """One decimal, a whole number without."""
    return F.regexp_replace(F.format_string("%.1f", value.cast("double")), r"\.0$", "")


def percent_phrase(value: Column) -> Column:
    return F.concat(number_phrase(value), F.lit("%"))


def level_phrase(value: Column) -> Column:
    return F.concat(number_phrase(value), F.lit("% of the poverty level"))


def month_phrase(day: Column) -> Column:
    return F.date_format(day, "MMMM yyyy")


def count_phrase(n: Column) -> Column:
    """A count to the nearest 10 above a thousand and 100 above ten thousand, halves to even, with separators."""
    step = F.when(n > 10_000, 100).when(n > 1_000, 10).otherwise(1)
    return F.format_number((F.bround(n / step, 0) * step).cast("bigint"), 0)


def joined_phrase(parts: Column) -> Column:
    """ "a", "a and b", "a, b and c"."""
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) == 0, "").when(F.size(parts) == 1, last).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", "), F.lit(" and "), last))
