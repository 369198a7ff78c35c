"""Stored sheets held to the rules as they are now: what would go, and the versions without it, from one plan.

The latest versions are verified a second time over their stored quotes and texts. The plan says for each sheet what is
cut and rejected, what an owner's ruling saves, and the status that is left; the what-if and the new versions are both
read from it, so they can't disagree, and a plan made of applied versions is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import poverty
from tallyworks.functions.text import normal_of
from tallyworks.operators import facts as f
from tallyworks.operators import verify, wording
from tallyworks.store import materialise

# Reasons that hold a whole sheet, always or while its table of discounts stays, and the one that a ruling wins over.
FREE_BAND = "quote states the free-care band, not the ceiling"
HOLDING = ["quote states the patient's share, not a discount", FREE_BAND, "quote states the band for another state's facilities, named by its postal code"]
HOLDING_BESIDE_A_TABLE = ["quote charges the patient within the free band", "the document gives full assistance to a band above this limit"]
LISTS = [wording.DOCUMENTS, wording.CHANNELS, wording.PROGRAMS, wording.PROVIDERS]
PUBLISHED, HELD = "published", "held"
FACT = ["path", "layer", "state", "source_id", "quote", "value", "number", "flag", "items", "tiers"]


def grounded(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """``facts`` with lists cut to the items that their quotes name, and ``pruned``, a note, where one was cut or emptied.

    A list of which nothing is named has null items. Reported facts, those without a quote and those whose source isn't
    stored stay as they are.
    """
    c = F.col
    known = texts.select("source_id", F.lit(True).alias("__known")).distinct()
    rows = facts.join(known, "source_id", "left").withColumn("__said", normal_of(F.coalesce("quote", F.lit(""))))
    plain = F.transform(F.split(normal_of(F.array_join("items", verify.PARTED, "")), verify.PARTED), F.trim)
    rows = rows.withColumn("__items", plain)
    named = wording.named_items(c("path"), c("__said"), c("items"), c("__items"))
    none = wording.list_problem(c("path"), c("__said"), c("items"), c("__items"))
    rows = rows.withColumns({"__named": named, "__why": none})
    held = c("path").isin(LISTS) & (c("layer") != "reported") & (c("quote") != "") & c("__known") & c("items").isNotNull()
    gone = F.size("items") - F.size("__named")
    note = F.when(F.size("__named") == 0, F.concat(c("path"), F.lit(": "), c("__why"), F.lit(" (after trimming)"))).when(
        gone > 0, F.concat(c("path"), F.lit(": "), gone.cast("string"), F.when(gone > 1, " items").otherwise(" item"), F.lit(" not named in the trimmed quote"))
    )
    pruned = F.when(F.coalesce(held, F.lit(False)), note)
    rows = rows.withColumn("pruned", pruned)
    items = F.when(c("pruned").isNull(), c("items")).when(F.size("__named") > 0, c("__named"))
    return rows.select(*[items.alias(x) if x == "items" else x for x in facts.columns], "pruned")


def _after_ruling(rows: DataFrame, ruled: Column) -> DataFrame:
    """``rows`` with ``__late``: why a ruled ceiling falls in spite of its ruling, by the tests after the reading that the ruling wins over."""
    c = F.col
    rows = rows.withColumn("__said", normal_of(F.when(ruled, c("quote")))).withColumn("__text", poverty.poverty_text(c("__said")))
    bands = F.lit(None).cast("array<struct<low:double,high:double,percent:double>>")
    late = F.coalesce(wording.own_help_problem(c("__text")), wording.income_limit_problem(c("__said"), c("__text"), c("quote"), c("state"), bands, c("number")))
    return rows.withColumn("__late", F.when(ruled, late)).drop("__said", "__text")


def plan(sheets: DataFrame, facts: DataFrame, texts: DataFrame, set_aside: DataFrame, rulings: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sheets, facts) of a second look at the latest versions.

    ``sheets``: sheet, version, status, one latest version each. ``facts``: sheet and FACT, one a path. ``rulings``:
    sheet, decision, value, decided_at. ``problems``: sheet, problem (an unconfirmed place or website), which count for
    published sheets. The sheets come back with ``rejected`` (path, reason), ``pruned`` notes, ``inconsistent`` messages,
    ``problems``, ``holds``, ``conflicts`` (path, reason, ruled_value, decided_at) for the owner, ``new_status`` and
    ``changed``; the facts with ``pruned`` and ``reasons``, empty for those that stay.
    """
    c = F.col
    rows = grounded(facts, texts)
    emptied = c("pruned").isNotNull() & c("items").isNull()
    kept = rows.where(~emptied).withColumn("key", F.concat_ws(" ", "sheet", "path"))
    seen = verify.checked(kept, texts, set_aside)
    ruled = rulings.where("decision = 'discount'").select("sheet", c("value").try_cast("decimal(18,2)").alias("ruled_value"), "decided_at").where("ruled_value is not null")
    seen = seen.join(ruled, "sheet", "left")
    spared = F.coalesce((c("path") == verify.CEILING) & (c("reason") == FREE_BAND) & (c("number") == c("ruled_value")), F.lit(False))
    seen = _after_ruling(seen.withColumn("__spared", spared), c("__spared"))
    overruled = c("__spared") & c("__late").isNull()
    reasons = F.when(overruled, F.array().cast("array<string>")).otherwise(F.array_compact(F.array("reason", "__late")))
    conflict = lambda reason: F.struct(F.lit(verify.CEILING).alias("path"), reason.alias("reason"), c("ruled_value"), c("decided_at"))
    seen = materialise(seen.withColumns({"reasons": reasons, "__conflict": F.when(overruled, conflict(F.lit(FREE_BAND)))}))
    stays = F.size("reasons") == 0
    number = lambda path: F.max(F.when((c("path") == path) & stays, c("number").cast("double")))
    each = F.flatten(F.collect_list(F.transform("reasons", lambda r: F.struct(c("path"), r.alias("reason")))))
    told = seen.groupBy("sheet").agg(
        F.array_sort(each).alias("rejected"), number(verify.FREE).alias("free"), number(verify.CEILING).alias("ceiling"), F.max(F.when((c("path") == verify.TIERS) & stays, c("tiers"))).alias("tiers"),
        F.collect_list("__conflict").alias("overruled"), F.first("ruled_value", ignorenulls=True).alias("ruled_value"), F.first("decided_at", ignorenulls=True).alias("decided_at"),
    )
    notes = rows.where("pruned is not null").groupBy("sheet").agg(F.array_sort(F.collect_list("pruned")).alias("pruned"))
    out = sheets.join(told, "sheet", "left").join(notes, "sheet", "left").join(problems.groupBy("sheet").agg(F.array_sort(F.collect_set("problem")).alias("problems")), "sheet", "left")
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind))
    out = out.withColumns({"rejected": none("rejected", "array<struct<path:string,reason:string>>"), "pruned": none("pruned", "array<string>"), "overruled": F.coalesce("overruled", F.filter(F.array(conflict(F.lit(""))), lambda _: F.lit(False)))})
    own = F.when(c("ceiling") == c("ruled_value"), c("ceiling"))
    published = c("status") == PUBLISHED
    against = lambda by: f.inconsistencies(c("free"), c("tiers"), c("ceiling"), by)
    out = out.withColumn("inconsistent", against(own.cast("double"))).withColumn("__all", against(F.lit(None).cast("double")))
    more = F.when(own.isNotNull(), F.transform(F.array_except("__all", "inconsistent"), conflict))
    out = out.withColumns({"conflicts": F.concat("overruled", F.coalesce(more, F.filter("overruled", lambda _: F.lit(False)))), "inconsistent": F.when(published, c("inconsistent")).otherwise(F.array().cast("array<string>")), "problems": F.when(published, none("problems", "array<string>")).otherwise(F.array().cast("array<string>"))})
    holding = F.array_distinct(F.transform(F.filter("rejected", lambda x: x["reason"].isin(HOLDING) | (x["reason"].isin(HOLDING_BESIDE_A_TABLE) & c("tiers").isNotNull())), lambda x: x["reason"]))
    out = out.withColumn("holds", F.concat(holding, "problems"))
    status = F.when(published, f.status(F.lit(0), F.size("holds"), c("free"), c("tiers"), c("ceiling"), c("inconsistent"))).otherwise(HELD)
    changed = (F.size("pruned") > 0) | (F.size("rejected") > 0) | (F.size("problems") > 0) | (F.size("inconsistent") > 0)
    names = ["rejected", "pruned", "inconsistent", "problems", "holds", "conflicts"]
    return out.select("sheet", "version", "status", *names, status.alias("new_status"), changed.alias("changed")), seen.select("sheet", *FACT, "pruned", "reasons")


def what_if(sheets: DataFrame) -> DataFrame:
    """(sheet, path, reason) of everything that a plan's sheets would lose or be held for; path "sheet" for the whole."""
    whole = lambda name: F.transform(name, lambda x: F.struct(F.lit("sheet").alias("path"), x.alias("reason")))
    return sheets.select("sheet", F.explode(F.concat("rejected", whole("inconsistent"), whole("problems"))).alias("r")).select("sheet", "r.path", "r.reason")


def applied(sheets: DataFrame, facts: DataFrame, published_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sheets, facts) of the next versions of the sheets that a plan changes: without what it rejects, lists cut, the new status."""
    hit = sheets.where(F.col("changed") & ((F.col("status") == PUBLISHED) | F.lit(not published_only)))
    fresh = hit.select("sheet", (F.col("version") + 1).alias("version"), F.col("new_status").alias("status"))
    return fresh, facts.where(F.size("reasons") == 0).join(fresh.select("sheet", "version"), "sheet").select("sheet", "version", *FACT)


def conflicts_to_file(sheets: DataFrame, filed: DataFrame) -> DataFrame:
    """(sheet, path, reason, ruled_value, decided_at) of the owner's conflicts that aren't on file, each once.

    A conflict is the same by its rule, field and ruling; the quote may be cut another way between runs.
    """
    keys = ["sheet", "path", "reason", "ruled_value", "decided_at"]
    new = sheets.select("sheet", F.explode("conflicts").alias("c")).select("sheet", "c.*").dropDuplicates(keys)
    same = [new[k].eqNullSafe(filed[k]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return new.join(filed, on, "left_anti")
