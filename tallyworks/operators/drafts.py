"""Drafts of sheets, one JSON object each, as typed facts: every field becomes a fact or the reason why it doesn't.

A draft is parsed into a VARIANT, its fields become rows, and each is cast by the rule of its kind. Nothing that a
draft holds makes a row fail: a bad cell has a reason, and so has a draft that is no object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import places
from tallyworks.functions.text import normal_of
from tallyworks.operators import bands, wording
from tallyworks.operators.facts import first_reason
from tallyworks.operators.verify import FREE, TIERS, assistance_ceiling

CEILING = "eligibility.assistance_ceiling_fpl"
# A draft's fields, the paths they fill and how each is read.
FIELDS = {
    "free_care_max_fpl": (FREE, "decimal"), "discount_tiers": (TIERS, "tiers"), "asset_test": ("eligibility.asset_test", "flag"), "residency": ("eligibility.residency", "states"),
    "insured_patients_covered": ("eligibility.insured_patients_covered", "flag"), "presumptive": ("programs.presumptive", "list"), "form_url": ("apply.form_url", "url"),
    "documents_required": ("apply.documents_required", "documents"), "submit_methods": ("apply.submit_methods", "channels"), "window_days_from_first_bill": ("apply.window_days_from_first_bill", "window"),
    "decision_days": ("apply.decision_days", "whole"), "eca_wait_days": ("collections.eca_wait_days", "wait"), "phone": ("contacts.phone", "phone"), "hours": ("contacts.hours", "text"),
    "languages": ("contacts.languages", "list"), "facilities": ("coverage.facilities", "list"), "covered_providers": ("coverage.covered_providers", "list"),
    "assistance_ceiling_fpl": (CEILING, "decimal"),
}
MIN_WINDOW, MIN_WAIT = 240, 120
YES, NO = ["true", "yes", "y", "1"], ["false", "no", "n", "0"]
DOCUMENT_WORDS = {
    "photo_id": ["photo id", "photo_id", "identification", "driver", "passport", "government id"],
    "proof_of_income": ["proof of income", "proof_of_income", "income verification", "income documentation", "w-2", "w2", "1099"],
    "social_security_letter": ["social security", "social_security", "ssa", "benefit letter", "award letter"],
    "tax_return": ["tax return", "tax_return", "1040"],
    "pay_stubs": ["pay stub", "paystub", "pay_stubs", "paycheck"],
    "bank_statements": ["bank statement", "bank_statements"],
    "proof_of_residency": ["residency", "proof of address", "lease"],
    "insurance_card": ["insurance card", "insurance_card"],
    "medicaid_denial": ["medicaid denial", "masshealth denial", "medicaid_denial", "denial letter"],
}
CHANNEL_WORDS = {
    "mail": ["mail", "post", "postal"], "fax": ["fax"], "email": ["email", "e-mail"], "portal": ["portal", "online", "web"],
    "in_person": ["in_person", "in person", "in-person", "person"], "phone": ["phone", "telephone", "call"],
}
LINK = r"\[([^\]]+)\]\(([^)]*)\)"
RANGE = r"(?i)(\d+(?:\.\d+)?)\s*%?\s*(?:-|–|—|to)\s*(\d+(?:\.\d+)?)\s*%?"

NUMBER = "decimal(18,6)"
BANDS = "array<struct<low:double,high:double,percent:double>>"
NO_VALUE, NO_TEXT = "no number", "expected text, got a list or object"


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a kind of number."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text_of(v: Column) -> Column:
    """A scalar as text, anything else as JSON."""
    return F.when(_kind(v).isin("OBJECT", "ARRAY"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def _plain(text: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(text, LINK, "$1"), F.lit("**"), F.lit("")), F.lit(" \t\n\r\x0b\x0c"))


def _number(text: Column) -> Column:
    """The digits and points of a text as a number; null if they are none."""
    return F.regexp_replace(text, r"[^\d.]", "").try_cast(NUMBER)


def _number_problem(text: Column) -> Column:
    return first_reason((NO_VALUE, ~text.rlike(r"[\d.]")), ("not a number", _number(text).isNull()))


def _items(v: Column) -> Column:
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def _coded(text: Column, words: dict[str, list[str]]) -> Column:
    """The first kind of which a text has a word."""
    return F.coalesce(*[F.when(F.coalesce(*[F.when(F.contains(text, F.lit(w)), True) for w in some], F.lit(False)), F.lit(kind)) for kind, some in words.items()])


def _tiers(items: Column) -> Column:
    """struct(bands, free, failed): bands by their lower bound, the end of the band with a discount of 100, and items that can't be read.

    A band may be one text ("201%-400%") in either place; a missing lower bound is the end of the band before, or 0.
    """
    start = F.struct(F.lit(None).cast(NUMBER).alias("end"), F.array().cast(BANDS).alias("bands"), F.lit(None).cast(NUMBER).alias("free"), F.lit(0).alias("failed"))

    def step(state: Column, item: Column) -> Column:
        get = lambda name: F.try_variant_get(item, f"$.{name}", "string")
        # only text may be a range: "2-3" as a number is none
        a, b, off = get("min_fpl_exclusive"), get("max_fpl_inclusive"), get("discount_percent")
        ranged = F.when(a.rlike(RANGE), a).when(b.rlike(RANGE), b)
        low = F.coalesce(F.regexp_extract(ranged, RANGE, 1).cast(NUMBER), F.when(a.isNull(), F.coalesce(state["end"], F.lit(0).cast(NUMBER))).otherwise(_number(a)))
        high = F.coalesce(F.regexp_extract(ranged, RANGE, 2).cast(NUMBER), _number(b))
        percent = F.when(~off.rlike(RANGE), _number(off))
        read = F.coalesce((_kind(item) == "OBJECT") & low.isNotNull() & high.isNotNull() & percent.isNotNull(), F.lit(False))
        free = read & (percent >= 100)
        band = read & percent.between(1, 99) & (F.round(percent, 2) == percent) & (low >= 0) & (high > 0)
        one = F.array(F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), percent.cast("double").alias("percent")))
        return F.struct(
            F.when(free | band, high).otherwise(state["end"]).alias("end"), F.when(band, F.concat(state["bands"], one)).otherwise(state["bands"]).alias("bands"),
            F.when(free, F.greatest(state["free"], high)).otherwise(state["free"]).alias("free"), (state["failed"] + F.when(free | band, 0).otherwise(1)).alias("failed"),
        )

    return F.aggregate(items, start, step, lambda s: F.struct(bands.by_low(s["bands"]).alias("bands"), s["free"].alias("free"), s["failed"].alias("failed")))


def fields(drafts: DataFrame, key: str, draft: str, sources: DataFrame) -> DataFrame:
    """One row for each field of each draft: key, path, quote, source_id, value, number, flag, items, details, tiers, free_band and reason.

    ``draft`` is JSON text, ``sources`` (key, source_id) what a draft may cite. ``reason`` is null for a fact, "absent"
    where the draft has no value, else why the field is skipped. A bare value in place of an object of value, quote and
    source is taken as the value, and so lacks its quote; a draft that is no JSON object has all fields absent. Lists
    keep the items that their quote names. ``free_band`` is the end of a band with a discount of 100 among the tiers.
    """
    c = F.col
    # a file of many short drafts is one task; dealt by key, all tasks read them
    parsed = drafts.select(key, F.col(draft).alias("__draft")).repartition(key).select(key, F.try_parse_json("__draft").alias("__d"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("rule"), F.try_variant_get("__d", f"$.{f}", "variant").alias("raw")) for f, (p, k) in FIELDS.items()]))
    rows = parsed.select(key, each.alias("f")).select(key, "f.*")
    wrapped = _kind(c("raw")) == "OBJECT"
    said = lambda name: F.when(wrapped, F.try_variant_get("raw", f"$.{name}", "string"))
    rows = rows.select(
        key, "path", "rule", F.when(wrapped, F.try_variant_get("raw", "$.value", "variant")).otherwise(c("raw")).alias("v"),
        F.nullif(said("quote"), F.lit("")).alias("quote"), F.nullif(said("source_id"), F.lit("")).alias("source_id"),
    )
    known = sources.select(key, "source_id", F.lit(True).alias("__known")).distinct()
    rows = rows.join(known, [key, "source_id"], "left")
    kind = _kind(c("v"))
    missing = c("v").isNull() | (kind == "VOID")
    rows = rows.withColumns({"__kind": kind, "__text": _text_of(c("v")), "__items": F.when(~missing, _items(c("v"))), "__missing": missing, "__said": normal_of(F.coalesce("quote", F.lit("")))})
    text, many = c("__text"), c("__kind").isin("OBJECT", "ARRAY")
    nested = F.exists("__items", lambda i: _kind(i).isin("OBJECT", "ARRAY"))
    words = F.filter(F.transform("__items", lambda i: _plain(F.try_variant_get(i, "$", "string"))), lambda t: t != "")
    rows = rows.withColumns({"__words": F.when(~nested, words), "__tiers": F.when((c("rule") == "tiers") & (c("__kind") == "ARRAY"), _tiers(c("__items")))})
    rows = rows.withColumn("__plain", F.transform(F.split(normal_of(F.array_join("__words", "", "")), ""), F.trim))
    is_ = lambda *rules: c("rule").isin(*rules)
    named = [("list items must be text, not objects or lists", nested), ("empty list", F.size("__words") == 0)]

    # residency: codes as they are, else states' names and codes within the item
    def states(item: Column) -> Column:
        inside = F.concat(places.states_named(item), F.when(item != F.upper(item), places.codes_written(item)).otherwise(F.array().cast("array<string>")))
        return F.when(F.upper(item).isin(list(places.STATES)), F.array(F.upper(item))).otherwise(inside)

    codes = F.array_distinct(F.flatten(F.transform("__words", states)))
    documents = F.transform("__words", lambda w: F.coalesce(_coded(F.lower(w), DOCUMENT_WORDS), F.lit("other")))
    channel = lambda i: F.struct(
        _coded_exactly(F.lower(F.trim(F.try_variant_get(i, "$.kind", "string"))), CHANNEL_WORDS).alias("kind"), F.coalesce(_plain(F.try_variant_get(i, "$.detail", "string")), F.lit("")).alias("detail")
    )
    channels = F.filter(F.transform("__items", channel), lambda m: m["kind"].isNotNull())
    rows = rows.withColumns({"__codes": F.when(is_("states"), codes), "__documents": F.when(is_("documents"), documents), "__channels": F.when(is_("channels"), channels)})
    # lists are cut to what the quote names
    kept_documents = F.filter(F.array_distinct("__documents"), lambda d: wording.marked(c("__said"), d, wording.DOCUMENT_MARKERS))
    echoed = F.forall(F.array(*map(F.lit, wording.DOCUMENT_MARKERS)), lambda k: F.array_contains("__documents", k))
    other = F.when((F.size(kept_documents) > 0) & F.array_contains("__documents", "other") & ~echoed, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    kept_channels = F.filter("__channels", lambda m: wording.marked(c("__said"), m["kind"], wording.CHANNEL_MARKERS))
    pairs = F.array_distinct(F.arrays_zip(c("__words").alias("as_is"), c("__plain").alias("plain")))
    programs = F.transform(F.filter(pairs, lambda x: wording.program_stands(c("__said"), x["as_is"], x["plain"])), lambda x: x["as_is"])
    providers = F.transform(F.filter(pairs, lambda x: wording.provider_stands(c("__said"), x["as_is"], x["plain"])), lambda x: x["as_is"])
    rows = rows.withColumns({
        "__kept": F.when(is_("documents"), F.concat(kept_documents, other)).when(c("path") == wording.PROGRAMS, programs).when(c("path") == wording.PROVIDERS, providers)
        .when(is_("states"), c("__codes")).when(is_("list"), c("__words")), "__ways": F.when(is_("channels"), kept_channels),
    })
    none = lambda what: f"none of the listed {what} is named in the quote"
    whole = _number(text).cast("bigint")
    link = text.rlike(f"^{LINK}$")
    label, target = F.trim(F.regexp_extract(text, LINK, 1)), F.trim(F.regexp_extract(text, LINK, 2))
    digits = lambda t: F.regexp_replace(t, r"\D", "")
    written = _plain(F.when(link & (F.length(digits(label)) >= 10), label).when(link, F.regexp_replace(target, "^tel:", "")).otherwise(text))
    bare = F.when(written.rlike(r"^\+?\d+$"), F.regexp_replace(digits(written), r"^1(?=\d{10}$)", ""))
    phone = F.when(bare.isNull(), written).when(F.length(bare) == 10, F.concat(F.lit("("), F.left(bare, F.lit(3)), F.lit(") "), F.substring(bare, 4, 3), F.lit("-"), F.right(bare, F.lit(4))))
    url = F.when(link, F.coalesce(F.nullif(target, F.lit("")), label)).otherwise(F.trim(text))
    flag = F.lower(F.trim(text))
    t = c("__tiers")
    unusable = F.concat(F.lit("no usable tier ("), t["failed"].cast("string"), F.lit(" of "), F.size("__items").cast("string"), F.lit(" items failed to parse)"))
    by_rule = (
        F.when(is_("decimal", "whole"), _number_problem(text))
        .when(is_("window"), F.coalesce(_number_problem(text), F.when(whole < MIN_WINDOW, F.concat(F.lit("application window "), whole.cast("string"), F.lit(f" is below the 501(r) minimum of {MIN_WINDOW} days")))))
        .when(is_("wait"), F.coalesce(_number_problem(text), F.when(whole < MIN_WAIT, F.concat(whole.cast("string"), F.lit(f" is below the 501(r) minimum of {MIN_WAIT} days; a notice period, not the collections wait")))))
        .when(is_("flag"), F.when(~flag.isin(YES + NO), "not a boolean"))
        .when(is_("text", "url"), F.when(many, NO_TEXT))
        .when(is_("phone"), first_reason((NO_TEXT, many), ("no phone number", F.length(digits(written)) < 10), ("not a US phone number", phone.isNull())))
        .when(is_("states"), first_reason(*named, ("no US state recognised", F.size("__codes") == 0)))
        .when(is_("documents"), first_reason(*named, (none("documents"), F.size(kept_documents) == 0)))
        .when(is_("channels"), first_reason(("submit method must be an object", F.exists("__items", lambda i: _kind(i) != "OBJECT")), ("no recognised submit methods", F.size("__channels") == 0), (none("channels"), F.size("__ways") == 0)))
        .when(is_("list"), first_reason(
            *named, ("quote does not describe presumptive (automatic) eligibility", (c("path") == wording.PROGRAMS) & ~c("__said").rlike(wording.PRESUMPTIVE)),
            (none("programs"), (c("path") == wording.PROGRAMS) & (F.size("__kept") == 0)), (none("providers"), (c("path") == wording.PROVIDERS) & (F.size("__kept") == 0)),
        ))
        .when(is_("tiers"), F.when(t.isNull() | (F.size("__items") == 0), "tiers must be a non-empty list").when(F.size(t["bands"]) > 0, None).when(t["failed"] > 0, unusable).otherwise("only free-care bands were given; see free_care_max_fpl"))
    )
    reason = F.when(c("__missing"), "absent").when(c("quote").isNull() | c("source_id").isNull(), "missing quote or source_id").when(c("__known").isNull(), F.concat(F.lit("unknown source_id "), c("source_id"))).otherwise(by_rule)
    rows = rows.withColumn("reason", reason)
    fact = c("reason").isNull()
    return rows.select(
        key, "path", F.trim("quote").alias("quote"), "source_id",
        F.when(fact, F.when(is_("text"), _plain(text)).when(is_("url"), url).when(is_("phone"), phone)).alias("value"),
        F.when(fact, F.when(is_("decimal"), _number(text)).when(is_("whole", "window", "wait"), whole.cast(NUMBER))).alias("number"),
        F.when(fact & is_("flag"), flag.isin(YES)).alias("flag"),
        F.when(fact, F.when(is_("channels"), F.transform("__ways", lambda m: m["kind"])).otherwise(c("__kept"))).alias("items"),
        F.when(fact & is_("channels"), F.transform("__ways", lambda m: m["detail"])).alias("details"),
        F.when(fact & is_("tiers"), t["bands"]).alias("tiers"),
        F.when(is_("tiers") & c("quote").isNotNull() & c("__known"), t["free"]).alias("free_band"), "reason",
    )


def _coded_exactly(text: Column, words: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(text.isin(some), F.lit(kind)) for kind, some in words.items()])


def reconciled(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Facts of ``fields`` with the income limits of each draft settled, and notes (key, path, note) on what was changed.

    In order: a free limit quoted from the wording of a ceiling goes; a free limit at or above the stated ceiling goes
    if both quote one passage, else it stays with a note; the end of a band with a discount of 100 is the free limit
    where none is stated or a higher one is; bands that overlap or end below their start go; and a ceiling is kept only
    where neither a free limit nor bands are left. All of a draft's limits meet in one row, and go back to rows.
    """
    c = F.col
    facts = rows.where("reason is null")
    of = lambda path: F.max(F.when((c("path") == path) & c("reason").isNull(), F.struct("number", "quote", "source_id", "tiers")))
    one = rows.where(c("path").isin(FREE, TIERS, CEILING)).groupBy(key).agg(
        of(FREE).alias("free"), of(CEILING).alias("ceiling"), of(TIERS).alias("table"),
        F.max(F.when(c("free_band").isNotNull(), F.struct(c("free_band").alias("number"), "quote", "source_id"))).alias("band"),
    )
    one = one.withColumns({f"__{x}_said": normal_of(c(x)["quote"]) for x in ("free", "ceiling")})
    shown = lambda x: F.format_string("%.0f", x.cast("double"))
    note = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    free, ceiling = c("free")["number"], c("ceiling")["number"]
    worded = F.coalesce(assistance_ceiling(c("__free_said")), F.lit(False))
    above = F.coalesce(~worded & (free >= ceiling), F.lit(False))
    same = F.contains("__free_said", c("__ceiling_said")) | F.contains("__ceiling_said", c("__free_said"))
    left = F.when(c("free").isNotNull() & ~worded & ~(above & same), F.struct(free.alias("number"), c("free")["quote"].alias("quote"), c("free")["source_id"].alias("source_id")))
    higher = F.coalesce(left["number"] > c("band")["number"], F.lit(False))
    settled = F.when(c("band").isNotNull() & (left.isNull() | higher), c("band")).otherwise(left)
    table = F.when(~bands.overlaps(c("table")["tiers"]), c("table"))
    one = one.withColumns({"__free": settled, "__table": table})
    alone = c("ceiling").isNotNull() & c("__free").isNull() & c("__table").isNull()
    at = note("stated ", shown(free), " is at or above the overall assistance ceiling (", shown(ceiling), ")")
    notes = F.array_compact(F.array(
        F.when(c("free").isNotNull() & worded, F.struct(F.lit(FREE).alias("path"), note(shown(free), " is quoted from 'full or partial assistance' wording, an eligibility ceiling, not a free-care band").alias("note"))),
        F.when(above, F.struct(F.lit(FREE).alias("path"), F.when(same, note(at, "; not free care")).otherwise(note(at, " but cites a different passage; check which is the free band")).alias("note"))),
        F.when(higher, F.struct(F.lit(FREE).alias("path"), note("stated ", shown(left["number"]), " exceeds the 100% band (", shown(c("band")["number"]), "); table used").alias("note"))),
        F.when(c("table").isNotNull() & c("__table").isNull(), F.struct(F.lit(TIERS).alias("path"), F.lit("discount tiers must be ascending and must not overlap").alias("note"))),
        F.when(alone, F.struct(F.lit(FREE).alias("path"), note("not stated; the documents give only an overall assistance ceiling (", shown(ceiling), "% FPL)").alias("note"))),
    ))
    blank = lambda name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    limit = lambda path, x, when: F.when(when, F.struct(F.lit(path).alias("path"), x["quote"].alias("quote"), x["source_id"].alias("source_id"), x["number"].alias("number"), blank("tiers")))
    kept = F.array_compact(F.array(
        limit(FREE, c("__free"), c("__free").isNotNull()), limit(CEILING, c("ceiling"), alone),
        F.when(c("__table").isNotNull(), F.struct(F.lit(TIERS).alias("path"), c("__table")["quote"].alias("quote"), c("__table")["source_id"].alias("source_id"), blank("number"), c("__table")["tiers"].alias("tiers"))),
    ))
    names = [n for n in rows.columns if n not in ("reason", "free_band")]
    limits = one.select(key, F.explode(kept).alias("k")).select(key, "k.*")
    limits = limits.select(*[n if n in limits.columns else blank(n) for n in names])
    others = facts.where(~c("path").isin(FREE, TIERS, CEILING)).select(*names)
    return others.unionByName(limits), one.select(key, F.explode(notes).alias("n")).select(key, "n.*")
