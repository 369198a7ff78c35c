"""Facts held to their quotes and sources: one ordered cascade of reasons, in built-in expressions.

``checked`` brings the facts that cite a text together with it and gives each its first reason, or none. A text is
brought into the form of ``text.normal_of`` once, before it meets its facts, and so is a quote; what the rules need of a
text (its full-help bands, its passages for uninsured patients) is read from it once too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions import poverty, tables
from tallyworks.functions.poverty import plain_number
from tallyworks.functions.text import normal_of, quotes_held
from tallyworks.operators import bands, wording
from tallyworks.operators.corpus import number_stated
from tallyworks.operators.facts import first_reason

FREE, TIERS, ASSETS = "eligibility.free_care_max_fpl", "eligibility.discount_tiers", "eligibility.asset_test"
CEILING, INSURED, RESIDENCY = "eligibility.assistance_ceiling_fpl", "eligibility.insured_patients_covered", "eligibility.residency"
# Wordings that the rules look for, in comparable form.
PATIENT_SHARE = (
    r"\b(?:patient )?responsib\w*|\bpatients? (?:pays?|portion|share)\b|\bco-?pay\w*"
    r"|\bof (?:total )?charges\b|\bbalance due\b|\bof (?:the )?(?:agb|amounts? generally billed)\b"
)
DISCOUNT_WORDS = r"\b(?:discount\w*|write[- ]?offs?|reduc\w*|free|waiv\w*|adjust\w*)\b"
SERVICE_COLUMNS = r"\bin-?patient:? out-?patient\b|\bin-?patient discount\b.{0,400}?\bout-?patient discount\b"
HARDSHIP = r"\b(?:financial|medical) hardship\b(?! family countable)|\bmedical debt\b|\bcatastrophic\b"
CEILING_WORDING = (
    r"\bfull or partial\b|\bpartial(?:ly)? (?:financial )?assistance\b"
    r"|\bfree or (?:discounted|reduced|low[- ]?cost)\b"
    r"|\bmay qualify for (?:financial )?assistance\b|\beligible for (?:financial )?assistance\b"
)
FREE_MARKERS = (
    r"\b100 ?(?:%|percent)|\bone hundred percent\b|\bfree (?:hospital |medical )?care\b"
    r"|\bfree of charge\b|\bno charge\b|\bat no cost\b|\bzero\b|\bwaiv\w*"
    r"|\bfull(?:y)? (?:write[- ]?off|covered|discounted|charity|financial assistance|cost)"
)
UP_TO_FULL = r"\bup to (?:a |an )?(?:100 ?(?:%|percent)|one hundred percent)"
HEDGED_UP_TO_FULL = r"\bmay\b[^.;]*\bup to (?:a |an )?(?:100 ?(?:%|percent)|one hundred percent)"
NOT_FREE_HINT = r"\bsliding\b|\bprorat|\bdenied\b"
FREE_WORDING = (
    # 100% of the poverty line is an income, not a discount
    r"\bfree\b|\bno[- ]cost\b|\bno charge\b|\b100 ?(?:%|percent)(?! of (?:the )?(?:federal )?(?:poverty|fpl|fpg|line)\b)|\bfull\b|\bforgiv|\bwaive"
    r"|\bwrite[- ]?off\b|\bwritten off\b|\bno patient responsibility\b|\bnot be responsible\b"
)
STATE_PROGRAM = r"(?i)\b(nj|new jersey) charity care\b"
ASSET_WORDS = r"\bassets?\b|\bresources\b|\bsavings\b|\bnet worth\b|\bmeans[- ]test"
ASSET_NEGATED = (
    r"(?:assets?|resources|savings|net worth|employment status)\b[^.;]{0,40}\b(?:are |is |will be )?"
    r"not (?:considered|required|counted|used|reviewed|evaluated|a factor|part of|taken into account|included)"
    r"|\bno (?:income or )?(?:asset|resource)s? (?:criteria|test|limit|requirement|review)"
    r"|\bdoes not (?:consider|count|use|review|evaluate|require)\b[^.;]{0,30}\b(?:assets?|resources|savings)"
    r"|\bwithout regard to\b[^.;]{0,30}\bassets?\b"
    r"|\basset test(?:ing)? is not (?:required|performed|used|part)"
    r"|\bregardless of (?:their )?assets?\b"
    r"|\bbased (?:solely|only) on (?:household |family )?income\b"
)
ASSET_PARTIAL = (
    r"\bshall not be counted\b|\bnot be counted\b|\bnor shall\b|\bwill never include\b"
    r"|\bdoes not include\b|\bthe first (?:ten thousand|\$)|\bover the first\b"
    r"|\bmay (?:also )?be applied\b|\bprimary residence\b|\bexempt\w*|\bdoes not apply to\b|\bprotected assets?\b"
)
ASSET_TESTED = (
    r"\blimits?\b|\bmeans[- ]test|\bconsidered\b|\bcounted\b|\bverif\w+|\bavailable for payment\b"
    r"|\bused\b|\breview\w*|\bexhausted\b|\bevaluat\w+|\bproof of assets\b|\basset test\w*"
    r"|\bbe applied\b|\btaken into account\b|\bconsists? of\b|\binclud\w+|\bdocument\w*|\bvalidate\b"
)
LATER_BAND = r"(?<![\d.])(\d{2,3})\s?%?\s*[-–]\s*(\d{2,3})\s?%"
ASIDE, INSURED_TABLE = "document set aside", "the table is for insured patients only"
#: Between items that are compared together.
PARTED = "\ue002"
NAMED_PERCENT = r"(?<![\d.$])(\d{2,3})\s?%"


def looks_serialised(value: Column, items: Column) -> Column:
    """Whether a text value, or an item of a list, is a list or object written as text."""
    written = lambda v: F.ltrim(v).rlike(r"^[\[{]")
    return F.coalesce(written(value), F.lit(False)) | F.coalesce(F.exists(items, written), F.lit(False))


def tiers_stated(said: Column, tiers: Column) -> Column:
    """Whether a quote states every band: its lower bound, or the first value past it, its end and its discount."""
    def stated(n: Column) -> Column:
        return number_stated(said, plain_number(n))

    def low(b: Column) -> Column:
        d = b["low"].cast("decimal(18,2)")
        return stated(d) | stated(d + 1) | stated(d + F.lit("0.1").cast("decimal(3,2)")) | stated(d + F.lit("0.01").cast("decimal(3,2)"))

    return F.forall(tiers, lambda b: low(b) & stated(b["high"]) & stated(b["percent"]))


def patient_share(said: Column) -> Column:
    return said.rlike(PATIENT_SHARE) & ~said.rlike(DISCOUNT_WORDS)


def assistance_ceiling(said: Column) -> Column:
    """Whether a quote only promises some help up to an income, without saying that care is free there."""
    hedged = said.rlike(HEDGED_UP_TO_FULL) & ~F.regexp_replace(said, UP_TO_FULL, " ").rlike(FREE_MARKERS)
    return hedged | (said.rlike(CEILING_WORDING) & ~said.rlike(FREE_MARKERS))


def not_free(said: Column) -> Column:
    return said.rlike(NOT_FREE_HINT) & ~said.rlike(FREE_WORDING)


def tops_later_band(said: Column, limit: Column) -> Column:
    """Whether every range that ends at the limit starts one above another percentage of the quote."""
    starts, ends = (F.regexp_extract_all(said, F.lit(LATER_BAND), F.lit(g)) for g in (1, 2))
    ours = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: r["b"].cast("decimal(18,6)") == limit)
    named = F.transform(F.regexp_extract_all(said, F.lit(NAMED_PERCENT), F.lit(1)), lambda x: x.cast("int"))
    return (F.size(ours) > 0) & F.forall(ours, lambda r: F.array_contains(named, r["a"].cast("int") - 1))


def needs_hardship(quote: Column, tiers: Column) -> Column:
    """Whether a sentence that states a band's discount also asks for a hardship."""
    sentences = F.split(F.lower(quote), r"(?<=[.;])\s+|\n+| \|\| ")
    return F.exists(sentences, lambda s: s.rlike(HARDSHIP) & F.exists(tiers, lambda b: number_stated(s, plain_number(b["percent"]))))


def supports_asset_test(said: Column, flag: Column) -> Column:
    """Whether a quote is about assets and says what the flag says."""
    no, some = said.rlike(ASSET_NEGATED), said.rlike(ASSET_PARTIAL)
    return said.rlike(ASSET_WORDS) & F.when(flag, said.rlike(ASSET_TESTED) & (~no | some)).otherwise(no & ~some)


#: Facts that meet one copy of a text.
CHUNK = 200


def _with_sources(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """``facts`` (with ``__said``) and what their sources say of them: ``__has``, ``__found``, ``__helped`` (bands of full
    help), ``__for_insured`` and ``__for_all`` (tables of bands: for insured patients only, and given to all the same).

    Facts meet their text in chunks, so a text that very many facts cite is copied once for CHUNK of them, and it isn't
    copied for each fact. Facts without a text stay.
    """
    c = F.col
    cited = facts.where("source_id is not null")
    docs = texts.join(cited.select("source_id").distinct(), "source_id", "left_semi").select("source_id", normal_of("text").alias("__plain"))
    docs = docs.where("__plain is not null")
    docs = docs.withColumns({"__helped": tables.full_help_bands(c("__plain")), "__passages": tables.uninsured_passages(c("__plain"))})
    many = cited.groupBy("source_id").agg(F.ceil(F.count("*") / CHUNK).alias("__chunks")).where("__chunks > 1")
    dealt = facts.join(many, "source_id", "left").withColumn("__chunk", F.pmod(F.xxhash64("key", "path"), F.coalesce("__chunks", F.when(c("source_id").isNull(), 512).otherwise(1))))
    grouped = dealt.groupBy("source_id", "__chunk").agg(F.collect_list(F.struct(*[f"`{x}`" for x in facts.columns if x != "source_id"])).alias("__facts"))
    met = grouped.join(docs, "source_id", "left").withColumn("__held", quotes_held(F.transform("__facts", lambda f: f["__said"]), "__plain"))
    table = lambda f: (f["path"] == TIERS) & f["tiers"].isNotNull()
    told = F.transform("__facts", lambda f, i: F.struct(
        f.alias("f"), F.coalesce(F.get("__held", i), F.lit(False)).alias("found"), F.when(table(f), tables.for_insured(c("__plain"), f["__said"])).alias("insured"),
        F.when(table(f), tables.gives_tiers(c("__passages"), f["tiers"])).alias("all"),
    ))
    rows = met.select("source_id", c("__plain").isNotNull().alias("__has"), "__helped", F.explode(told).alias("__t"))
    return rows.select("source_id", "__t.f.*", "__has", "__helped", c("__t.found").alias("__found"), F.coalesce("__t.insured", F.lit(False)).alias("__for_insured"), F.coalesce("__t.all", F.lit(False)).alias("__for_all"))


def checked(facts: DataFrame, texts: DataFrame, set_aside: DataFrame) -> DataFrame:
    """``facts`` with ``reason``: why a fact is rejected, null if it is accepted. The first rule that fails decides.

    ``facts`` has key, path, layer, state, source_id, quote and, each null where it doesn't apply, value (text),
    number, flag, items (array of text: a list's parts, or the codes of states) and tiers (array of low, high, percent).
    With a column ``sheet`` a free limit is also held against the table of discounts of its own sheet. ``texts`` has one
    text for each source_id, ``set_aside`` one reason. Reported facts are accepted as they are.
    """
    c = F.col
    # items are compared in the form of quotes; one that has several words stays one item
    forms = {"__said": normal_of(F.coalesce("quote", F.lit(""))), "__listed": normal_of(F.array_join("items", PARTED, ""))}
    rows = _with_sources(facts.withColumns(forms), texts)
    rows = rows.join(set_aside.select("source_id", c("reason").alias("__aside")), "source_id", "left")
    said, free, tiers = c("__said"), c("path") == FREE, (c("path") == TIERS) & c("tiers").isNotNull()
    only_insured = c("__for_insured") & ~c("__for_all")
    in_table = F.lit(False)
    if "sheet" in facts.columns:
        table = F.max(F.when(tiers & (c("layer") != "reported") & c("__found") & only_insured, said)).over(Window.partitionBy("sheet", "source_id"))
        rows = rows.withColumn("__table", table)
        in_table = F.contains("__table", said)
    items = F.transform(F.split("__listed", PARTED), F.trim)
    rows, text = rows.withColumns({"__items": items, "__poverty": poverty.poverty_text(said)}), c("__poverty")
    problem = {
        name: why for name, why in {
            "list": wording.list_problem(c("path"), said, c("items"), c("__items")),
            "ceiling": F.when(c("path") == CEILING, wording.ceiling_problem(said, text, c("number"))),
            "limit": F.when(c("path").isin(FREE, TIERS, CEILING), wording.income_limit_problem(said, text, c("quote"), c("state"), c("tiers"), c("number"))),
            "insured": F.when(c("path") == INSURED, wording.insured_problem(said, c("flag"))),
            "residency": F.when(c("path") == RESIDENCY, wording.residency_problem(said, c("quote"), c("items"))),
        }.items()
    }
    line = free & (c("number") == 100) & poverty.states_poverty_line(said)
    early = first_reason(
        ("source text missing", ~c("__has")),
        ("quote not found in source", ~c("__found")),
        (ASIDE, c("__aside").isNotNull()),
        ("value is a list or object written as text", looks_serialised(c("value"), c("items"))),
        ("value not in quote", (c("number").isNotNull() & ~number_stated(said, plain_number(c("number"))) & ~line) | ((F.size("tiers") > 0) & ~tiers_stated(said, c("tiers")))),
    )
    share = first_reason(("quote states the patient's share, not a discount", tiers & (patient_share(said) | bands.rises(c("tiers")))))
    limit = first_reason(
        ("quote does not state the free-care limit as an income limit", ~wording.free_limit_stated(said, text, c("number"))),
        ("quote gives different free-care limits for inpatient and outpatient care", wording.free_limit_split(said, text)),
        ("quote gives the limit as the top of a later band, not the free band", tops_later_band(said, c("number"))),
        ("quote describes a sliding scale or a denial, not free care", not_free(said)),
        ("quote states the band for another state's facilities", (c("state") != "NJ") & said.rlike(STATE_PROGRAM)),
        ("quote charges the patient within the free band", tables.charges_patient(said)),
        ("the document gives full assistance to a band above this limit", tables.helped_above(c("__helped"), c("number").cast("decimal(18,6)"))),
        ("quote states an eligibility ceiling for any assistance, not a free-care band", assistance_ceiling(said)),
        (INSURED_TABLE, in_table),
    )
    table = first_reason(
        ("quote gives the discount as a range or a floor, not a fixed percentage", tables.of_tiers(c("tiers"), tables.range_discounts(said))),
        ("the band needs a financial hardship, so it is not an income band", needs_hardship(c("quote"), c("tiers"))),
        ("the discount is added to another one", tables.of_tiers(c("tiers"), tables.added_discounts(said))),
        (INSURED_TABLE, only_insured),
        ("the tier is read from the wrong column of the table for this hospital", tables.wrong_column(said, c("state"), c("tiers"))),
        ("the table gives different discounts for inpatient and outpatient care", said.rlike(SERVICE_COLUMNS)),
    )
    assets = first_reason(("quote does not support the asset-test value", (c("path") == ASSETS) & ~supports_asset_test(said, c("flag"))))
    reason = F.coalesce(early, problem["list"], problem["ceiling"], share, problem["limit"], F.when(free, limit), F.when(tiers, table), problem["insured"], assets, problem["residency"])
    # a column of its own: the rules are worked out once
    rows = rows.withColumn("__reason", reason)
    own = F.when(c("__reason") == ASIDE, c("__aside")).otherwise(c("__reason"))
    return rows.withColumn("reason", F.when(c("layer") != "reported", own)).select(*facts.columns, "reason")
