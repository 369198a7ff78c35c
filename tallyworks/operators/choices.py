"""Choices among rows, and reports that read across tables: documents to fetch, siblings, spans, costs, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions import normalise as n
from tallyworks.operators.corpus import number_stated

# Classes of documents in the order in which they are wanted, and how many are.
CLASS_ORDER = ["fap", "application", "summary", "billing"]
MOST_URLS = 4
# Lengths of a sentence that may stand as a quote.
SHORTEST, LONGEST = 12, 400
# Schema years in which legal steps were asked one by one, and since which as one.
SEPARATE_YEAR, FUSED_YEAR = 2013, 2016
# What may stand in evidence and outcomes.
SLIPS = ["denied_despite_policy", "partial_despite_free"]
DOCUMENT_KINDS = ["photo_id", "proof_of_income", "social_security_letter", "tax_return", "pay_stubs", "bank_statements", "proof_of_residency", "insurance_card", "medicaid_denial", "other"]
OUTCOME_KEYS = ["decision", "recorded_on", "triage", "matched"]


def select_urls(hits: DataFrame, key: str, most: int = MOST_URLS) -> DataFrame:
    """(key, url, doc_class, place): the best of each class in CLASS_ORDER, then the best of the rest, ``most`` in all.

    ``hits`` has url, doc_class and score. Of one address the best hit counts, rows without a class never do, and ties
    go to the address that sorts first.
    """
    best = hits.groupBy(key, "url").agg(F.max_by(F.struct("doc_class", "score"), F.struct("score", "doc_class")).alias("h"))
    rows = best.select(key, "url", F.col("h.doc_class").alias("doc_class"), F.col("h.score").alias("score")).where(F.col("doc_class").isin(CLASS_ORDER))
    order = [F.col("score").desc_nulls_last(), F.col("url")]
    first = F.row_number().over(Window.partitionBy(key, "doc_class").orderBy(*order)) == 1
    rank = F.array_position(F.array(*map(F.lit, CLASS_ORDER)), F.col("doc_class"))
    placed = rows.withColumn("__first", first)
    w = Window.partitionBy(key).orderBy(F.when(F.col("__first"), rank).otherwise(len(CLASS_ORDER) + 1), *order)
    return placed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(key, "url", "doc_class", "place")


def siblings(hospitals: DataFrame, sheets: DataFrame) -> DataFrame:
    """(ccn, sibling): for each hospital the first other one of its website and state whose newest sheet is published.

    ``sheets``: ccn, version, status. A website's hospitals of a state are a group of a system's size.
    """
    newest = sheets.groupBy("ccn").agg(F.max_by("status", "version").alias("status")).where("status = 'published'")
    lenders = hospitals.where("website_domain <> ''").join(newest, "ccn", "left_semi").groupBy("website_domain", "state").agg(F.array_sort(F.collect_set("ccn")).alias("of"))
    # two are enough: a hospital's own is one of them at most
    met = hospitals.join(lenders.withColumn("of", F.slice("of", 1, 2)), ["website_domain", "state"])
    first = F.get(F.filter("of", lambda x: x != F.col("ccn")), F.lit(0))
    return met.select("ccn", first.alias("sibling")).where("sibling is not null")


def since_published(items: DataFrame, sheets: DataFrame) -> DataFrame:
    """``items`` (ccn, created_at, ...) filed after the last published sheet of their hospital; all where there is none."""
    last = sheets.where("status = 'published'").groupBy("ccn").agg(F.max("created_at").alias("__last"))
    return items.join(last, "ccn", "left").where("__last is null or created_at > __last").select(items.columns)


def newest_fetch(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(ccn, fetched_on): the newest fetch of a hospital's own documents; a state's never count."""
    own = sources.where("kind in ('hospital_web', 'state_repository') and source_id not like 'state-%'")
    return links.join(own, "source_id").groupBy("ccn").agg(F.max("fetched_on").alias("fetched_on"))


def newest_vintage(rows: DataFrame, facts: list[str], file_rank: Column, vintage: str) -> DataFrame:
    """(facts, vintage): rows that several files repeat, once each, with the vintage of the newest file (the least rank)."""
    return rows.groupBy(*facts).agg(F.min_by(vintage, file_rank).alias(vintage))


def used_since(ledger: DataFrame, service: str, start: Column) -> DataFrame:
    """(used): the sum of a service's costs from a time on, 0 without any."""
    spent = ledger.where((F.col("service") == service) & (F.col("at") >= start))
    return spent.agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,6)").alias("used"))


def token_cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars for tokens at prices per million."""
    return ((price_in * prompt + price_out * completion) / 1_000_000).cast("decimal(38,12)")


def search_cost(deep: Column) -> Column:
    return F.when(deep, 2).otherwise(1)


def extract_cost(pages: Column, deep: Column) -> Column:
    """Credits for every five pages begun."""
    return (F.ceil(pages / 5) * search_cost(deep)).cast("bigint")


def map_cost(pages: Column) -> Column:
    """A credit for every ten pages begun, one at least."""
    return F.greatest(F.lit(1), F.ceil(pages / 10)).cast("bigint")


def within_cap(used: Column, cost: Column, cap: Column) -> Column:
    """Whether a cost may still be spent under a cap."""
    return used + cost <= cap


def field_accuracy(truth: DataFrame, read: DataFrame, key: str, same: dict[str, Column]) -> DataFrame:
    """(field, accuracy, n): the share of labelled rows on which each test of ``same`` holds; an unread row fails all.

    Columns of the truth are named t_..., those that were read r_....
    """
    t = truth.select(key, *[F.col(c).alias(f"t_{c}") for c in truth.columns if c != key])
    r = read.select(key, *[F.col(c).alias(f"r_{c}") for c in read.columns if c != key])
    both = t.join(r.withColumn("__read", F.lit(True)), key, "left")
    tests = F.array(*[F.struct(F.lit(f).alias("field"), (F.col("__read").isNotNull() & F.coalesce(test, F.lit(False))).alias("ok")) for f, test in same.items()])
    return both.select(F.explode(tests).alias("x")).groupBy(F.col("x.field").alias("field")).agg(F.avg(F.col("x.ok").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def first_sentence(text: Column, phrase: Column) -> Column:
    """The first sentence that has a phrase, in any case, and may stand as a quote; null if none does."""
    sentences = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s+")
    return F.trim(F.get(F.filter(sentences, lambda s: F.contains(F.lower(s), F.lower(phrase)) & F.length(s).between(SHORTEST, LONGEST)), F.lit(0)))


def overlaid(sheets: DataFrame, programmes: DataFrame) -> DataFrame:
    """``sheets`` (ccn, state, ...) with the facts (path, value, quote, source_id) of their state's programmes, whose texts
    must hold a sentence with the programme's phrase: (state, path, value, phrase, text, source_id)."""
    told = programmes.withColumn("quote", first_sentence(F.col("text"), F.col("phrase"))).where("quote is not null").select("state", "path", "value", "quote", "source_id")
    return sheets.select("ccn", "state").join(told, "state").select("ccn", "path", "value", "quote", "source_id")


def best_span(quote: Column, document: Column, number: Column) -> Column:
    """The longest sentence of a quote that its document holds, one that states the number before others; null if none.

    Quote and document are in comparable form; a quote that is held whole stands as it is.
    """
    held = F.filter(F.split(quote, r"(?<=[.;:])\s+|\n+"), lambda s: (F.length(s) >= SHORTEST) & F.contains(document, s))
    ranked = F.transform(held, lambda s: F.struct(F.coalesce(number_stated(s, number), F.lit(False)).alias("states"), F.length(s).alias("n"), s.alias("s")))
    return F.when(F.contains(document, quote), F.trim(quote)).otherwise(F.array_max(ranked)["s"])


def collection_flags(schema_year: Column, checked: Column) -> Column:
    """struct(lawsuits, liens, legal_action, sells_debt, permitted) of a filing's ticked boxes (an array of their names).

    Until SEPARATE_YEAR lawsuits and liens were asked one by one and selling debt not at all, since FUSED_YEAR legal steps
    as one; between, nothing was asked about them. What wasn't asked is unknown, not no.
    """
    has = lambda *names: F.coalesce(F.arrays_overlap(checked, F.array(*map(F.lit, names))), F.lit(False))
    early, late = schema_year <= SEPARATE_YEAR, schema_year >= FUSED_YEAR
    permits = {
        "credit_reporting": ["PermitReportToCreditAgencyInd"], "selling_debt": ["PermitSellingDebtInd"], "other": ["PermitOtherActionsInd"], "none": ["PermitNoActionsInd"],
        "legal_action": ["PermitLegalJudicialProcessInd", "PermitLawsuitInd", "PermitLienOnResidenceInd", "PermitBodyAttachmentsInd"],
    }
    order = ["credit_reporting", "selling_debt", "legal_action", "other", "none"]
    return F.struct(
        F.when(early, has("LawsuitInd")).alias("lawsuits"), F.when(early, has("LiensOnResidencesInd")).alias("liens"),
        F.when(late, has("EngagedLegalJudicialProcessInd")).when(early, has("LawsuitInd", "LiensOnResidencesInd", "BodyAttachmentsInd")).alias("legal_action"),
        F.when(~early, has("EngagedSellingDebtInd")).alias("sells_debt"),
        F.array_compact(F.array(*[F.when(has(*permits[k]), F.lit(k)) for k in order])).alias("permitted"),
    )


def audit(evidence: DataFrame, cases: DataFrame, contributions: DataFrame, requests: DataFrame) -> DataFrame:
    """(kind, id, problem): rows of the learning tables that hold more than enumerated values, dates, counts and hashes.

    ``evidence``: id, field_path, value, case_hash; ``cases``: id, outcome (map); ``contributions``: id, status, text;
    ``requests``: id, cases (array), fap_url, hospital_name.
    """
    c = F.col
    hits = lambda t: F.size(n.personal_hits(F.coalesce(c(t), F.lit("")))) > 0
    documents = (c("field_path") == "apply.documents_required") & c("value").isin(DOCUMENT_KINDS)
    slips = (c("field_path") == "accountability.slip") & c("value").isin(SLIPS)
    tests = [
        ("evidence", evidence, [("value not allowed", ~F.coalesce(documents | slips, F.lit(False))), ("case hash", ~F.coalesce(c("case_hash").rlike("^[0-9a-f]{16}$"), F.lit(False)))]),
        ("case", cases, [("unexpected keys", F.size(F.array_except(F.map_keys("outcome"), F.array(*map(F.lit, OUTCOME_KEYS)))) > 0)]),
        ("contribution", contributions, [("rejected but kept", (c("status") == "rejected") & (c("text") != "")), ("personal", (c("status") != "rejected") & hits("text"))]),
        ("request", requests, [("no case", F.coalesce(F.size("cases"), F.lit(0)) <= 0), ("address keeps a path", c("fap_url").rlike("[/?#]")), ("personal name", hits("hospital_name"))]),
    ]
    out = None
    for kind, rows, rules in tests:
        found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules]))
        got = rows.select(F.lit(kind).alias("kind"), c("id").cast("string").alias("id"), F.explode(found).alias("problem"))
        out = got if out is None else out.unionByName(got)
    return out
