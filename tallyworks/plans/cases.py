"""Queries of the verification cascade, payees and the registry over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.operators import answers, aside, cases, drafts, verify, wording
from tallyworks.operators import recheck as rechecks
from tallyworks.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(r"""
WITH f AS (SELECT s_suppkey AS key, s_suppkey % 7 AS k, 50 + s_suppkey % 400 AS pct, CASE WHEN s_suppkey % 7 <> 1 THEN s_suppkey END AS source_id FROM supplier),
q AS (SELECT *, CASE WHEN k = 2 THEN 'help is granted on a sliding scale up to ' || pct || '% of the line' WHEN k = 3 THEN 'you may qualify for assistance up to ' || pct || '% of the line'
    ELSE 'care is free up to ' || pct || '% of the line' END AS quote, CASE WHEN k = 4 THEN pct + 1 ELSE pct END AS number FROM f),
t AS (SELECT s_suppkey AS source_id, 'Our policy: ' || quote || '. Ask us.' AS text, s_suppkey % 11 = 0 AS aside FROM supplier JOIN q ON q.key = s_suppkey)
SELECT key, CASE WHEN k = 5 THEN NULL WHEN text IS NULL THEN 'source text missing' WHEN NOT contains(text, CASE WHEN k = 6 THEN 'x' || quote ELSE quote END) THEN 'quote not found in source' WHEN aside THEN 'a translation'
  WHEN NOT regexp_matches(quote, '(^|[^\d.])' || number || '(\.0+)?($|[^\d.]|\.[^\d])') THEN 'value not in quote' WHEN regexp_matches(quote, '\bsliding\b') THEN 'quote describes a sliding scale or a denial, not free care'
  WHEN regexp_matches(quote, '\bmay qualify for assistance\b') THEN 'quote states an eligibility ceiling for any assistance, not a free-care band' END AS reason
FROM q LEFT JOIN t ON q.source_id = t.source_id""")
def verified_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-care limits held to their quotes and sources, with the first reason against each."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 7).alias("k"), (F.col("s_suppkey") % 400 + 50).alias("pct"))
    k, pct = F.col("k"), F.col("pct").cast("string")
    said = F.when(k == 2, F.concat(F.lit("help is granted on a sliding scale up to "), pct)).when(k == 3, F.concat(F.lit("you may qualify for assistance up to "), pct)).otherwise(F.concat(F.lit("care is free up to "), pct))
    s = s.withColumn("said", F.concat(said, F.lit("% of the line")))
    null = F.lit(None)
    facts = s.select(
        "key", F.lit(verify.FREE).alias("path"), F.when(k == 5, "reported").otherwise("documented").alias("layer"), F.lit("MA").alias("state"),
        F.when(k != 1, F.col("key").cast("string")).alias("source_id"), F.when(k == 6, F.concat(F.lit("x"), F.col("said"))).otherwise(F.col("said")).alias("quote"), null.cast("string").alias("value"),
        F.when(k == 4, F.col("pct") + 1).otherwise(F.col("pct")).cast("decimal(18,2)").alias("number"), null.cast("boolean").alias("flag"),
        null.cast("array<string>").alias("items"), null.cast("array<struct<low:double,high:double,percent:double>>").alias("tiers"),
    )
    source = F.col("key").cast("string").alias("source_id")
    texts = s.select(source, F.concat(F.lit("Our policy: "), F.col("said"), F.lit(". Ask us.")).alias("text"))
    aside = s.where("key % 11 = 0").select(source, F.lit("a translation").alias("reason"))
    return verify.checked(facts, texts, aside).select("key", "reason")


@query("""
WITH r AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Acute Care Hospitals' WHEN 1 THEN 'Critical Access Hospitals' ELSE 'Psychiatric' END AS kind,
  CASE s_suppkey % 5 WHEN 0 THEN 'Voluntary non-profit - Private' WHEN 1 THEN 'Government - Hospital District or Authority' WHEN 2 THEN NULL ELSE 'Proprietary' END AS owner,
  CASE WHEN s_nationkey < 12 THEN 'wa' ELSE 'tx' END AS state, '1 (555) ' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS tel, s_name FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS ccn, s_name AS name, upper(state) AS state, '555-' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS phone FROM r
WHERE kind <> 'Psychiatric' AND (owner LIKE 'Voluntary%' OR (owner LIKE 'Government%' AND state = 'wa'))""")
def registry_taken_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows that are taken in, in the registry's columns."""
    key = F.col("s_suppkey")
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (key % by).cast("int"))
    raw = table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("facility_id"), F.concat(F.lit(" "), "s_name").alias("facility_name"), F.lit(None).cast("string").alias("address"), F.lit("x").alias("citytown"),
        F.when(F.col("s_nationkey") < 12, "wa").otherwise("tx").alias("state"), F.lit("1").alias("zip_code"),
        F.concat(F.lit("1 (555) "), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("telephone_number"),
        pick(["Acute Care Hospitals", "Critical Access Hospitals", "Psychiatric"], 3).alias("hospital_type"),
        pick(["Voluntary non-profit - Private", "Government - Hospital District or Authority", None, "Proprietary", "Proprietary"], 5).alias("hospital_ownership"),
    )
    return cases.registry_rows(raw).select("ccn", "name", "state", "phone")


@query()
def bill_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as bills against suppliers as hospitals of the same nation: the three that fit best."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("bill_id"), F.regexp_replace("c_name", "Customer", "Supplier").alias("hospital_name"), F.concat(F.lit("555"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 7, "0")).alias("hospital_phone"),
        F.lit(None).cast("string").alias("fap_phone"), F.lit(None).cast("string").alias("fap_url"), F.lit(None).cast("string").alias("hospital_address"), F.col("c_nationkey").alias("state"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ccn"), F.col("s_name").alias("name"), F.concat(F.lit("555"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 7, "0")).alias("phone"),
        F.lit(None).cast("string").alias("website_domain"), F.lit("x").alias("city"), F.col("s_nationkey").alias("state"),
    )
    return cases.bill_matches(c, s)


@query(r"""
WITH f AS (SELECT s_suppkey AS key, s_suppkey % 8 AS k, 100 + s_suppkey % 300 AS pct FROM supplier),
q AS (SELECT *, CASE k WHEN 0 THEN 'you may get assistance up to ' || pct || '% of the federal poverty level' WHEN 1 THEN 'you may get assistance above ' || pct || '% of the federal poverty level'
    WHEN 2 THEN 'assistance up to ' || pct || '% of the fpl, discounts up to ' || pct + 100 || '% of the fpl' WHEN 3 THEN 'financial assistance is open to insured patients' WHEN 4 THEN 'every patient may ask for help'
    WHEN 5 THEN 'residents of massachusetts and texas may apply' WHEN 6 THEN 'residents of massachusetts may apply' ELSE 'bring pay stubs to the desk' END AS quote FROM f)
SELECT key, CASE WHEN k < 3 AND contains(quote, 'above ' || pct) THEN 'quote states the percentage as a floor (above, over, at least), not a ceiling'
  WHEN k < 3 AND list_max(list_transform(regexp_extract_all(quote, '(\d+)%', 1), lambda x: CAST(x AS INT))) > pct THEN 'quote names a higher income limit than the ceiling'
  WHEN k IN (3, 4) AND NOT regexp_matches(quote, '\binsured\b') THEN 'quote does not say whether insured patients are covered'
  WHEN k IN (5, 6) AND NOT (contains(quote, 'massachusetts') AND contains(quote, 'texas')) THEN 'quote does not name every listed state as a whole state'
  WHEN k = 7 AND contains(quote, 'pay stubs') AND NOT contains(quote, 'photo id') THEN 'quote does not name every listed item' END AS reason FROM q""")
def verified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ceilings, insured flags, residencies and document lists held to their quotes, with the first reason against each."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 8).alias("k"), (F.col("s_suppkey") % 300 + 100).alias("pct"))
    k, pct, c, null = F.col("k"), F.col("pct"), F.concat, F.lit(None)
    level = F.lit("% of the federal poverty level")
    quote = (
        F.when(k == 0, c(F.lit("you may get assistance up to "), pct, level)).when(k == 1, c(F.lit("you may get assistance above "), pct, level))
        .when(k == 2, c(F.lit("assistance up to "), pct, F.lit("% of the fpl, discounts up to "), pct + 100, F.lit("% of the fpl")))
        .when(k == 3, "financial assistance is open to insured patients").when(k == 4, "every patient may ask for help")
        .when(k == 5, "residents of massachusetts and texas may apply").when(k == 6, "residents of massachusetts may apply").otherwise("bring pay stubs to the desk")
    )
    items = F.when(k.isin(5, 6), F.array(F.lit("MA"), F.lit("TX"))).when(k == 7, F.array(F.lit("pay_stubs"), F.lit("photo_id")))
    path = F.when(k < 3, verify.CEILING).when(k < 5, verify.INSURED).when(k < 7, verify.RESIDENCY).otherwise(wording.DOCUMENTS)
    source = F.col("key").cast("string").alias("source_id")
    facts = s.select(
        "key", path.alias("path"), F.lit("documented").alias("layer"), F.lit("MA").alias("state"), source, quote.alias("quote"), null.cast("string").alias("value"),
        F.when(k < 3, pct).cast("decimal(18,2)").alias("number"), F.when(k.isin(3, 4), True).alias("flag"), items.alias("items"),
        null.cast("array<struct<low:double,high:double,percent:double>>").alias("tiers"),
    )
    aside_none = s.limit(0).select(source, F.lit("").alias("reason"))
    return verify.checked(facts, s.select(source, c(F.lit("Policy: "), quote, F.lit(".")).alias("text")), aside_none).select("key", "reason")


@query("""
WITH d AS (SELECT s_suppkey AS ccn, s_suppkey || '-' || n AS source_id, CASE WHEN (s_suppkey + n) % 4 <> 0 THEN 150 + 50 * ((s_suppkey * n) % 5) END AS lim, n FROM supplier, (VALUES (1), (2), (3)) v(n))
SELECT ccn, source_id, lim AS told FROM d WHERE lim IS NOT NULL AND CASE WHEN ccn % 2 = 0 THEN n <> 1 AND lim <> 150 + 50 * (ccn % 5) ELSE true END""")
def conflicting_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose free-care limit isn't the sheet's, or that state one where the sheet has a ceiling alone."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ccn"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n"))
    limit = F.col("ccn") * F.col("n") % 5 * 50 + 150
    d = s.withColumn("source_id", F.concat_ws("-", "ccn", "n"))
    text = F.when((F.col("ccn") + F.col("n")) % 4 != 0, F.concat(F.lit("Our policy. Free care is given at or below "), limit, F.lit("% of the Federal Poverty Level.")))
    even = F.col("ccn") % 2 == 0
    rules = d.where("n = 1").select("ccn", F.when(even, limit).cast("decimal(18,2)").alias("free"), F.when(~even, 600).cast("decimal(18,2)").alias("ceiling"), "source_id")
    found = aside.document_conflicts(rules, d.select("source_id", text.alias("text")), d.select("ccn", "source_id"))
    return found.select("ccn", "source_id", F.col("limits")[0].cast("int").alias("told"))


@query("""
WITH s AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS st, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1)
SELECT c_custkey AS ccn, c_nationkey AS state FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 11 < 8 AND c_mktsegment <> 'BUILDING'
  AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM s WHERE st = 'O' AND price > 100000)""")
def website_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hospitals whose website is worth a search."""
    c = table(spark, sf_dir, "customer")
    h = c.select(F.col("c_custkey").alias("ccn"), F.col("c_nationkey").alias("state"), F.when(F.col("c_custkey") % 3 != 0, "x.org").alias("website_domain"), (F.col("c_custkey") % 11 / 10).alias("domain_confidence"))
    o = table(spark, sf_dir, "orders")
    items = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("ccn"), F.lit("domain_unconfirmed").alias("kind"))
    sheets = o.select(F.col("o_custkey").alias("ccn"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "O", "held").otherwise("published").alias("status"), (F.col("o_totalprice") > 100000).alias("has_rule"))
    return aside.website_candidates(h, items, sheets, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ccn")))


@query()
def documents_of_other_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as documents, each held by the supplier of its number: which are set aside, and by which clause."""
    s = table(spark, sf_dir, "supplier")
    names = F.concat(F.lit("Mercy "), F.replace("s_name", F.lit("#"), F.lit(" ")))
    hospitals = s.select(F.col("s_suppkey").cast("string").alias("ccn"), names.alias("name"), F.concat(F.lit("town"), F.col("s_nationkey")).alias("city"), F.when(F.col("s_nationkey") < 12, "WA").otherwise("TX").alias("state"), F.lit("example.org").alias("website_domain"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), "url", F.when(F.col("page_id") % 3 == 0, "Policy for Texas").otherwise("Policy").alias("title"), F.regexp_replace("html", r"<[^>]*>", " ").alias("text"))
    n = s.count()
    held = table(spark, sf_dir, "pages").select((F.col("page_id") % n + 1).cast("string").alias("ccn"), F.col("page_id").cast("string").alias("source_id"))
    loans = held.withColumn("lender", F.lit("1"))
    return aside.documents_set_aside(hospitals, pages, held, loans).select("ccn", "source_id", "clause")


@query("""
WITH c AS (SELECT c_custkey AS key, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'missing quote or source_id' WHEN c_custkey % 3 = 2 THEN 'unknown source_id d2' END AS first FROM customer),
f AS (
  SELECT key, 'eligibility.free_care_max_fpl' AS path, CAST(100 + k % 300 AS DOUBLE) AS number, NULL AS flag, NULL AS value, coalesce(first, CASE WHEN k % 7 = 0 THEN 'no number' END) AS reason FROM c
  UNION ALL SELECT key, 'apply.window_days_from_first_bill', CAST(200 + k % 100 AS DOUBLE), NULL, NULL, coalesce(first, CASE WHEN k % 100 < 40 THEN 'application window ' || CAST(200 + k % 100 AS VARCHAR) || ' is below the 501(r) minimum of 240 days' END) FROM c
  UNION ALL SELECT key, 'eligibility.asset_test', NULL, k % 4 IN (0, 3), NULL, coalesce(first, CASE WHEN k % 4 = 2 THEN 'not a boolean' END) FROM c
  UNION ALL SELECT key, 'contacts.phone', NULL, NULL, '(555) ' || substring(lpad(CAST(k AS VARCHAR), 7, '0'), 1, 3) || '-' || right(lpad(CAST(k AS VARCHAR), 7, '0'), 4), coalesce(first, CASE WHEN k % 11 = 0 THEN 'no phone number' END) FROM c
  UNION ALL SELECT key, unnest(['eligibility.discount_tiers', 'eligibility.residency', 'eligibility.insured_patients_covered', 'programs.presumptive', 'apply.form_url', 'apply.documents_required', 'apply.submit_methods', 'apply.decision_days',
    'collections.eca_wait_days', 'contacts.hours', 'contacts.languages', 'coverage.facilities', 'coverage.covered_providers', 'eligibility.assistance_ceiling_fpl']), NULL, NULL, NULL, 'absent' FROM c)
SELECT key, path, CASE WHEN reason IS NULL THEN number END AS number, CASE WHEN reason IS NULL THEN flag END AS flag, CASE WHEN reason IS NULL THEN value END AS value, reason FROM f""")
def draft_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of customers: every field a typed fact, or why it is skipped."""
    k = F.col("c_custkey")
    source, quote = F.concat(F.lit("d"), (k % 3).cast("string")), F.when(k % 5 == 0, "").otherwise("care is free here")
    field = lambda name, v: F.concat(F.lit(f'"{name}": '), F.lit('{"value": '), v, F.lit(', "quote": "'), quote, F.lit('", "source_id": "'), source, F.lit('"}'))
    text = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    parts = [
        field("free_care_max_fpl", text(F.when(k % 7 == 0, "none").otherwise(F.concat((k % 300 + 100).cast("string"), F.lit("%"))))), field("window_days_from_first_bill", (k % 100 + 200).cast("string")),
        field("asset_test", F.get(F.array(*[F.lit(x) for x in ('"Yes"', '"no"', '"maybe"', "true")]), (k % 4).cast("int"))),
        field("phone", text(F.when(k % 11 == 0, "12").otherwise(F.concat(F.lit("555"), F.lpad(k.cast("string"), 7, "0"))))),
    ]
    rows = table(spark, sf_dir, "customer").select(k.alias("key"), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("draft"))
    known = rows.select("key", F.explode(F.array(F.lit("d0"), F.lit("d1"))).alias("source_id"))
    return drafts.fields(rows, "key", "draft", known).select("key", "path", F.col("number").cast("double").alias("number"), "flag", "value", "reason")


@query("""
WITH c AS (SELECT c_custkey AS key, 100.0 + 50 * (c_custkey % 6) AS free, 200.0 + 50 * (c_custkey % 5) AS ceiling, c_custkey % 2 = 0 AS same, CASE WHEN c_custkey % 3 = 0 THEN 150.0 + 50 * (c_custkey % 4) END AS band FROM customer),
l AS (SELECT *, CASE WHEN free >= ceiling AND same THEN NULL ELSE free END AS kept FROM c),
s AS (SELECT *, CASE WHEN band IS NOT NULL AND (kept IS NULL OR kept > band) THEN band ELSE kept END AS settled FROM l)
SELECT key, 'eligibility.free_care_max_fpl' AS path, CAST(settled AS DOUBLE) AS number, NULL AS n_bands FROM s WHERE settled IS NOT NULL
UNION ALL SELECT key, 'eligibility.discount_tiers', NULL, 1 FROM s WHERE band IS NOT NULL
UNION ALL SELECT key, 'eligibility.assistance_ceiling_fpl', CAST(ceiling AS DOUBLE), NULL FROM s WHERE settled IS NULL AND band IS NULL""")
def draft_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The income limits of drafts, settled between the stated limit, the ceiling and the table."""
    k, s = F.col("c_custkey"), (lambda x: x.cast("string"))
    said = lambda v, quote: F.concat(F.lit('{"value": '), v, F.lit(', "quote": "'), quote, F.lit('", "source_id": "d"}'))
    passage = F.lit("help up to so many percent of the poverty level")
    band = s(150 + 50 * (k % 4))
    tiers = F.concat(F.lit('[{"max_fpl_inclusive": '), band, F.lit(', "discount_percent": 100}, {"min_fpl_exclusive": '), band, F.lit(', "max_fpl_inclusive": "900", "discount_percent": 50}]'))
    fields = F.concat_ws(
        ", ", F.concat(F.lit('"free_care_max_fpl": '), said(s(100 + 50 * (k % 6)), passage)), F.concat(F.lit('"assistance_ceiling_fpl": '), said(s(200 + 50 * (k % 5)), F.when(k % 2 == 0, passage).otherwise("another passage of the document"))),
        F.when(k % 3 == 0, F.concat(F.lit('"discount_tiers": '), said(tiers, F.lit("a table of discounts")))),
    )
    rows = table(spark, sf_dir, "customer").select(k.alias("key"), F.concat(F.lit("{"), fields, F.lit("}")).alias("draft"))
    facts, _ = drafts.reconciled(drafts.fields(rows, "key", "draft", rows.select("key", F.lit("d").alias("source_id"))), "key")
    return facts.select("key", "path", F.col("number").cast("double").alias("number"), F.when(F.col("tiers").isNotNull(), F.size("tiers")).alias("n_bands"))


_RECHECK = """
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS sheet, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'held' ELSE 'published' END AS status, 1 + s_suppkey % 3 AS version FROM supplier),
r AS (SELECT *, CASE WHEN k % 4 <> 3 THEN 'eligibility.free_care_max_fpl' ELSE 'eligibility.assistance_ceiling_fpl' END AS path,
  CASE WHEN k % 4 <> 3 AND k % 5 = 0 THEN 'value not in quote' WHEN k % 4 = 3 AND k % 8 <> 3 THEN 'quote states the free-care band, not the ceiling' END AS reason, status = 'published' AND k % 7 = 0 AS unplaced FROM s)"""


@query(_RECHECK + """
SELECT sheet, path, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT sheet, 'sheet', 'place unconfirmed' FROM r WHERE unplaced""")
def recheck_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stored sheets would lose, or be held for, under the rules as they are now."""
    return rechecks.what_if(_recheck_plan(spark, sf_dir)[0])


@query(_RECHECK + """
SELECT sheet, version + 1 AS version, CASE WHEN unplaced OR reason IS NOT NULL THEN 'held' ELSE 'published' END AS status FROM r WHERE status = 'published' AND (reason IS NOT NULL OR unplaced)""")
def recheck_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next versions of the published sheets that lose something, and their status."""
    return rechecks.applied(*_recheck_plan(spark, sf_dir))[0]


@query(_RECHECK + """
SELECT sheet, path, 'quote states the free-care band, not the ceiling' AS reason, CAST(100 + k % 300 AS DOUBLE) AS ruled_value FROM r WHERE k % 8 = 3""")
def ruling_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that owners' rulings are kept over, each to be filed once."""
    none = spark.createDataFrame([], "sheet string, path string, reason string, ruled_value decimal(18,2), decided_at string")
    out = rechecks.conflicts_to_file(_recheck_plan(spark, sf_dir)[0], none)
    return out.select("sheet", "path", "reason", F.col("ruled_value").cast("double").alias("ruled_value"))


def _recheck_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A second look at one limit of each supplier: a free limit, or a ceiling that reads as the free band."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.cast("string").alias("sheet"), k.alias("k"), (k % 300 + 100).alias("pct"))
    k, pct, null = F.col("k"), F.col("pct"), F.lit(None)
    free = k % 4 != 3
    quote = F.when(free, F.concat(F.lit("free care up to "), pct, F.lit("% FPL"))).otherwise(F.concat(F.lit("below "), pct, F.lit("% of FPL, patients receive a 100% discount")))
    facts = s.select(
        "sheet", F.when(free, verify.FREE).otherwise(verify.CEILING).alias("path"), F.lit("documented").alias("layer"), F.lit("MA").alias("state"), F.col("sheet").alias("source_id"), quote.alias("quote"),
        null.cast("string").alias("value"), F.when(free & (k % 5 == 0), pct + 1).otherwise(pct).cast("decimal(18,2)").alias("number"), null.cast("boolean").alias("flag"), null.cast("array<string>").alias("items"),
        null.cast("array<struct<low:double,high:double,percent:double>>").alias("tiers"),
    )
    sheets = s.select("sheet", (1 + k % 3).alias("version"), F.when(k % 3 == 0, "held").otherwise("published").alias("status"))
    texts = s.select(F.col("sheet").alias("source_id"), F.concat(F.lit("Our policy: "), quote, F.lit(".")).alias("text"))
    rulings = s.select("sheet", F.when(k % 8 == 3, "discount").otherwise("unsure").alias("decision"), pct.cast("string").alias("value"), F.lit("2026-10-23").alias("decided_at"))
    problems = s.where("k % 7 = 0").select("sheet", F.lit("place unconfirmed").alias("problem"))
    aside_none = s.limit(0).select(F.col("sheet").alias("source_id"), F.lit("").alias("reason"))
    return rechecks.plan(sheets, facts, texts, aside_none, rulings, problems)


@query("""
WITH k AS (SELECT o_orderkey AS k, o_custkey AS u, CAST(o_orderdate AS DATE) AS d, o_totalprice AS price FROM orders),
x AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'new' ELSE 'income' END AS status, CASE WHEN k % 11 <> 0 THEN u % 40 END AS ccn, k % 7 = 0 AS qmb, CASE WHEN k % 5 <> 0 THEN CAST(round(price / 6, 2) AS DECIMAL(18,2)) END AS income, 1 + k % 4 AS size, CASE k % 6 WHEN 1 THEN 'ambulance' WHEN 2 THEN 'other' ELSE 'hospital' END AS kind FROM k),
s AS (SELECT i AS ccn, CASE WHEN i % 6 = 0 THEN 'held' ELSE 'published' END AS status, 150 + 10 * (i % 10) AS free, i % 3 = 0 AS scale FROM range(0, 40) t(i) WHERE i % 10 <> 9),
r AS (SELECT x.*, s.status AS sheet, free, scale, CASE WHEN kind <> 'hospital' THEN CASE WHEN x.ccn % 4 = 0 THEN 'covered' WHEN kind = 'ambulance' THEN 'ship' ELSE 'payee_request' END END AS route,
  CAST(floor(income * 10000 / (15960 + (size - 1) * 5680) + 0.5) AS DOUBLE) / 100 AS pct FROM x LEFT JOIN s ON s.ccn = x.ccn),
t AS (SELECT *, CASE WHEN status = 'new' THEN 'unread' WHEN qmb THEN 'cost_sharing' WHEN ccn IS NULL THEN 'no_hospital' WHEN sheet IS NULL THEN 'needs_scouting' WHEN sheet <> 'published' THEN 'under_review' WHEN route IN ('ship', 'payee_request') THEN route ELSE 'answered' END AS step FROM r),
e AS (SELECT *, CASE WHEN step = 'answered' THEN CASE WHEN pct IS NULL THEN 'needs_info' WHEN scale AND pct > free AND pct <= 400 THEN 'discount' WHEN pct <= free THEN 'free' ELSE 'not_eligible' END END AS tier FROM t)
SELECT k AS case_id, step, tier, CAST(CASE tier WHEN 'free' THEN 100 WHEN 'discount' THEN 50 END AS DOUBLE) AS discount, CASE WHEN step IN ('ship', 'payee_request') OR (step = 'cost_sharing' AND kind <> 'hospital') THEN 'Valley Doctors Inc' WHEN step = 'answered' AND route = 'covered' THEN 'Valley Doctors' END AS payee,
  CASE WHEN step = 'answered' THEN CAST(d + 240 AS VARCHAR) END AS application_deadline, CASE WHEN step = 'answered' THEN date_diff('day', DATE '1999-01-01', d + 240) END AS days_left, CASE WHEN step = 'answered' AND k % 2 = 0 THEN k % 200 < 120 END AS notice_too_early, coalesce(tier IN ('free', 'discount', 'not_eligible'), false) AS predicts FROM e""")
def cases_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, from the bill to the tier and the clocks."""
    k, c = F.col("o_orderkey"), F.col
    day, null = F.to_date("o_orderdate"), F.lit(None)
    rows = table(spark, sf_dir, "orders").select(
        k.alias("case_id"), F.when(k % 13 == 0, "new").otherwise("income").alias("status"), F.lit("WA").alias("state"), F.when(k % 11 != 0, c("o_custkey") % 40).alias("ccn"),
        F.when(k % 7 == 0, F.array(F.lit("QMB"))).alias("programs"), (1 + k % 4).cast("int").alias("size"), F.when(k % 5 != 0, F.round(c("o_totalprice") / 6, 2).cast("decimal(18,2)")).alias("income"),
        F.when(k % 6 == 1, "ambulance").when(k % 6 == 2, "other").otherwise("hospital").alias("payee_kind"), F.lit("Valley Doctors Inc").alias("payee_name"), day.alias("statement_date"), null.cast("date").alias("first_statement_date"),
        (k % 2 == 0).alias("is_first_statement"), F.lit(False).alias("collection_notice"), F.when(k % 2 == 0, F.date_add(day, (k % 200).cast("int"))).alias("collection_notice_date"), null.cast("boolean").alias("predicted"),
    )
    i = c("id")
    free = (150 + 10 * (i % 10)).cast("double")
    band = F.array(F.struct(free.alias("low"), F.lit(400.0).alias("high"), F.lit(50.0).alias("percent")))
    hospitals = table(spark, sf_dir, "orders").select((c("o_custkey") % 40).alias("id")).distinct().where("id % 10 <> 9")
    sheets = hospitals.select(
        i.alias("ccn"), free.alias("free"), F.when(i % 3 == 0, band).alias("tiers"), null.cast("double").alias("ceiling"), null.cast("array<string>").alias("residency"),
        F.array().cast("array<string>").alias("presumptive"), null.cast("int").alias("window_days"), null.cast("int").alias("wait_days"),
    ).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("status", F.when((c("version") == 2) & (c("ccn") % 6 == 0), "held").otherwise("published"))
    listed = hospitals.where("id % 4 = 0").select(i.alias("ccn"), F.lit("Valley Doctors").alias("provider"), F.lit(1).alias("place"))
    listed = listed.unionByName(hospitals.where("id % 4 <> 0").select(i.alias("ccn"), F.lit("Someone else").alias("provider"), F.lit(1).alias("place")))
    out = answers.answered(rows, sheets, listed, F.to_date(F.lit("1999-01-01")))
    return out.select("case_id", "step", "tier", "discount", "payee", c("application_deadline").cast("string").alias("application_deadline"), c("days_left").cast("long").alias("days_left"), "notice_too_early", "predicts")


@query("""
WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 101) / 100.0 END AS r, c_acctbal AS v, CAST(c_custkey * 17 AS BIGINT) AS n FROM customer)
SELECT k, CASE WHEN r IS NULL THEN '' WHEN r >= 0.9 THEN 'above 9 in 10 hospitals' WHEN r >= 0.8 THEN 'above 4 in 5 hospitals' WHEN r >= 0.75 THEN 'above 3 in 4 hospitals' WHEN r >= 0.67 THEN 'above 2 in 3 hospitals' WHEN r >= 0.55 THEN 'above half of hospitals'
    WHEN r > 0.45 THEN 'about the middle of hospitals' WHEN r >= 0.33 THEN 'below half of hospitals' WHEN r >= 0.25 THEN 'below 2 in 3 hospitals' WHEN r >= 0.2 THEN 'below 3 in 4 hospitals' WHEN r >= 0.1 THEN 'below 4 in 5 hospitals' ELSE 'below 9 in 10 hospitals' END AS rank,
  format('{:,}', CAST(CASE WHEN n > 10000 THEN round_even(n / 100, 0) * 100 WHEN n > 1000 THEN round_even(n / 10, 0) * 10 ELSE n END AS BIGINT)) AS counted, CASE WHEN k % 2 = 0 THEN CAST(k % 300 AS VARCHAR) || '%' ELSE CAST(k % 300 AS VARCHAR) || '.5%' END AS share,
  CASE k % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a and b' ELSE 'a, b and c' END AS listed FROM x""")
def ledger_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, counts, shares and lists in words."""
    k = F.col("c_custkey")
    words = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), answers.rank_phrase(F.when(k % 11 != 0, (k % 101) / 100.0), "hospitals").alias("rank"), answers.count_phrase(k * 17).alias("counted"),
        answers.percent_phrase(k % 300 + F.when(k % 2 == 0, 0.0).otherwise(0.5)).alias("share"), answers.joined_phrase(words).alias("listed"),
    )
