"""Rules on discount tables and free bands, one case a reason, and the time that long texts take."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import poverty, tables
from tallyworks.functions.text import normal_of
from tallyworks.operators import corpus, verify, wording

SHAPE = (
    "sheet string, key long, path string, layer string, state string, source_id string, quote string, value string, number decimal(18,2), flag boolean, "
    "items array<string>, tiers array<struct<low:double,high:double,percent:double>>"
)
FREE, TIERS = verify.FREE, verify.TIERS
FEE, ABOVE = "quote charges the patient within the free band", "the document gives full assistance to a band above this limit"
RANGE, ADDED = "quote gives the discount as a range or a floor, not a fixed percentage", "the discount is added to another one"
COLUMN, ONLY = "the tier is read from the wrong column of the table for this hospital", "the table is for insured patients only"
SPLIT = "the table gives different discounts for inpatient and outpatient care"
BAND = [(200.0, 300.0, 75.0)]
SYSTEM = "HSCRC-Regulated Services | Washington Hospitals and non-HSCRC Regulated Services discount "
#: (path, state, quote, number, tiers, text or None for the quote itself, reason)
CASES = [
    (FREE, "MA", "0-100% FPL: free care, patient service fee applies", 100, None, None, FEE),
    (FREE, "MA", "free care to 100% FPL. Emergency room $10", 100, None, None, FEE),
    (FREE, "MA", "free care to 100% FPL with a nominal payment", 100, None, None, FEE),
    (FREE, "MA", "free care to 100% FPL at $5 per visit", 100, None, None, FEE),
    (FREE, "MA", "free care to 100% FPL, $10 per month fee", 100, None, None, FEE),
    (FREE, "MA", "free care to 100% FPL, about $47,880 per year", 100, None, None, None),
    (FREE, "MA", "free care to 100% FPL, no patient fees", 100, None, None, None),
    (FREE, "MA", "free care to 100% FPL; service fees will not be charged", 100, None, None, None),
    (FREE, "MA", "free care to 100% FPL; patient fees are not waived", 100, None, None, FEE),
    (FREE, "MA", "free care to 200% FPL", 200, None, "free care to 200% FPL. From 201% to 350% FPL 100% financial assistance.", ABOVE),
    (FREE, "MA", "free care to 200% FPL", 200, None, "free care to 200% FPL. From 201% but less than or equal to 350% patients have free care.", ABOVE),
    (FREE, "MA", "free care to 200% FPL", 200, None, "free care to 200% FPL. From 201% to 350% FPL you may get up to 100% charity.", None),
    (FREE, "MA", "free care to 200% FPL", 200, None, "free care to 200% FPL. From 201% to 350% FPL a 100% discount on co-pays.", None),
    (FREE, "MA", "free care to 200% FPL", 200, None, "free care to 200% FPL. From 201% to 350% FPL free care after a $100 per visit fee.", None),
    (FREE, "MA", "free care to 200% FPL", 200, None, "free care to 200% FPL. From 251% to 350% FPL 100% charity.", None),
    (TIERS, "MA", "201% to 300% FPL: a discount of 75% to 90%", None, BAND, None, RANGE),
    (TIERS, "MA", "201% to 300% FPL: at least 75% discount", None, BAND, None, RANGE),
    (TIERS, "MA", "201% to 300% FPL: a discount of at least 75%", None, BAND, None, RANGE),
    (TIERS, "MA", "from 201% to 300% qualify for a 15-75% discount", None, BAND, None, RANGE),
    (TIERS, "MA", "from 201% to 300% discounts off charges from 60 percent to 75 percent", None, BAND, None, RANGE),
    (TIERS, "MA", "from 201% to 300% a sliding scale discount ranging from 75 % to 60 %", None, BAND, None, RANGE),
    (TIERS, "MA", "from 201% to 300% a discount from a scale of 10% to 75%", None, BAND, None, RANGE),
    (TIERS, "MA", "section 201% to 300% tier 2 - 75% discount", None, BAND, None, None),
    (TIERS, "MA", "from 201% to 300% when 90% and 75% discounts apply", None, BAND, None, None),
    (TIERS, "MA", "from 201% to 300% FPL with an additional 75% discount on the rest", None, BAND, None, ADDED),
    (TIERS, "MA", "from 201% to 300% FPL an additional 75% discount from the amount generally billed", None, BAND, None, None),
    (TIERS, "MD", SYSTEM + "201% to 300% 75% % 80%", None, BAND, None, None),
    (TIERS, "DC", SYSTEM + "201% to 300% 75% % 80%", None, BAND, None, COLUMN),
    (TIERS, "MD", SYSTEM + "201% to 300% 70% 75% 301% to 400% 50%", None, BAND, None, COLUMN),
    (TIERS, "DC", SYSTEM + "201% to 300% 75% 301% to 400% 50%", None, BAND, None, None),
    (TIERS, "MA", "201% to 300% discount 75%", None, BAND, "Insured Patients: 201% to 300% discount 75%", ONLY),
    (TIERS, "MA", "201% to 300% discount 75%", None, BAND, "Terms. For qualifying insured patients this holds: 201% to 300% discount 75%", ONLY),
    (TIERS, "MA", "201% to 300% discount 75%", None, BAND, "For uninsured and insured patients: 201% to 300% discount 75%", None),
    (TIERS, "MA", "201% to 300% discount 75%", None, BAND, "Insured patients: 201% to 300% discount 75%. Uninsured patients: 201% to 300% get 75% off. Insured patients pay.", None),
    (TIERS, "MA", "201% to 300% discount 75%", None, BAND, "Insured patients: 201% to 300% discount 75%. Uninsured patients: 201% to 300% get 60% off. Insured patients 75%", ONLY),
    (TIERS, "MA", "201% to 300% discount 75%", None, BAND, "Insured Patients: our rates. Un-insured patients: 201% to 300% discount 75%", None),
    (TIERS, "MA", "201% to 300% discount 75% also for self-pay", None, BAND, "Insured Patients: 201% to 300% discount 75% also for self-pay", None),
    (TIERS, "MA", "Inpatient discount 75% for 201% to 300%; outpatient discount 60%", None, BAND, None, SPLIT),
]


def reasons(spark, rows, texts, aside=()):
    facts = spark.createDataFrame([tuple(float(x) if k == 8 and x is not None else x for k, x in enumerate(r)) for r in rows], SHAPE.replace("decimal(18,2)", "double"))
    facts = facts.withColumn("number", F.col("number").cast("decimal(18,2)"))
    made = verify.checked(facts, spark.createDataFrame(texts, "source_id string, text string"), spark.createDataFrame(list(aside), "source_id string, reason string"))
    return {r["key"]: r["reason"] for r in made.collect()}


def test_one_case_a_reason(spark):
    rows = [(f"s{i}", i, path, "documented", state, f"d{i}", quote, None, number, None, None, tiers) for i, (path, state, quote, number, tiers, _, _) in enumerate(CASES)]
    texts = [(f"d{i}", c[5] or f"Policy. {c[2]} and so on.") for i, c in enumerate(CASES)]
    got = reasons(spark, rows, texts)
    assert {i: got[i] for i in got} == {i: c[-1] for i, c in enumerate(CASES)}


def test_a_free_limit_in_an_insured_table(spark):
    table = "free care up to 200%, 201% to 300% FPL discount 75%"
    text = f"For insured patients: {table}. Ask us."
    row = lambda sheet, key, path, layer, quote, number, tiers, doc="d": (sheet, key, path, layer, "MA", doc, quote, None, number, None, None, tiers)
    rows = [
        row("a", 1, TIERS, "documented", table, None, BAND), row("a", 2, FREE, "documented", "free care up to 200%", 200, None),
        row("b", 3, FREE, "documented", "free care up to 200%", 200, None), row("c", 4, TIERS, "reported", table, None, BAND), row("c", 5, FREE, "documented", "free care up to 200%", 200, None),
        row("a", 6, FREE, "documented", "free care up to 200%", 200, None, "e"),
    ]
    got = reasons(spark, rows, [("d", text), ("e", "free care up to 200% of FPL")])
    assert got == {1: ONLY, 2: ONLY, 3: None, 4: None, 5: None, 6: None}


def test_a_text_that_many_facts_cite(spark):
    rows = [(f"s{i}", i, FREE, "documented", "MA", "d", f"free care to {i}% FPL", None, i, None, None, None) for i in range(100, 700)]
    rows += [(f"n{i}", 1000 + i, FREE, "documented", "MA", None, "free care to 200% FPL", None, 200, None, None, None) for i in range(50)]
    got = reasons(spark, rows, [("d", "; ".join(f"free care to {i}% FPL" for i in range(100, 699)))])
    assert got == {i: None for i in range(100, 699)} | {699: "quote not found in source"} | {1000 + i: "source text missing" for i in range(50)}


@pytest.fixture(scope="module")
def readings(spark):
    run = "Financial assistance up to 400% " + "2026 " * 20_000 + "of the year"
    rows = [(run, run + ". Federal poverty level.", "Sliding Scale " + "100% 89% " * 2000)]
    return spark.createDataFrame(rows, "run string, said string, scale string")


def test_long_texts_are_read_in_time(spark, readings):
    four, one = F.lit(400).cast("decimal(18,2)"), F.lit(100).cast("decimal(18,2)")
    said, text = (lambda c: F.col(f"{c}_said")), (lambda c: F.col(f"{c}_text"))

    def read(df, *columns):
        df = df.select(*[normal_of(c).alias(f"{c}_said") for c in df.columns])
        return df.select("*", *[poverty.poverty_text(F.col(c)).alias(c.replace("_said", "_text")) for c in df.columns]).select(*columns).collect()[0]

    limits = (F.exists(poverty.tied_percents(text("run")), lambda x: x == four), poverty.help_limits(said("said")), poverty.states_income_limit(text("scale"), one))
    others = (wording.ceiling_problem(said("run"), text("run"), four), tables.full_help_bands(said("scale")), tables.range_discounts(said("scale")), tables.charges_patient(said("run")))
    untied = "quote does not state the ceiling as a percentage of the poverty level"
    for columns, want in ((limits, [False, [], False]), (others, [untied, [], [], False])):
        read(spark.createDataFrame([("a", "b", "c")], readings.schema), *columns)  # planning and compiling
        began = time.perf_counter()
        assert list(read(readings, *columns)) == want
        assert time.perf_counter() - began < 2


def test_a_ceiling_below_another_limit(spark):
    row = [("above 400% of the fpl, and assistance up to 40% of the fpl",)]
    got = spark.createDataFrame(row, "q string").select(wording.ceiling_problem(F.col("q"), poverty.poverty_text(F.col("q")), F.lit(40).cast("decimal(18,2)")).alias("y")).first()["y"]
    assert got == "quote names a higher income limit than the ceiling"


PLAIN = "the and of to is for with you your will be this that by if may "
#: Texts and whether they read as English.
LANGUAGES = [
    (PLAIN * 3, True), ("", True), (None, True), ("1 2 3 $4,000", True), ("Smith Jones Garcia", True), ("que y para por con una usted su", False), (PLAIN + "que y para", True),
    ("ang ng mga sa ay kung ito hindi", False), ("nie się jest oraz lub dla przez", False), ("医院为低收入患者提供经济援助计划", False), (PLAIN * 2 + "医院", True), ("hospital policy 医院为低收入患者提供经济援助", False),
    ("병원은 저소득 환자를 지원합니다", False), ("Больница помогает пациентам", False), ("dhe të në për nga një", False), ("je su za koji koja", False), ("kev pab nyiaj koj yuav thiab", False), ("pou nan yo ki li gen", False),
    ("che della delle degli dei", False), ("les et une pour dans", False), ("der die das und ist", False), ("que em uma um não ao", False), ("của và là có được cho", False), ("que y", True),
    (PLAIN + "[Español](https://x.org/que/y/para/por/con/una/usted/su/sus) que y para", True), ("ｔｈｅ ａｎｄ que", True), ("see https://x.org/que and que y", True),
]
#: Pages, and whether their prose names assistance, they are thin, and a download of them may be kept.
PAGES = [
    ("https://a/x", "our charity policy page", True, True, True), ("https://a/x", "FAP", True, True, True), ("https://a/x", "[Financial Assistance](/fa) Home News", False, True, False), ("https://a/x", "![Financial Assistance](/fa)", True, True, True),
    ("https://a/x", "billing_and_collection", True, True, True), ("https://a/x", "fapx free care", False, True, False), ("https://a/x", " " * 2000 + "menu", False, True, False), ("https://a/x", "m" * 1000, False, False, True),
    ("https://a/x.PDF?v=1", "menu", False, False, True), ("https://a/x?f=x.pdf", "menu", False, True, False), ("https://a/x", "", False, False, False), ("https://a/x", None, False, False, False),
]


def test_languages(spark):
    docs = spark.createDataFrame(list(enumerate(t for t, _ in LANGUAGES)), "id long, text string")
    got = {r["doc_id"]: r["english"] for r in corpus.language_votes(docs, "id", "text").withColumn("english", corpus.reads_as_english()).collect()}
    assert got == {i: e for i, (_, e) in enumerate(LANGUAGES)}


def test_pages_that_are_menus(spark):
    rows = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(PAGES)], "id long, url string, text string")
    got = {r["id"]: tuple(r)[1:] for r in rows.select("id", corpus.names_assistance("text"), corpus.thin("url", "text"), corpus.usable("url", "text")).collect()}
    assert got == {i: p[2:] for i, p in enumerate(PAGES)}
