"""Wording rules of the verification cascade: lists, ceilings, income limits, insured patients and residency."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tallyworks.functions import places, poverty
from tallyworks.functions.text import normal_of
from tallyworks.operators import verify, wording

C, FREE, TIERS, IN, RES = verify.CEILING, verify.FREE, verify.TIERS, verify.INSURED, verify.RESIDENCY
DOCS, WAYS, PROG, PROV = wording.DOCUMENTS, wording.CHANNELS, wording.PROGRAMS, wording.PROVIDERS
PART = "quote does not name every listed item"
UNTIED = "quote does not state the free-care limit as an income limit"
OTHER_STATE = "quote states the band for another state's facilities"
BASIS = "quote measures income against another benchmark than the poverty level"
WHOLE = "quote does not name every listed state as a whole state"
#: (path, quote, number, flag, items, tiers, reason)
CASES = [
    (DOCS, "bring pay stubs, a driver's license and tax returns", None, None, ["pay_stubs", "photo_id", "tax_return"], None, None),
    (DOCS, "bring pay stubs and tax returns", None, None, ["pay_stubs", "photo_id"], None, PART),
    (DOCS, "bring pay stubs and tax returns", None, None, ["pay_stubs", "pay_stubs"], None, PART),
    (DOCS, "bring pay stubs and tax returns", None, None, ["pay_stubs", "other"], None, None),
    (DOCS, "bring what the office asks for", None, None, ["photo_id"], None, "none of the listed documents is named in the quote"),
    (WAYS, "Fax it or mail it to PO Box 5", None, None, ["fax", "mail"], None, None),
    (WAYS, "Fax it or mail it to PO Box 5", None, None, ["fax", "email"], None, PART),
    (WAYS, "hand it to our people there", None, None, ["fax"], None, "none of the listed channels is named in the quote"),
    (PROG, "Patients enrolled in food stamps or WIC qualify", None, None, ["SNAP", "WIC"], None, None),
    (PROG, "Patients enrolled in food stamps or WIC qualify", None, None, ["SNAP", "Medicaid"], None, PART),
    (PROG, "Patients may be screened for Medicaid first", None, None, ["Medicaid"], None, "quote does not describe presumptive (automatic) eligibility"),
    (PROG, "Patients are deemed eligible when homeless", None, None, ["Patient is homeless."], None, "none of the listed programs is named in the quote"),
    (PROV, "It covers Valley Doctors and Mercy Group", None, None, ["Valley  Doctors"], None, None),
    (PROV, "It covers Valley Doctors and Mercy Group", None, None, ["Other Doctors"], None, "none of the listed providers is named in the quote"),
    (C, "You may get assistance up to 400% of the Federal Poverty Level", 400, None, None, None, None),
    (C, "assistance if income does not exceed four hundred percent (400%) of the 2026 HHS Poverty Guidelines", 400, None, None, None, None),
    (C, "You may get assistance up to 400% of the bill", 400, None, None, None, "quote does not state the ceiling as a percentage of the poverty level"),
    (C, "assistance for incomes above 400% of the poverty level", 400, None, None, None, "quote states the percentage as a floor (above, over, at least), not a ceiling"),
    (C, "assistance up to 200% FPL and discounts up to 400% FPL", 200, None, None, None, "quote names a higher income limit than the ceiling"),
    (C, "below 70% of FPL, patients receive a 100% discount", 70, None, None, None, "quote states the free-care band, not the ceiling"),
    (C, "households up to 300% of FPL are listed here", 300, None, None, None, "quote does not say the hospital's financial assistance reaches it"),
    (C, "payment plans and assistance up to 300% of FPL", 300, None, None, None, "quote is about another program or a payment plan"),
    (C, "assistance up to 300% of FPL if not eligible for Medicaid", 300, None, None, None, None),
    (FREE, "For Illinois facilities: free care up to 300% of FPL", 300, None, None, None, OTHER_STATE),
    (FREE, "For Maine hospitals: free care up to 300% of FPL", 300, None, None, None, None),
    (FREE, "An IL UPH Hospital gives free care up to 200% of FPL", 200, None, None, None, OTHER_STATE + ", named by its postal code"),
    (FREE, "free care up to 200% of the income eligibility limits of the Maryland Department of Health", 200, None, None, None, BASIS),
    (FREE, "free care up to 80% AMI in every household", 80, None, None, None, BASIS),
    (FREE, "free care up to 200% of the income eligibility limits (Federal Poverty Guidelines)", 200, None, None, None, None),
    (TIERS, "For Illinois facilities 201% to 300% gives a 50% discount", None, None, None, [(200.0, 300.0, 50.0)], OTHER_STATE),
    (FREE, "we give 100% charity care to those at 200% FPL", 100, None, None, None, UNTIED),
    (FREE, "we give 100% charity care to those at 200% FPL", 200, None, None, None, None),
    (FREE, "the incomes 0% - 350% have free care", 350, None, None, None, None),
    (FREE, "the incomes 201 - 300% have free care", 201, None, None, None, UNTIED),
    (FREE, "incomes 150% 100% 151 - 199% 90%", 150, None, None, None, None),
    (FREE, "free care, FPL LEVEL 200% household", 200, None, None, None, None),
    (FREE, "free care at no cost within the federal poverty level", 100, None, None, None, None),
    (FREE, "free care: inpatient up to 100% of the FPL, outpatient up to 150% of the FPL", 150, None, None, None, "quote gives different free-care limits for inpatient and outpatient care"),
    (IN, "Financial assistance is available to insured patients", None, True, None, None, None),
    (IN, "You won't be charged more than amounts generally billed to insured patients", None, True, None, None, "quote states the amounts-generally-billed cap, not who may apply"),
    (IN, "You will not pay more for care than insured individuals", None, True, None, None, "quote states a price cap benchmarked on insured patients, not who may apply"),
    (IN, "Underinsured patients:", None, True, None, None, "quote is only a heading"),
    (IN, "Every patient may ask for help", None, True, None, None, "quote does not say whether insured patients are covered"),
    (IN, "After insurance a payment plan is offered", None, True, None, None, "quote is about payment terms, not financial assistance"),
    (IN, "Assistance for patients who do not have health insurance", None, True, None, None, "quote names insurance only to say the patient has none"),
    (IN, "Assistance is available only to uninsured patients", None, False, None, None, None),
    (IN, "Uninsured patients get a discount", None, False, None, None, "quote does not say insured patients are left out of financial assistance"),
    (RES, "Residents of Maine and New Hampshire qualify", None, None, ["ME", "nh"], None, None),
    (RES, "Residents of Maine and New Hampshire qualify", None, None, [], None, "the residency list names no state"),
    (RES, "Residents of Maryland, northern Virginia and Washington, D.C.", None, None, ["MD", "VA"], None, WHOLE),
    (RES, "Residents of Washington County, Kansas City and Virginia Beach", None, None, ["WA"], None, WHOLE),
    (RES, "Residents of KS, MO or IL may apply", None, None, ["KS", "MO", "IL"], None, None),
    (RES, "North Carolina and non-North Carolina residents", None, None, ["NC"], None, "quote says residents of other states qualify too"),
    (RES, "Residents of North and South Dakota may apply", None, None, ["ND", "SD"], None, None),
]
SHAPE = (
    "key long, path string, layer string, state string, source_id string, quote string, value string, number decimal(18,2), flag boolean, "
    "items array<string>, tiers array<struct<low:double,high:double,percent:double>>"
)


def test_every_wording_has_its_reason(spark):
    rows = [(i, p, "documented", "ME", f"d{i}", q, None, Decimal(n) if n is not None else None, f, it, t) for i, (p, q, n, f, it, t, _) in enumerate(CASES)]
    texts = spark.createDataFrame([(f"d{i}", c[1]) for i, c in enumerate(CASES)], "source_id string, text string")
    none = spark.createDataFrame([], "source_id string, reason string")
    got = {r["key"]: r["reason"] for r in verify.checked(spark.createDataFrame(rows, SHAPE), texts, none).collect()}
    wrong = [(CASES[i][1], CASES[i][-1], got[i]) for i in got if got[i] != CASES[i][-1]]
    assert len(got) == len(CASES) and not wrong, wrong


def test_limits_that_documents_state(spark):
    rows = [("Free care is given at or below 200% of the FPL. Discounts reach 400% of the FPL; a payment plan 500% of the FPL.",), ("No limits",), (None,)]
    t = normal_of(F.col("t"))
    got = spark.createDataFrame(rows, "t string").select(poverty.free_care_limits(t).alias("a"), poverty.help_limits(t).alias("b")).collect()
    assert [([int(x) for x in r["a"]], [int(x) for x in r["b"]]) for r in got] == [([200], [400]), ([], []), ([], [])]


def test_states(spark):
    rows = [("West Virginia and Maine, Kansas City",), ("Delaware Valley",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(places.states_named(F.col("t")).alias("a"), places.states_as_states(F.col("t")).alias("b"), places.codes_written(F.lit("Indiana OR Illinois, MA; IN or OH")).alias("c")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(["WV", "ME", "KS"], ["WV", "ME"]), (["DE"], []), ([], []), ([], [])]
    assert set(got[0]["c"]) == {"MA", "IN", "OH"}
