"""The verification cascade, one case a reason, and cases: payees, bills, registry rows, enrollments, facilities."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import cases, verify

SHAPE = (
    "key long, path string, layer string, state string, source_id string, quote string, value string, number decimal(18,2), flag boolean, "
    "items array<string>, tiers array<struct<low:double,high:double,percent:double>>"
)
FREE, TIERS, ASSETS = verify.FREE, verify.TIERS, verify.ASSETS
#: (path, quote, value, number, flag, items, tiers, reason)
FACTS = [
    (FREE, "Care is free up to 200% of the poverty level", None, 200, None, None, None, None),
    (FREE, "Care is free up to 200.00% of the poverty level", None, 200, None, None, None, None),
    (FREE, "Care is free up to 1200% of the poverty level", None, 200, None, None, None, "value not in quote"),
    (FREE, "Care is free up to 200.5% of the poverty level", None, 200, None, None, None, "value not in quote"),
    (FREE, "200% 201% - 300% of the poverty level", None, 300, None, None, None, "quote gives the limit as the top of a later band, not the free band"),
    (FREE, "granted on a sliding scale up to 200% of poverty", None, 200, None, None, None, "quote describes a sliding scale or a denial, not free care"),
    (FREE, "100% NJ Charity Care up to 200% of poverty", None, 200, None, None, None, "quote states the band for another state's facilities"),
    (FREE, "you may qualify for full or partial help up to 400%", None, 400, None, None, None, "quote states an eligibility ceiling for any assistance, not a free-care band"),
    (FREE, "you may receive a discount of up to 100 percent at 400%", None, 400, None, None, None, "quote states an eligibility ceiling for any assistance, not a free-care band"),
    (FREE, "full charity care to 200%; 201-400% receive partial assistance", None, 200, None, None, None, None),
    (TIERS, "from 201% to 300% you get a 75% discount", None, None, None, None, [(200.0, 300.0, 75.0)], None),
    (TIERS, "from 202% to 300% you get a 75% discount", None, None, None, None, [(200.0, 300.0, 75.0)], "value not in quote"),
    (TIERS, "patient responsibility 201% to 300%: 75%", None, None, None, None, [(200.0, 300.0, 75.0)], "quote states the patient's share, not a discount"),
    (TIERS, "a discount: 100% to 200% 50%, to 300% 75%", None, None, None, None, [(100.0, 200.0, 50.0), (200.0, 300.0, 75.0)], "quote states the patient's share, not a discount"),
    (TIERS, "between 401-450% and with a financial hardship a 40% discount", None, None, None, None, [(400.0, 450.0, 40.0)], "the band needs a financial hardship, so it is not an income band"),
    (TIERS, "Inpatient Outpatient discount 201% to 300% 75% 60%", None, None, None, None, [(200.0, 300.0, 75.0)], "the table gives different discounts for inpatient and outpatient care"),
    (ASSETS, "Assets are not considered in determining eligibility.", None, None, True, None, None, "quote does not support the asset-test value"),
    (ASSETS, "Assets are not considered in determining eligibility.", None, None, False, None, None, None),
    (ASSETS, "The first $10,000 of assets shall not be counted, the limit is $20,000", None, None, True, None, None, None),
    (ASSETS, "The policy is for patients of this hospital", None, None, True, None, None, "quote does not support the asset-test value"),
    ("apply.phones", "call us at 508-334-9300 today", "[{'number': '1'}]", None, None, None, None, "value is a list or object written as text"),
    ("apply.forms", "send the form and a letter to us", None, None, None, ["form", " {x}"], None, "value is a list or object written as text"),
    ("apply.forms", "send the form and a letter to us", None, None, None, ["form"], None, None),
]


def test_first_reasons(spark):
    rows = [(i, p, "documented", "MA", f"d{i}", q, v, n, f, it, t) for i, (p, q, v, n, f, it, t, _) in enumerate(FACTS)]
    rows += [
        (100, FREE, "reported", "MA", None, None, None, 1, None, None, None), (101, FREE, "documented", "MA", "none", FACTS[0][1], None, 200, None, None, None),
        (102, FREE, "documented", "MA", "d1", FACTS[0][1], None, 200, None, None, None), (103, FREE, "documented", "MA", "aside", FACTS[0][1], None, 200, None, None, None),
        (104, FREE, "documented", "NJ", "d6", FACTS[6][1], None, 200, None, None, None), (105, FREE, "documented", "MA", "d0", None, None, 200, None, None, None),
    ]
    texts = spark.createDataFrame([(f"d{i}", f"Policy.\n{f[1]} and more.") for i, f in enumerate(FACTS)] + [("aside", FACTS[0][1])], "source_id string, text string")
    aside = spark.createDataFrame([("aside", "a translation")], "source_id string, reason string")
    facts = spark.createDataFrame([tuple(float(x) if k == 7 and x is not None else x for k, x in enumerate(r)) for r in rows], SHAPE.replace("decimal(18,2)", "double"))
    got = {r["key"]: r["reason"] for r in verify.checked(facts.withColumn("number", F.col("number").cast("decimal(18,2)")), texts, aside).collect()}
    want = {i: f[-1] for i, f in enumerate(FACTS)} | {100: None, 101: "source text missing", 102: "quote not found in source", 103: "a translation", 104: None, 105: "quote not found in source"}
    assert got == want


def test_a_run_of_twenty_thousand_tokens_is_read_in_time(spark):
    quote = "up to 200% of the poverty level " + "and not more than the limit of assets " * 2500
    rows = [(1, FREE, "documented", "MA", "d", quote, None, 200.0, None, None, None)]
    facts = spark.createDataFrame(rows, SHAPE.replace("decimal(18,2)", "double"))
    texts, none = spark.createDataFrame([("d", quote)], "source_id string, text string"), spark.createDataFrame([], "source_id string, reason string")
    verify.checked(facts.limit(0), texts, none).collect()
    began = time.perf_counter()
    assert verify.checked(facts, texts, none).collect()[0]["reason"] is None
    assert time.perf_counter() - began < 10  # of it some seconds for planning


@pytest.mark.parametrize(("quote", "want"), [
    ("granted on a sliding scale up to 100% of the line", True), ("granted on a sliding scale up to 100 percent of the federal poverty level", True),
    ("on a sliding scale from 100% of charges", False), ("on a sliding scale; a 100% discount up to 100% of the poverty level", False), ("prorated from free care", False),
])
def test_a_hundred_percent_of_the_line_promises_no_free_care(spark, quote, want):
    assert spark.createDataFrame([(quote,)], "q string").select(verify.not_free(F.col("q")).alias("y")).first()["y"] == want


@pytest.mark.parametrize(("programs", "want"), [(["SNAP", "QMB"], True), (["MassHealth"], True), (["snap"], False), ([], False), (None, False)])
def test_cost_sharing(spark, programs, want):
    assert spark.createDataFrame([(programs,)], "p array<string>").select(cases.cost_sharing_protected(F.col("p")).alias("y")).first()["y"] == want


def test_payees(spark):
    bills = [(1, "h", "hospital", "X"), (2, "h", "physician_group", "Valley Doctors P.A."), (3, "h", "ambulance", "Mercy Ambulance Service"), (4, "h", "other", None), (5, "h", None, "Y"), (6, "g", "other", "Valley Doctors")]
    listed = [("h", "Mercy", 1), ("h", "Valley Doctors, Inc.", 2), ("h", "Valley Doctor", 3)]
    got = cases.payee_routes(spark.createDataFrame(bills, "bill_id long, ccn string, payee_kind string, payee_name string"), spark.createDataFrame(listed, "ccn string, provider string, place int"))
    assert {r["bill_id"]: (r["route"], r["listed"]) for r in got.collect()} == {
        1: (None, None), 2: ("covered", "Valley Doctors, Inc."), 3: ("ship", None), 4: ("payee_request", None), 5: (None, None), 6: ("payee_request", None)}


def test_bills(spark):
    hospitals = [("a", "Saint Mary Hospital", "508-334-9300", "stmary.org", "Boston", "MA"), ("b", "Mary Medical Center", None, "mary.org", "Lynn", "MA"), ("c", "Far Hospital", "508-334-9300", None, "Reno", "NV")]
    bills = [(1, "St. Mary Hospital", "(508) 334-9300", None, "https://www.stmary.org/fap", "1 Road, Boston MA", "MA"), (2, None, None, None, "pay.mary.org", "Lynn", "MA"), (3, None, None, "508-334-9300", None, "Boston", "MA")]
    got = cases.bill_matches(
        spark.createDataFrame(bills, "bill_id long, hospital_name string, hospital_phone string, fap_phone string, fap_url string, hospital_address string, state string"),
        spark.createDataFrame(hospitals, "ccn string, name string, phone string, website_domain string, city string, state string"),
    ).collect()
    best = {r["bill_id"]: (r["ccn"], r["score"], r["confident"]) for r in got if r["place"] == 1}
    assert best == {1: ("a", 125.0, True), 2: ("b", 20.0, False)}


def test_registry(spark):
    shape = "facility_id string, facility_name string, address string, citytown string, state string, zip_code string, telephone_number string, hospital_type string, hospital_ownership string"
    rows = [
        ("1", " A ", None, "X", "ma", "02139-1234 5", "1 (617) 555-0100", "Acute Care Hospitals", "Voluntary non-profit - Private"), ("2", "B", "", "X", "WA", "1", "", "Critical Access Hospitals", "Government - Hospital District or Authority"),
        ("3", "C", "", "X", "TX", "1", "", "Critical Access Hospitals", "Government - Hospital District or Authority"), ("4", "D", "", "X", "MA", "1", "", "Psychiatric", "Voluntary non-profit - Church"), ("5", "E", "", "X", None, None, None, "Acute Care Hospitals", None),
    ]
    got = {r["ccn"]: r for r in cases.registry_rows(spark.createDataFrame(rows, shape)).collect()}
    assert set(got) == {"1", "2"} and (got["1"]["name"], got["1"]["state"], got["1"]["zip"], got["1"]["phone"]) == ("A", "MA", "02139-1234", "617-555-0100")
    assert got["2"]["phone"] is None


def test_enrollments_and_facilities(spark):
    rows = [("a", "OTHER", 1), ("a", "Main site", 2), ("a", "MAIN", 3), ("b", None, 2), ("b", "x", 1)]
    got = cases.enrollment_of(spark.createDataFrame(rows, "ccn string, location_type string, line int")).collect()
    assert {(r["ccn"], r["line"]) for r in got} == {("a", 2), ("b", 1)}
    facilities = [("e", 1, "f1", "Mercy Hospital North", "MA", "02139", "Boston"), ("e", 2, "f2", "Mercy Hospital", "MA", "01001", "Lynn"), ("e", 3, "f3", "Other", "NH", "03001", "X"), ("e", 4, "f4", None, "MA", None, None)]
    hospitals = [("a", "e", "Mercy Hospital", "ma", "02139-0000", "boston"), ("b", "e", "Nothing Alike", "NH", None, None), ("c", "e", "Nothing Alike", "MA", "02139", "Boston"), ("d", "z", "Mercy", "MA", None, None)]
    got = cases.attributed_facility(spark.createDataFrame(facilities, "ein string, line int, facility string, name string, state string, zip string, city string"), spark.createDataFrame(hospitals, "ccn string, ein string, name string, state string, zip string, city string")).collect()
    assert {(r["ccn"], r["facility"], r["score"]) for r in got} == {("a", "f1", 115.0), ("b", "f3", 100.0)}
