"""Drafts as typed facts: every field a fact or a reason, and the income limits of a draft settled."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import drafts
from tallyworks.operators.verify import FREE, TIERS

Q = "Free care up to 200% of the federal poverty level. Bring pay stubs and a tax return; mail it to PO Box 5 or fax it. Patients enrolled in SNAP or WIC qualify. It covers Valley Doctors."


def field(value, quote=Q, source="d1"):
    return {"value": value, "quote": quote, "source_id": source}


BAND = [{"min_fpl_exclusive": 200, "max_fpl_inclusive": "300%", "discount_percent": "75%"}]
#: (field, what the draft says, the column of the fact and its value, or the reason)
CASES = [
    ("free_care_max_fpl", field("200%"), "number", 200.0), ("free_care_max_fpl", field(200.5), "number", 200.5), ("free_care_max_fpl", field("none"), "reason", "no number"),
    ("free_care_max_fpl", field("1.2.3"), "reason", "not a number"), ("free_care_max_fpl", field(True), "reason", "no number"), ("free_care_max_fpl", field([200]), "number", 200.0),
    ("free_care_max_fpl", 200, "reason", "missing quote or source_id"), ("free_care_max_fpl", None, "reason", "absent"), ("free_care_max_fpl", field(None), "reason", "absent"),
    ("free_care_max_fpl", field(200, ""), "reason", "missing quote or source_id"), ("free_care_max_fpl", field(200, Q, "zz"), "reason", "unknown source_id zz"), ("free_care_max_fpl", {}, "reason", "absent"),
    ("asset_test", field("Yes "), "flag", True), ("asset_test", field(False), "flag", False), ("asset_test", field(0), "flag", False), ("asset_test", field("maybe"), "reason", "not a boolean"),
    ("residency", field(["New Jersey residents", "Kansas, Missouri, and IL"]), "items", ["NJ", "KS", "MO", "IL"]), ("residency", field("ma"), "items", ["MA"]), ("residency", field("True"), "reason", "no US state recognised"),
    ("residency", field([{"state": "MA"}]), "reason", "list items must be text, not objects or lists"), ("languages", field(["[English](x)", "**Spanish** ", " "]), "items", ["English", "Spanish"]), ("languages", field([]), "reason", "empty list"),
    ("languages", field([" "]), "reason", "empty list"), ("languages", field("French"), "items", ["French"]), ("presumptive", field(["SNAP", "Medicare"]), "items", ["SNAP"]), ("presumptive", field(["Medicare"]), "reason", "none of the listed programs is named in the quote"),
    ("presumptive", field(["SNAP"], "Ask about SNAP first"), "reason", "quote does not describe presumptive (automatic) eligibility"),
    ("form_url", field("[the form](https://x.org/f)"), "value", "https://x.org/f"), ("form_url", field(" https://x.org "), "value", "https://x.org"), ("form_url", field({"a": 1}), "reason", "expected text, got a list or object"),
    ("documents_required", field(["Pay stubs", "1040 form", "passport", "a letter"]), "items", ["pay_stubs", "tax_return", "other"]), ("documents_required", field(["passport"]), "reason", "none of the listed documents is named in the quote"),
    ("submit_methods", field([{"kind": "Post", "detail": "PO Box 5"}, {"kind": "fax"}, {"kind": "pigeon"}, {"kind": "e-mail"}]), "items", ["mail", "fax"]), ("submit_methods", field([{"kind": "Post", "detail": "[PO Box 5](x)"}]), "details", ["PO Box 5"]),
    ("submit_methods", field(["mail"]), "reason", "submit method must be an object"), ("submit_methods", field([{"kind": "pigeon"}]), "reason", "no recognised submit methods"),
    ("submit_methods", field([{"kind": "email"}]), "reason", "none of the listed channels is named in the quote"),
    ("window_days_from_first_bill", field("240 days"), "number", 240.0), ("window_days_from_first_bill", field(90), "reason", "application window 90 is below the 501(r) minimum of 240 days"),
    ("eca_wait_days", field(30), "reason", "30 is below the 501(r) minimum of 120 days; a notice period, not the collections wait"), ("decision_days", field("30.9 days"), "number", 30.0),
    ("phone", field("[Call us](tel:+15085550134)"), "value", "(508) 555-0134"), ("phone", field("508-334-9300 x5"), "value", "508-334-9300 x5"), ("phone", field("5083349300"), "value", "(508) 334-9300"), ("phone", field("334-9300"), "reason", "no phone number"),
    ("phone", field("[508-334-9300](tel:1)"), "value", "508-334-9300"), ("phone", field("123456789012"), "reason", "not a US phone number"), ("phone", field([{"kind": "main"}]), "reason", "expected text, got a list or object"),
    ("hours", field("**9 to 5**"), "value", "9 to 5"), ("covered_providers", field(["Valley Doctors", "Mercy"]), "items", ["Valley Doctors"]), ("covered_providers", field(["Mercy"]), "reason", "none of the listed providers is named in the quote"),
    ("discount_tiers", field(BAND), "tiers", [(200.0, 300.0, 75.0)]), ("discount_tiers", field([{"max_fpl_inclusive": 300, "discount_percent": 75}, {"max_fpl_inclusive": 400, "discount_percent": 40}]), "tiers", [(0.0, 300.0, 75.0), (300.0, 400.0, 40.0)]),
    ("discount_tiers", field([{"min_fpl_exclusive": "301% – 400%", "discount_percent": 40}, *BAND]), "tiers", [(200.0, 300.0, 75.0), (301.0, 400.0, 40.0)]), ("discount_tiers", field([*BAND, {"max_fpl_inclusive": 400, "discount_percent": "40-60"}, 5]), "tiers", [(200.0, 300.0, 75.0)]),
    ("discount_tiers", field([{"max_fpl_inclusive": 400, "discount_percent": "sliding"}, {"discount_percent": 5}]), "reason", "no usable tier (2 of 2 items failed to parse)"),
    ("discount_tiers", field([{"max_fpl_inclusive": 200, "discount_percent": 100}]), "reason", "only free-care bands were given; see free_care_max_fpl"), ("discount_tiers", field([]), "reason", "tiers must be a non-empty list"), ("discount_tiers", field("75%"), "reason", "tiers must be a non-empty list"),
    ("discount_tiers", field([{"max_fpl_inclusive": 200, "discount_percent": 99.5}]), "reason", "no usable tier (1 of 1 items failed to parse)"),
]


@pytest.fixture(scope="module")
def read(spark):
    def run(some):
        rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(some)]
        known = spark.createDataFrame([(i, s) for i in range(len(some)) for s in ("d1", "d2")], "id long, source_id string")
        return drafts.fields(spark.createDataFrame(rows, "id long, draft string"), "id", "draft", known)

    return run


def plain(row):
    return {k: [tuple(x) if k == "tiers" else x for x in v] if isinstance(v, list) else float(v) if k in ("number", "free_band") and v is not None else v for k, v in row.asDict().items()}


def test_every_field_is_a_fact_or_has_a_reason(read):
    got = [plain(r) for r in read([{name: said} for name, said, _, _ in CASES]).collect()]
    assert len(got) == len(CASES) * len(drafts.FIELDS)
    values = ("value", "number", "flag", "items", "tiers")
    assert all((r["reason"] is None) == any(r[v] is not None for v in values) for r in got)
    by = {(r["id"], r["path"]): r for r in got}
    for i, (name, _, column, want) in enumerate(CASES):
        row = by[i, drafts.FIELDS[name][0]]
        assert (column == "reason" or row["reason"] is None) and row[column] == want, (i, name, row)
        assert all(r["reason"] == "absent" for (k, path), r in by.items() if k == i and path != drafts.FIELDS[name][0])


def test_bad_drafts(read):
    got = read([None, "", "{", "[1, 2]", "5", "{}", json.dumps({"hours": field("9"), "extra": 1})]).collect()
    assert len(got) == 7 * len(drafts.FIELDS) and [(r["id"], r["path"]) for r in got if r["reason"] != "absent"] == [(6, "contacts.hours")]


HIGH, PART = "help up to 400% of the federal poverty level is granted", "you may qualify for full or partial help up to 400%"
TABLE = field([{"max_fpl_inclusive": 150, "discount_percent": 100}, {"max_fpl_inclusive": 300, "discount_percent": 50}], "0-150% 100%, 151-300% 50%", "d2")
#: (draft, what is left of (path, limit or number of bands), notes)
SETTLED = [
    ({"free_care_max_fpl": field(200)}, {(FREE, 200.0)}, []),
    ({"free_care_max_fpl": field(400, PART)}, set(), ["400 is quoted from 'full or partial assistance' wording, an eligibility ceiling, not a free-care band"]),
    ({"free_care_max_fpl": field(400, HIGH), "assistance_ceiling_fpl": field(400, HIGH + " here")}, {(drafts.CEILING, 400.0)}, ["stated 400 is at or above the overall assistance ceiling (400); not free care", "not stated; the documents give only an overall assistance ceiling (400% FPL)"]),
    ({"free_care_max_fpl": field(400, HIGH), "assistance_ceiling_fpl": field(400, "up to 400% we may help")}, {(FREE, 400.0)}, ["stated 400 is at or above the overall assistance ceiling (400) but cites a different passage; check which is the free band"]),
    ({"discount_tiers": TABLE}, {(FREE, 150.0), (TIERS, 1)}, []),
    ({"discount_tiers": TABLE, "free_care_max_fpl": field(100)}, {(FREE, 100.0), (TIERS, 1)}, []),
    ({"discount_tiers": TABLE, "free_care_max_fpl": field(300)}, {(FREE, 150.0), (TIERS, 1)}, ["stated 300 exceeds the 100% band (150); table used"]),
    ({"discount_tiers": field([{"max_fpl_inclusive": 150, "discount_percent": 100}])}, {(FREE, 150.0)}, []),
    ({"discount_tiers": field([{"max_fpl_inclusive": 300, "discount_percent": 50}, {"min_fpl_exclusive": 200, "max_fpl_inclusive": 400, "discount_percent": 20}])}, set(), ["discount tiers must be ascending and must not overlap"]),
    ({"assistance_ceiling_fpl": field(400, HIGH)}, {(drafts.CEILING, 400.0)}, ["not stated; the documents give only an overall assistance ceiling (400% FPL)"]),
    ({"assistance_ceiling_fpl": field(400, HIGH), "free_care_max_fpl": field(200)}, {(FREE, 200.0)}, []),
    ({"assistance_ceiling_fpl": 400, "hours": field("9 to 5")}, {("contacts.hours", None)}, []),
]


def test_limits_are_settled(read):
    facts, notes = drafts.reconciled(read([d for d, _, _ in SETTLED]), "id")
    facts, notes = [plain(r) for r in facts.collect()], notes.collect()
    for i, (_, want, said) in enumerate(SETTLED):
        assert {(r["path"], len(r["tiers"]) if r["tiers"] else r["number"]) for r in facts if r["id"] == i} == want, i
        assert sorted(r["note"] for r in notes if r["id"] == i) == sorted(said), i
    assert all(r["source_id"] == "d2" for r in facts if r["id"] in (4, 6) and r["path"] == FREE)


def test_drafts_of_one_file_are_dealt_to_all_tasks_before_they_are_parsed(spark):
    rows = spark.range(10).coalesce(1).select(F.col("id").alias("key"), F.lit("{}").alias("draft"))
    plan = drafts.fields(rows, "key", "draft", rows.select("key", F.lit("d").alias("source_id")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [key" in plan
