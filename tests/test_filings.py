"""Schedules of returns: parsing, and each rule by which answers are given to facilities."""

from __future__ import annotations

from tallyworks.operators import cases, filings

FACILITY = "<HospitalFacilitiesGrp><FacilityNum>{0}</FacilityNum><BusinessName><BusinessNameLine1Txt>{1}</BusinessNameLine1Txt></BusinessName><USAddress><CityNm>Lynn</CityNm><StateAbbreviationCd>MA</StateAbbreviationCd><ZIPCd>019011234</ZIPCd></USAddress>{2}</HospitalFacilitiesGrp>"
POLICY = "<HospitalFcltyPoliciesPrctcGrp>{0}{1}<FPGFamilyIncmLmtFreeCarePct>{2}</FPGFamilyIncmLmtFreeCarePct>{3}</HospitalFcltyPoliciesPrctcGrp>"


def policy(line, name, limit, more=""):
    return POLICY.format("" if line is None else f"<FacilityNum>{line}</FacilityNum>", "" if name is None else f"<HospitalFacilityName><BusinessNameLine1>{name}</BusinessNameLine1></HospitalFacilityName>", limit, more)


def facility(line, name, group=None):
    return FACILITY.format(line, name, "" if group is None else f"<FacilityReportingGroupCd>{group}</FacilityReportingGroupCd>")


def xml(body, version="2022v5.0", ein="42103606", header="<TaxPeriodEndDt>2023-09-30</TaxPeriodEndDt>", share="0.02610"):
    schedule = f"<IRS990ScheduleH><FinancialAssistanceAtCostTyp><TotalExpensePct>{share}</TotalExpensePct></FinancialAssistanceAtCostTyp>{body}</IRS990ScheduleH>" if body is not None else ""
    return (
        f'<?xml version="1.0"?><Return xmlns="http://www.irs.gov/efile" returnVersion="{version}"><ReturnHeader>{header}<Filer><EIN>{ein}</EIN><BusinessName>'
        f"<BusinessNameLine1Txt>A &amp; B</BusinessNameLine1Txt></BusinessName></Filer></ReturnHeader><ReturnData>{schedule}</ReturnData></Return>"
    )


#: Of each return: facilities, groups of answers, and (line, name, free limit, rule) of what comes out.
RETURNS = {
    "lone group": ([(1, "A", "x"), (2, "B", "x")], [(5, None, 200)], [(1, "A", 200, "lone"), (2, "B", 200, "lone")]),
    "by code": ([(1, "Hill", "A"), (2, "Dale", "A"), (3, "Lake", "B")], [(2, "A", 200), (3, "Facility Reporting Group - b", 300)], [(1, "Hill", 200, "named"), (2, "Dale", 200, "named"), (3, "Lake", 300, "named")]),
    "by name": ([(1, "St. Mary Inc", None)], [(5, "Saint Mary", 250)], [(1, "St. Mary Inc", 250, "named")]),
    "rest by line": ([(1, "Hill", None), (2, "Dale", None)], [(1, "The Hill", 200), (2, "Other", 300)], [(1, "Hill", 200, "named"), (2, "Dale", 300, "named")]),
    "rest without": ([(1, "Hill", None), (2, "Dale", None)], [(1, "Hill", 200), (1, "Other", 300)], [(1, "Hill", 200, "named"), (2, "Dale", None, "named")]),
    "by line": ([(1, "Hill", None), (2, "Dale", None)], [(2, None, 200), (9, "Else", 300)], [(1, "Hill", None, "line"), (2, "Dale", 200, "line"), (9, "Else", 300, "line")]),
    "equal": ([(1, "Hill", None), (2, "Dale", None), (3, "Lake", None)], [(1, None, 200), (1, None, 200)], [(1, "Hill", 200, "equal"), (2, "Dale", 200, "equal"), (3, "Lake", 200, "equal")]),
    "in order": ([(1, "Hill", None), (2, "Dale", None)], [(1, None, 200), (1, None, 300)], [(1, "Hill", 200, "order"), (2, "Dale", 300, "order")]),
    "first alone": ([(1, "Hill", None)], [(1, "X1", 200), (1, None, 300)], [(None, "X1", 200, "first")]),
    "no answers": ([(1, "Hill", None)], [], [(1, "Hill", None, None)]),
    "no facilities": ([], [(1, None, 200), (2, "Y2", 300)], [(1, None, 200, "line"), (2, "Y2", 300, "line")]),
    "no facilities, no lines": ([], [(None, "Z", 200), (2, None, 300)], [(None, "Z", 200, "first")]),
}


def tables(spark, rows):
    return filings.parsed(spark.createDataFrame(rows, "object_id string, content string"), "object_id")


def test_each_rule(spark):
    rows = [(k, xml("".join([facility(*f) for f in fs] + [policy(*p) for p in ps]))) for k, (fs, ps, _) in RETURNS.items()]
    _, f, a = tables(spark, rows)
    got = filings.attributed(f, a).collect()
    for name, (_, _, want) in RETURNS.items():
        mine = sorted(((r["line"], r["name"], r["free_care_fpl_pct"], r["rule"]) for r in got if r["filing"] == name), key=repr)
        assert mine == sorted(want, key=repr), name
    assert filings.attributed(f.limit(0), a.limit(0)).collect() == []


def test_headers_and_boxes(spark):
    boxes = "<AssetLevelInd>X</AssetLevelInd><LawsuitInd>X</LawsuitInd><EngagedSellingDebtInd>1</EngagedSellingDebtInd><PermitLienOnResidenceInd>true</PermitLienOnResidenceInd><ReportingToCreditAgencyInd>no</ReportingToCreditAgencyInd>"
    body = facility(1, "Hill") + policy(1, None, "200.5", boxes)
    rows = [("new", xml(body)), ("old", xml(body, "2013v4.0", header="<TaxYr>2013</TaxYr><TaxPeriodEndDt>bad</TaxPeriodEndDt>", share="x")), ("between", xml(body, "2014v5.0")), ("bare", xml(None)), ("broken", "<Return"), ("null", None)]
    heads, f, a = tables(spark, rows)
    got = {r["filing"]: r for r in heads.collect()}
    assert len(got) == 6 and (got["new"]["ein"], got["new"]["tax_year"], got["new"]["tax_period"], got["new"]["filer_name"], got["new"]["charity_pct"]) == ("042103606", 2022, "202309", "A & B", 2.61)
    assert (got["old"]["tax_year"], got["old"]["period_end"], got["old"]["charity_pct"], got["bare"]["charity_pct"], got["broken"]["ein"]) == (2013, None, None, None, None)
    assert {r["zip5"] for r in f.collect()} == {"01901"} and f.count() == 3
    flags = {r["filing"]: (r["free_care_fpl_pct"], r["asset_test"], r["credit_reporting"], r["sells_debt"], r["legal_action"], r["lawsuits"], r["liens"], r["permitted_actions"]) for r in a.collect()}
    assert flags == {
        "new": (200.5, True, False, True, False, None, None, ["legal_action"]), "old": (200.5, True, False, None, True, True, False, ["legal_action"]),
        "between": (200.5, True, False, True, None, None, None, ["legal_action"]),
    }


def test_from_the_return_to_the_hospital(spark):
    body = facility(1, "Hill Hospital", "A") + facility(2, "Dale Medical Center", "B") + policy(1, "A", 200) + policy(1, "B", 300)
    heads, f, a = tables(spark, [("r", xml(body))])
    facts = filings.attributed(f, a).join(heads.select("filing", "ein"), "filing")
    hospitals = spark.createDataFrame([("220001", "042103606", "Dale Medical", "MA", "01901", "Lynn"), ("220002", "1", "Hill", "MA", "", "")], "ccn string, ein string, name string, state string, zip string, city string")
    rows = facts.withColumnRenamed("zip5", "zip").withColumnRenamed("place", "facility")
    best = cases.attributed_facility(rows.select("ein", "line", "facility", "name", "state", "zip", "city"), hospitals)
    assert [tuple(r) for r in best.join(rows.select("ein", "facility", "free_care_fpl_pct"), ["ein", "facility"]).select("ccn", "facility", "free_care_fpl_pct").collect()] == [("220001", 1, 300.0)]


def test_all_ways_are_tried_in_one_shuffle(spark):
    """Returns lie together once; missing returns' keys meet nothing."""
    f = spark.createDataFrame([(1, 1, None, "Hill", None, None, None, None, "A"), (None, 1, 1, "Dale", None, None, None, None, "A")], "filing int, place int, line int, name string, city string, state string, zip5 string, license string, group string")
    a = spark.createDataFrame([(1, 1, None, "B", 5), (1, 2, None, None, 6), (None, 1, 1, "A", 7)], "filing int, place int, line int, name string, free int")
    out = filings.attributed(f, a, ["free"])
    assert {tuple(r[k] for k in ("filing", "place", "line", "name", "rule", "free")) for r in out.collect()} == {(1, None, None, "B", "first", 5), (None, 1, 1, "Dale", None, None)}
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 1
