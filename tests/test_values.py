"""Results written down by hand: names, hosts, triage, quotes, pages, archives, budgets, origins and allocation."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import normalise as n
from tallyworks.functions import text as t
from tallyworks.operators import allocate, corpus, linkage, rules, work
from tallyworks.sources import readers


def one(spark, rows, shape, **cols):
    return [r.asDict() for r in spark.createDataFrame(rows, shape).select(*[c.alias(k) for k, c in cols.items()]).collect()]


@pytest.mark.parametrize(("name", "want"), [
    ("Mercy Hospital, Inc.", "mercy hospital"), ("St. Mary's Hospital Co", "saint mary s hospital"), ("The Clinic of Ohio LTD dba Care", "clinic ohio care"),
    ("Incorporated Company & Sons", "incorporated company sons"),
])
def test_return_names(spark, name, want):
    assert one(spark, [(name,)], "x string", y=n.return_name("x")) == [{"y": want}]


@pytest.mark.parametrize(("name", "want"), [("Valley Doctors, P.A.", "valley doctors"), ("Emerg L.L.C. Group", "emerg group"), ("A.B.C. Labs Inc.", "a b c labs"), ("Pace Imaging", "pace imaging")])
def test_payee_names(spark, name, want):
    assert one(spark, [(name,)], "x string", y=n.payee_name("x")) == [{"y": want}]


@pytest.mark.parametrize(("url", "want"), [
    ("https://www.yelp.com/x", True), ("http://en.wikipedia.org", True), ("https://health.illinois.gov/a", True), ("www.state.oh.us", True), ("https://candid.org", True),
    ("https://mercy.org", False), ("https://notyelp.com", False), ("https://gov.example.com", False), (None, False),
])
def test_directories(spark, url, want):
    assert one(spark, [(url,)], "x string", y=n.is_directory("x")) == [{"y": want}]


@pytest.mark.parametrize(("tier", "decision", "reasons", "asked", "changed", "want"), [
    ("free", "denied", ["late"], [], False, ("case_issue", None, 0, None, False)),
    ("free", "denied", ["income_too_high", "assets_too_high"], [], False, ("case_issue", None, 0, None, False)),
    ("free", "denied", ["unsigned", "incomplete", "missing_documents"], ["pay_stub"], True, ("case_issue", None, 1, None, False)),
    ("free", "denied", ["not_resident"], [], False, ("hospital_slip", False, 0, "denied_despite_policy", True)),
    ("free", "denied", ["late", "insured"], [], True, ("sheet_wrong", False, 0, None, False)),
    ("free", "denied", [], [], False, ("hospital_slip", False, 0, "denied_despite_policy", True)),
    ("free", "partial", [], [], False, ("hospital_slip", False, 0, "partial_despite_free", True)),
    ("discount", "partial", [], [], False, ("matched", True, 0, None, False)),
    ("assistance", "denied", ["other"], [], False, ("case_issue", None, 0, None, False)),
    ("not_eligible", "approved", [], [], False, ("sheet_wrong", False, 0, None, True)),
    ("free", "more_info", [], ["tax_return", "other"], False, ("matched", None, 0, None, False)),
    ("free", "more_info", [], ["pay_stub"], False, ("sheet_missing", None, 1, None, False)),
])
def test_triage(spark, tier, decision, reasons, asked, changed, want):
    shape = "tier string, decision string, reasons array<string>, asked array<string>, changed boolean"
    c = F.col
    out = rules.triage(c("tier"), c("decision"), c("reasons"), c("asked"), F.array(F.lit("tax_return")), c("changed"))
    got = one(spark, [(tier, decision, reasons, asked, changed)], shape, o=out)[0]["o"]
    assert (got["kind"], got["matched"], len(got["new_documents"]), got["slip"], got["rescout"]) == want


@pytest.mark.parametrize(("quote", "doc", "want"), [
    ("income of 200 percent", "With an  income\nof 200 percent you qualify", True),
    ("phone: 508-334-9300", "telephone: 508-334-9300", False),
    ("phone: 508-334-9300", "Phone: 508−334–9300", True),
    ("“Free care” is given to all", 'so "free care" is given to all.', True),
    ("uncompensated care", "uncompen-\nsated care", True),
    ("ncompensated care", "uncompen-\nsated care", False),
    ("too short", "too short", False),
    ("first span of text || second span of it", "second span of it, and first span of text", True),
    ("first span of text || another span of it", "second span of it, and first span of text", False),
    ("see [the policy](http://x) for aid", "see the policy for aid", True),
    ("ﬁnancial assistance", "financial assistance", True),
    ("a.b*c (d) [e] \\E \\Q $1", "x a.b*c (d) [e] \\e \\q $1 y", True),
    (" || ", "anything at all here", False), (None, "x", None), ("some long quote", None, None),
])
def test_quotes(spark, quote, doc, want):
    assert one(spark, [(quote, doc)], "q string, d string", y=t.quote_found_of("q", "d")) == [{"y": want}]


@pytest.mark.parametrize(("page", "want"), [
    ("<title>A</title><p>b  c<br>d<script>x<b>y</script>e", "A\nb c\nde"),
    ('<a href="/x">go\nthere</a> <a href="#top">up</a> <a>none</a>', "[go there](https://h.org/x) [up](#top) none"),
    ('<base href="/sub/"><base href="/no/"><a href=p.pdf>f</a>', "[f](https://h.org/sub/p.pdf)"),
    ('<a href="http://[bad">z</a>', "[z](http://[bad)"),
    ("a<!-- <p>b</p> -->c &amp; d &lt;e&gt;", "ac & d <e>"), ("<style>p{}</style>", ""), ('<p title="a>b">t', "t"), ("", ""), (None, None),
])
def test_pages(spark, page, want):
    assert one(spark, [(page, "https://h.org/q/")], "p string, b string", y=t.html_text_of("p", "b")) == [{"y": want}]


def test_shells_on_whole_pages(spark):
    same, named = "<p>menu</p>" * 50, "<p>menu</p>" * 50 + "charity care"
    rows = [("a/1", same), ("a/2", same), ("a/3", same + "x"), ("b/1", named), ("b/2", named), ("c.pdf", same)]
    got = corpus.navigation_shells(spark.createDataFrame(rows, "url string, html string"), "url", "html").collect()
    assert sorted(r["url"] for r in got) == ["a/1", "a/2"]


def test_origins_of_long_chains_and_circles(spark):
    loans = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    got = {(r["borrower"], r["origin"]) for r in linkage.origins(spark.createDataFrame(loans, "borrower long, lender long")).collect()}
    assert got == {(i, 40) for i in range(40)} | {(100, 101), (101, 102), (102, 100)}


def test_budget_in_ranges(spark):
    rows = [(i, float(i % 7)) for i in range(1000)]
    queue = spark.createDataFrame(rows, "k long, c double")
    got = {r["k"]: r["spent"] for r in work.within_budget(queue, [F.col("k").desc()], F.col("c"), 500.0, 16).collect()}
    want, spent = {}, 0.0
    for k, c in reversed(rows):
        spent += c
        if spent <= 500.0:
            want[k] = spent
    assert got == want


def test_providers_without_places(spark):
    served = spark.createDataFrame([("p", 2.5, 3)], "provider string, served double, places long")
    got = allocate.with_all_providers(spark.createDataFrame([("p",), ("q",)], "provider string"), served, "provider").collect()
    assert {tuple(r) for r in got} == {("p", 2.5, 3), ("q", None, 0)}


def test_newest_returns(spark):
    good = {"RETURN_TYPE": " 990 ", "OBJECT_ID": "202502269349301705", "XML_BATCH_ID": "2025_TEOS_XML_08A", "EIN": "42103580", "TAX_PERIOD": "202409", "SUB_DATE": "2025"}
    rows = [good, good | {"TAX_PERIOD": "202309", "OBJECT_ID": "202402269349301705"}, good | {"TAX_PERIOD": "202512", "OBJECT_ID": "12"}, good | {"TAX_PERIOD": "202512", "XML_BATCH_ID": "../x"}, good | {"RETURN_TYPE": "990T", "TAX_PERIOD": "202512"}]
    frame = spark.createDataFrame([tuple(r[k] for k in good) for r in rows], ", ".join(f"{k} string" for k in good))
    got = readers.newest_returns(frame, spark.createDataFrame([("042103580",)], "ein string")).collect()
    assert [(r["ein"], r["TAX_PERIOD"], r["OBJECT_ID"]) for r in got] == [("042103580", "202409", "202502269349301705")]


def test_array_tables_of_two_files(spark, tmp_path):
    for name, zip_code, value in (("a", "01", "5"), ("b", "02", "-666666666")):
        (tmp_path / f"{name}.json").write_text(json.dumps([["V_1", "V_2", "zcta"], [value, None, zip_code]]))
    got = readers.census_sums(readers.array_table(spark, str(tmp_path)), ["V_1", "V_2"], "zcta").collect()
    assert {tuple(r) for r in got} == {("01", 5), ("02", 0)}


def test_members_of_any_size(spark, tmp_path):
    big = bytes(range(256)) * (80 << 12)  # beyond one part
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.xml", big)
        z.writestr("empty.xml", b"")
        z.writestr("no.txt", b"x")
    got = readers.zip_members(spark, str(tmp_path / "x.zip"), r".*\.xml").orderBy("member", "part").collect()
    assert b"".join(bytes(r["content"]) for r in got if r["member"] == "big.xml") == big
    assert {r["member"] for r in got} == {"big.xml", "empty.xml"} and [r["part"] for r in got if r["member"] == "big.xml"] == list(range(5))
