"""A second look at stored sheets: the what-if, the versions it makes, rulings, and a run that finds nothing more."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tallyworks.operators import recheck, verify, wording
from tallyworks.operators.verify import CEILING, FREE, TIERS

SHAPE = (
    "sheet string, path string, layer string, state string, source_id string, quote string, value string, number decimal(18,2), flag boolean, items array<string>, "
    "tiers array<struct<low:double,high:double,percent:double>>"
)
BAND = "below 70% of FPL, patients receive a 100% discount"
BESIDE = "the document gives full assistance to a band above this limit"


def fact(sheet, path, quote, number=None, items=None, tiers=None, layer="documented"):
    return (sheet, path, layer, "MA", sheet, quote, None, None if number is None else Decimal(number), None, items, tiers)


FREE_CARE = "free care up to 200% FPL"
#: sheet: status, facts, the ruling (decision, value)
SHEETS = {
    "fine": ("published", [fact("fine", FREE, FREE_CARE, 200)], None),
    "lost": ("published", [fact("lost", FREE, FREE_CARE, 200), fact("lost", "contacts.hours", "nothing like it at all"), fact("lost", wording.DOCUMENTS, "bring pay stubs and a tax return", items=["pay_stubs", "photo_id"])], None),
    "emptied": ("published", [fact("emptied", FREE, FREE_CARE, 200), fact("emptied", wording.DOCUMENTS, "bring what you have with you", items=["photo_id"])], None),
    "ruleless": ("published", [fact("ruleless", FREE, FREE_CARE, 300)], None),
    "held": ("held", [fact("held", FREE, FREE_CARE, 300)], None),
    "share": ("published", [fact("share", FREE, FREE_CARE, 200), fact("share", TIERS, "patient responsibility 201% to 300%: 75%", tiers=[(200.0, 300.0, 75.0)])], None),
    "gap": ("published", [fact("gap", FREE, FREE_CARE, 200), fact("gap", TIERS, "from 251% to 300% a 75% discount", tiers=[(250.0, 300.0, 75.0)])], None),
    "place": ("published", [fact("place", FREE, FREE_CARE, 200)], None),
    "ruled": ("published", [fact("ruled", CEILING, BAND, 70)], ("discount", "70")),
    "unruled": ("published", [fact("unruled", CEILING, BAND, 70)], ("hold", "70")),
    "other number": ("published", [fact("other number", CEILING, BAND, 70)], ("discount", "80")),
    "overturned": ("published", [fact("overturned", CEILING, "below 70% of FPL free care for those on a payment plan, full assistance", 70)], ("discount", "70")),
    "below": ("published", [fact("below", CEILING, "assistance up to 300% of FPL", 300), fact("below", TIERS, "from 301% to 400% a 75% discount", tiers=[(300.0, 400.0, 75.0)])], ("discount", "300")),
    "empty": ("published", [], None),
    "reported": ("published", [fact("reported", FREE, None, 200, layer="reported")], None),
}


@pytest.fixture(scope="module")
def frames(spark):
    facts = [f for _, fs, _ in SHEETS.values() for f in fs]
    texts = [(s, " ".join(f[5] or "" for f in fs if f[1] != "contacts.hours") + ".") for s, (_, fs, _) in SHEETS.items()]
    return (
        spark.createDataFrame([(s, 3, v[0]) for s, v in SHEETS.items()], "sheet string, version int, status string"), spark.createDataFrame(facts, SHAPE), spark.createDataFrame(texts, "source_id string, text string"),
        spark.createDataFrame([], "source_id string, reason string"), spark.createDataFrame([(s, *v[2], "2026-10-23") for s, v in SHEETS.items() if v[2]], "sheet string, decision string, value string, decided_at string"),
        spark.createDataFrame([("place", "place unconfirmed: x"), ("held", "place unconfirmed: y")], "sheet string, problem string"),
    )


def test_the_plan_its_versions_and_a_second_run(spark, frames):
    sheets, facts, texts, aside, rulings, problems = frames
    planned, seen = recheck.plan(*frames)
    got = {r["sheet"]: r for r in planned.collect()}
    rejected = {s: [tuple(x) for x in r["rejected"]] for s, r in got.items() if r["rejected"]}
    untied = "value not in quote"
    assert rejected == {
        "lost": [("contacts.hours", "quote not found in source")], "ruleless": [(FREE, untied)], "held": [(FREE, untied)], "share": [(TIERS, "quote states the patient's share, not a discount")],
        "unruled": [(CEILING, recheck.FREE_BAND)], "other number": [(CEILING, recheck.FREE_BAND)],
        "overturned": [(CEILING, "quote is about another program or a payment plan"), (CEILING, recheck.FREE_BAND)],
    }
    assert {s: r["pruned"] for s, r in got.items() if r["pruned"]} == {
        "lost": [f"{wording.DOCUMENTS}: 1 item not named in the trimmed quote"], "emptied": [f"{wording.DOCUMENTS}: none of the listed documents is named in the quote (after trimming)"]}
    assert {s: r["inconsistent"] for s, r in got.items() if r["inconsistent"]} == {"gap": ["incomes without a rule"]}
    assert {s: [(x["path"], x["reason"], int(x["ruled_value"])) for x in r["conflicts"]] for s, r in got.items() if r["conflicts"]} == {"ruled": [(CEILING, recheck.FREE_BAND, 70)], "below": [(CEILING, "ceiling below own rules", 300)]}
    assert {s for s, r in got.items() if r["new_status"] == "held"} == {"ruleless", "held", "share", "gap", "place", "unruled", "other number", "overturned", "empty"}
    assert {s for s, r in got.items() if r["changed"]} == {"lost", "emptied", "ruleless", "held", "share", "gap", "place", "unruled", "other number", "overturned"}

    # what the what-if names is what applying it takes away
    fresh, left = recheck.applied(planned, seen)
    fresh, left = fresh.collect(), left.collect()
    assert {r["sheet"] for r in fresh} == {s for s, r in got.items() if r["changed"] and r["status"] == "published"} and {r["version"] for r in fresh} == {4}
    before = {(f[0], f[1]) for _, fs, _ in SHEETS.values() for f in fs}
    after = {(r["sheet"], r["path"]) for r in left}
    would = {(r["sheet"], r["path"]) for r in recheck.what_if(planned).collect() if r["path"] != "sheet" and got[r["sheet"]]["status"] == "published"}
    assert {x for x in before if x[0] in {r["sheet"] for r in fresh}} - after == would | {("emptied", wording.DOCUMENTS)}
    assert [r["items"] for r in left if r["path"] == wording.DOCUMENTS] == [["pay_stubs"]]

    # a second run over the applied versions changes nothing
    again = [(r["sheet"], r["version"], r["status"]) for r in fresh]
    names = ["sheet", *recheck.FACT]
    more, _ = recheck.plan(spark.createDataFrame(again, sheets.schema), spark.createDataFrame([tuple(r[n] for n in names) for r in left], SHAPE), texts, aside, rulings, problems.where("sheet <> 'place'"))
    assert [r["sheet"] for r in more.collect() if r["changed"]] == []


def test_conflicts_are_filed_once(spark, frames):
    planned, _ = recheck.plan(*frames)
    none = spark.createDataFrame([], "sheet string, path string, reason string, ruled_value decimal(18,2), decided_at string")
    first = recheck.conflicts_to_file(planned, none)
    assert {r["sheet"] for r in first.collect()} == {"ruled", "below"}
    filed = spark.createDataFrame([tuple(r) for r in first.collect()], none.schema)
    assert recheck.conflicts_to_file(planned, filed).collect() == []


def test_nothing_stored(frames):
    sheets, facts, texts, aside, rulings, problems = frames
    planned, seen = recheck.plan(sheets.limit(0), facts.limit(0), texts, aside, rulings, problems)
    assert planned.collect() == [] and seen.collect() == [] and recheck.what_if(planned).collect() == []
