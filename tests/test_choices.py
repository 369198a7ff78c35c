"""Choices among rows, reports across tables and readers of records: cases written by hand."""

from __future__ import annotations

import bisect
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import choices, ranks
from tallyworks.sources import records


def test_urls_by_class_and_score(spark):
    hits = [("a", "u1", "billing", 0.9), ("a", "u2", "fap", 0.8), ("a", "u3", "fap", 0.7), ("a", "u3", "fap", 0.1), ("a", "u4", "fap", 0.95), ("a", "u5", None, 1.0), ("a", "u6", "summary", 0.2), ("b", "x", None, 1.0)]
    got = choices.select_urls(spark.createDataFrame(hits, "k string, url string, doc_class string, score double"), "k").orderBy("place").collect()
    assert [(r["k"], r["url"]) for r in got] == [("a", "u4"), ("a", "u6"), ("a", "u1"), ("a", "u2")]


def test_siblings_and_times(spark):
    h = spark.createDataFrame([("1", "x.org", "MA"), ("2", "x.org", "MA"), ("3", "x.org", "NH"), ("4", None, "MA"), ("5", "x.org", "MA")], "ccn string, website_domain string, state string")
    s = spark.createDataFrame([("1", 1, "published", 5), ("2", 1, "published", 7), ("2", 2, "held", 8), ("5", 1, "published", 1)], "ccn string, version int, status string, created_at int")
    assert {tuple(r) for r in choices.siblings(h, s).collect()} == {("1", "5"), ("2", "1"), ("5", "1")}
    items = spark.createDataFrame([("1", 5, "a"), ("1", 6, "b"), ("2", 6, "c"), ("9", 1, "d")], "ccn string, created_at int, what string")
    assert {r["what"] for r in choices.since_published(items, s).collect()} == {"b", "d"}
    links = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "state-x"), ("2", "state-x")], "ccn string, source_id string")
    sources = spark.createDataFrame([("a", "hospital_web", 3), ("b", "hospital_web", 4), ("state-x", "hospital_web", 9)], "source_id string, kind string, fetched_on int")
    assert [tuple(r) for r in choices.newest_fetch(links, sources).collect()] == [("1", 4)]
    rows = spark.createDataFrame([(1, "new", 0), (1, "old", 1), (2, "old", 1)], "x int, vintage string, rank int")
    assert {tuple(r) for r in choices.newest_vintage(rows, ["x"], F.col("rank"), "vintage").collect()} == {(1, "new"), (2, "old")}


def test_costs(spark):
    ledger = spark.createDataFrame([("s", 1, Decimal("1.5")), ("s", 3, Decimal(2)), ("t", 3, Decimal(9))], "service string, at int, cost decimal(10,2)")
    assert [float(choices.used_since(ledger, "s", F.lit(x)).first()[0]) for x in (0, 2, 4)] == [3.5, 2.0, 0.0]
    row = spark.range(1).select(
        choices.token_cost(F.lit(1000), F.lit(500), F.lit(Decimal("0.2")), F.lit(Decimal("0.6"))).alias("t"), choices.extract_cost(F.lit(6), F.lit(True)).alias("e"), choices.map_cost(F.lit(0)).alias("m"),
        choices.map_cost(F.lit(21)).alias("n"), choices.within_cap(F.lit(3), F.lit(2), F.lit(5)).alias("y"), choices.within_cap(F.lit(4), F.lit(2), F.lit(5)).alias("z"),
    ).first()
    assert (float(row["t"]), row["e"], row["m"], row["n"], row["y"], row["z"]) == (0.0005, 4, 1, 3, True, False)


def test_accuracy(spark):
    truth, read = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "k int, name string, due int"), spark.createDataFrame([(1, "a", 5), (2, "x", None)], "k int, name string, due int")
    got = choices.field_accuracy(truth, read, "k", {f: F.col(f"t_{f}") == F.col(f"r_{f}") for f in ("name", "due")}).collect()
    assert {r["field"]: (round(r["accuracy"], 3), r["n"]) for r in got} == {"name": (0.333, 3), "due": (0.333, 3)}


def test_sentences(spark):
    sheets = spark.createDataFrame([("1", "MA"), ("2", "NY")], "ccn string, state string")
    programmes = [("MA", "p", "v", "health safety net", "Short net. The  Health Safety Net helps people. More.", "s"), ("NY", "p", "v", "nothing", "Text that lacks it.", "t")]
    got = choices.overlaid(sheets, spark.createDataFrame(programmes, "state string, path string, value string, phrase string, text string, source_id string")).collect()
    assert [(r["ccn"], r["quote"]) for r in got] == [("1", "The Health Safety Net helps people.")]
    rows = [("long sentence without it here. up to 200% of it.", "a long sentence without it here. and up to 200% of it.", "200"), ("up to 200% of it.", "x up to 200% of it.", "200"), ("not in there at all", "text", "1")]
    best = spark.createDataFrame(rows, "q string, d string, n string").select(choices.best_span(F.col("q"), F.col("d"), F.col("n").cast("int"))).collect()
    assert [r[0] for r in best] == ["up to 200% of it.", "up to 200% of it.", None]


def test_collection_flags(spark):
    rows = [(2013, ["LiensOnResidencesInd", "PermitLawsuitInd"]), (2014, ["LawsuitInd", "EngagedSellingDebtInd"]), (2016, ["EngagedLegalJudicialProcessInd", "PermitNoActionsInd"]), (2020, [])]
    got = [r["f"] for r in spark.createDataFrame(rows, "y int, c array<string>").select(choices.collection_flags(F.col("y"), F.col("c")).alias("f")).collect()]
    assert [tuple(f) for f in got] == [(False, True, True, None, ["legal_action"]), (None, None, None, True, []), (None, None, True, False, ["none"]), (None, None, False, False, [])]


def test_audit(spark):
    evidence = [(1, "apply.documents_required", "pay_stubs", "0123456789abcdef"), (2, "apply.documents_required", "a letter", "0123456789abcdef"), (3, "accountability.slip", "denied_despite_policy", "short"), (4, None, None, None)]
    got = choices.audit(
        spark.createDataFrame(evidence, "id long, field_path string, value string, case_hash string"),
        spark.createDataFrame([(1, {"decision": "x"}), (2, {"decision": "x", "note": "y"}), (3, None)], "id long, outcome map<string,string>"),
        spark.createDataFrame([(1, "rejected", "x"), (2, "open", "my ssn 123-45-6789"), (3, "open", "fine"), (4, "rejected", "")], "id long, status string, text string"),
        spark.createDataFrame([(1, ["h"], "x.org", "Mercy"), (2, [], "x.org/a", "Dear Mr. X"), (3, None, None, None)], "id long, cases array<string>, fap_url string, hospital_name string"),
    ).collect()
    assert {tuple(r) for r in got} == {
        ("evidence", "2", "value not allowed"), ("evidence", "3", "case hash"), ("evidence", "4", "value not allowed"), ("evidence", "4", "case hash"), ("case", "2", "unexpected keys"),
        ("contribution", "1", "rejected but kept"), ("contribution", "2", "personal"), ("request", "2", "no case"), ("request", "2", "address keeps a path"), ("request", "2", "personal name"), ("request", "3", "no case"),
    }


def test_json_records(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"ein": 1, "name": "A"}, "no object"]))
    (tmp_path / "dict.json").write_text(json.dumps({"count": 1, "rows": [{"ein": "2"}], "more": [{"ein": "3"}]}))
    rows = lambda name: [r["row"] for r in records.crosswalk_rows(spark, str(tmp_path / name)).collect()]
    assert (rows("list.json"), rows("dict.json"), rows("none.json")) == ([{"ein": "1", "name": "A"}], [{"ein": "2"}], [])
    (tmp_path / "skip.json").write_text(json.dumps([{"ccn": "1", "reason": "a"}, {"ccn": 1, "reason": "b", "urls_seen": ["u"], "state": "MA"}, {"ccn": "2"}, 5]))
    assert [tuple(r) for r in records.skip_list(spark, str(tmp_path / "skip.json")).collect()] == [("1", "MA", "", "b", ["u"], None)]
    assert records.skip_list(spark, str(tmp_path / "none.json")).collect() == []
    with pytest.raises(Exception, match="expected a JSON list"):
        records.skip_list(spark, str(tmp_path / "dict.json")).collect()
    (tmp_path / "dec.json").write_text(json.dumps([{"ccn": "1", "decision": "hold", "note": "n"}, {"decision": "x"}]))
    assert [tuple(r) for r in records.decisions(spark, str(tmp_path / "dec.json")).collect()] == [("1", "hold", "n")]
    for state, name in (("MA", "1.json"), ("MA", "_x.json"), ("NH", "2.json"), ("other", "3.json")):
        (tmp_path / "d" / state).mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / state / name).write_text(json.dumps({"ccn": name, "deep": {"a": 1}}))
    found = lambda *a: {(r["state"], r["file"], r["draft"]["deep"]) for r in records.drafts(spark, str(tmp_path / "d"), *a).collect()}
    assert found() == {("MA", "1.json", '{"a":1}'), ("NH", "2.json", '{"a":1}')} and {x[0] for x in found(["NH"])} == {"NH"}


def test_summary_file(spark, tmp_path):
    path = tmp_path / "s.dat"
    path.write_text("﻿GEO_ID|B17024_E107|B17024_E108\n860Z200US01001|5|6\n0400000US25|7|8\n860Z200US501|9|\n", encoding="utf-8")
    got = records.summary_file(spark, str(path), ["B17024_107E", "B17024_108E"]).collect()
    assert {tuple(r) for r in got} == {("01001", "B17024_107E", "5"), ("01001", "B17024_108E", "6"), ("00501", "B17024_107E", "9"), ("00501", "B17024_108E", None)}
    with pytest.raises(ValueError, match="missing columns"):
        records.summary_file(spark, str(path), ["B17024_120E"])


def test_ranks_in_ranges_with_very_frequent_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE", 7)
    rows = [(i, float(i % 40)) for i in range(400)] + [(1000 + i, 3.0) for i in range(3000)] + [(5000, None), (5001, None)]
    frame = spark.createDataFrame(rows, "k long, v double")
    got = {r["k"]: (r["rank"], r["peers"]) for r in ranks.percentile_ranks(frame, "v", "rank", "peers").collect()}
    known = sorted(v for _, v in rows if v is not None)
    want = {k: (None, None) if v is None else (bisect.bisect_left(known, v) / (len(known) - 1), len(known)) for k, v in rows}
    assert got == want
    assert [tuple(r) for r in ranks.percentile_ranks(frame.where("k = 0"), "v", "rank", "peers").collect()] == [(0, 0.0, None, None)]
    assert ranks.percentile_ranks(frame.limit(0), "v", "rank").collect() == []
