"""Documents of other places: cases written by hand, one a clause, and the ones that stay."""

from __future__ import annotations

import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from tallyworks.functions import places
from tallyworks.operators import aside, corpus

HOSPITALS = [
    ("h1", "Clarke County Hospital", "Osceola", "IA", "clarkehosp.org"), ("h2", "Methodist Pekin", "Pekin", "IA", "methodist.org"), ("h3", "Mercy San Juan", "Carmichael", "CA", "commonspirit.org"),
    ("h4", "Longmont United Hospital", "Longmont", "CO", "commonspirit.org"), ("h5", "Canton Potsdam Hospital", "Potsdam", "NY", "rochester.org"), ("h6", "Rochester General Hospital", "Rochester", "NY", "rochester.org"),
    ("h7", "Sierra Nevada Memorial", "Grass Valley", "CA", "sierra.org"), ("h8", "Oakland Foundation", "Oakland", "CA", "kp.org"), ("h9", "Nowhere Clinic Downs", "Downs", "KS", None),
]
EN = "This is the policy for you and it is what we have. "
ES = "Usted puede pedir una ayuda para su cuenta cuando no tiene seguro, y los que son pacientes pueden pedir. "
DOCUMENTS = [
    ("dental", "https://clarkehosp.org/dental-financial-assistance/faq", "FAQ", EN), ("both", "https://clarkehosp.org/fap", "Medical/Dental Financial Assistance", EN + "poverty level for Osceola"),
    ("texas", "https://clarkehosp.org/policy-texas.pdf", "Policy | Iowa Health", EN), ("iowa", "https://clarkehosp.org/policy-iowa.pdf", "Policy for Texas and Iowa", EN), ("county", "https://clarkehosp.org/p", "Washington County care", EN),
    ("foreign", "https://unity.org/p", "Policy", EN + "Hospitals include: Methodist Pekin of Pekin"), ("with_it", "https://unity.org/form", "Form", EN), ("alone", "https://other.org/form", "Form", EN),
    ("all", "https://third.org/p", "Policy", EN + "Applies to: all. Hospitals include: Methodist Pekin of Pekin"), ("schedule", "https://clarkehosp.org/s", "Policy", EN + "included in attached Schedule D: Methodist Pekin of Pekin"),
    ("spanish", "https://clarkehosp.org/es", "Ayuda", ES), ("loan", "https://commonspirit.org/a", "Application", EN + "Return to Mercy San Juan, Carmichael"), ("system", "https://commonspirit.org/g", "G-003", EN),
    ("links", "https://rochester.org/pages/", "Pages", EN + "[Canton-Potsdam Hospital Financial Assistance Policy](/cp.pdf) [Rochester General Hospital Financial Assistance Policy](https://www.rochester.org/rg.pdf)"),
    ("rg", "https://rochester.org/rg.pdf", "Policy", EN + "of the General"), ("nevada", "https://sierra.org/sierra-nevada-policy", "Sierra Nevada", EN), ("region", "https://healthy.kp.org/support/mfa-policy-nw-2023-english.pdf", "Policy", EN),
    ("copay", "https://healthy.kp.org/support/co-pay-policy.pdf", "Policy", EN), ("none", None, None, None), ("only_es", "https://x.org/es", "Ayuda", ES),
]
HELD = {
    "h1": "dental both texas iowa county foreign with_it alone all schedule spanish none".split(), "h3": ["loan", "system"], "h4": ["loan", "system"], "h5": ["links", "rg"], "h6": ["links", "rg"], "h7": ["nevada"],
    "h8": ["region", "copay"], "h9": ["only_es", "none"],
}
WANT = {
    ("h1", "dental"): "dental", ("h1", "texas"): "other_state", ("h1", "foreign"): "A2", ("h1", "with_it"): "A2", ("h1", "schedule"): "S", ("h1", "spanish"): "translation", ("h4", "loan"): "lent",
    ("h5", "rg"): "B", ("h8", "region"): "region",
}


def _tables(spark):
    return (
        spark.createDataFrame(HOSPITALS, "ccn string, name string, city string, state string, website_domain string"), spark.createDataFrame(DOCUMENTS, "source_id string, url string, title string, text string"),
        spark.createDataFrame([(h, d) for h, ds in HELD.items() for d in ds * 2], "ccn string, source_id string"), spark.createDataFrame([("h4", "loan", "h3"), ("h4", "system", "h3")], "ccn string, source_id string, lender string"),
    )


def test_each_clause_sets_its_document_aside(spark):
    got = aside.documents_set_aside(*_tables(spark)).collect()
    assert {(r["ccn"], r["source_id"]): r["clause"] for r in got} == WANT and len(got) == len(WANT)
    assert all(r["reason"] == aside.REASONS[r["clause"]] for r in got)


def test_nothing_is_set_aside_of_empty_tables(spark):
    assert aside.documents_set_aside(*[t.limit(0) for t in _tables(spark)]).collect() == []


def test_document_classes(spark):
    rows = [
        ("https://a.org/financial-assistance-form.pdf", "", "application"), ("https://a.org/x", "Financial assistance plain language", "summary"), ("https://a.org/x", "Charity Care Policy", "fap"), ("https://a.org/collections", "", "billing"),
        ("https://a.org/fap", "", "fap"), ("https://a.org/charity.mp3", "", None), ("https://a.org/charity-golf", "Golf charity", None), ("https://a.org/doc?type=application/pdf", "Financial summary", "summary"), ("https://a.org/p", "Performance", None),
    ]
    got = spark.createDataFrame(rows, "u string, t string, want string").select("u", "want", aside.document_class(F.col("u"), F.col("t")).alias("got")).collect()
    assert [(r["u"], r["got"]) for r in got] == [(u, w) for u, _, w in rows]


def test_places_and_websites(spark):
    hospitals, _, _, _ = _tables(spark)
    docs = spark.createDataFrame([("a", "Care in Osceola, IA 50213"), ("b", "Care in Iowa"), ("c", "Osceola"), ("d", " "), ("e", "Iowa. Clarke")], "source_id string, text string")
    problem = lambda ids: [r["problem"] for r in aside.place_unconfirmed(hospitals, docs, spark.createDataFrame([("h1", i) for i in ids], "ccn string, source_id string")).collect()]
    assert (problem("a"), problem("b"), problem("c"), problem("d"), problem("e"), problem("bc")) == ([], ["name"], ["state"], [], [], [])
    rows = spark.createDataFrame([("x.org", 0.9), ("x.org", 0.6), ("x.org", None), (None, 0.1), ("", None), ("x.org", 1.0)], "d string, c double")
    assert [r[0] for r in rows.select(aside.domain_unconfirmed(F.col("d"), F.col("c"))).collect()] == [False, True, True, False, False, False]
    h = spark.createDataFrame([("a", "MA", "x.org", 0.6), ("b", "CA", "x.org", 0.6), ("c", "CA", "x.org", 0.9), ("d", "CA", "x.org", 0.1), ("e", "CA", "x.org", 0.1)], "ccn string, state string, website_domain string, domain_confidence double")
    items = spark.createDataFrame([(x, "domain_unconfirmed") for x in "abcd"], "ccn string, kind string")
    sheets = spark.createDataFrame([("a", 1, "held", True), ("b", 1, "held", True), ("c", 1, "held", True), ("d", 1, "held", True), ("d", 2, "published", True), ("e", 1, "held", True)], "ccn string, version int, status string, has_rule boolean")
    found = lambda skip: [r["ccn"] for r in aside.website_candidates(h, items, sheets, spark.createDataFrame(skip, "ccn string")).collect()]
    assert found([]) == ["b", "a"] and found([("b",)]) == ["a"]


def test_borrowed_and_gone(spark):
    facts = spark.createDataFrame([("a", "contacts.phone", "s"), ("a", "eligibility.free", "s"), ("a", "contacts.hours", "own"), ("b", "contacts.phone", "s"), ("c", "x", None)], "ccn string, path string, source_id string")
    lent = spark.createDataFrame([("a", "s"), ("a", "s")], "ccn string, source_id string")
    left = {tuple(r)[:2] for r in aside.without_borrowed(facts, lent).select("ccn", "path").collect()}
    assert left == {("a", "eligibility.free"), ("a", "contacts.hours"), ("b", "contacts.phone"), ("c", "x")}
    kept, hold = aside.held_without(facts, lent)
    assert {tuple(r) for r in kept.select("ccn", "path").collect()} == {("a", "contacts.hours"), ("b", "contacts.phone"), ("c", "x")} and [r["ccn"] for r in hold.collect()] == ["a"]


def test_documents_that_state_other_limits(spark):
    said = "Free care is given at or below {}% of the FPL."
    docs = spark.createDataFrame([("own", said.format(250)), ("new", said.format(200)), ("same", said.format(250)), ("help", "Discounts reach 400% of the FPL."), ("null", None)], "source_id string, text string")
    rules = spark.createDataFrame([("a", Decimal(250), None, "own"), ("b", None, Decimal(300), "help"), ("c", None, Decimal(500), "help")], "ccn string, free decimal(18,2), ceiling decimal(18,2), source_id string")
    held = [("a", x) for x in ("own", "new", "same", "help", "null")] + [("b", "help"), ("b", "same"), ("c", "help")]
    got = aside.document_conflicts(rules, docs, spark.createDataFrame(held, "ccn string, source_id string")).collect()
    assert {(r["ccn"], r["source_id"]): [int(x) for x in r["limits"]] for r in got} == {("a", "new"): [200], ("b", "help"): [400], ("b", "same"): [250]}


def test_translations_and_kinds(spark):
    english = "Our financial assistance policy gives free care to patients with an income of up to 200% of the federal poverty level, and the hospital will tell you if you may apply. "
    other = {"zh": "医院为低收入患者提供经济援助计划。", "tl": "ang mga pasyente ay tutulungan kung sila ay hindi kaya ng bayad sa ospital ", "pl": "pacjent nie płaci jeśli jest ubogi oraz może być objęty pomocy finansowej przez szpital "}
    rows = [("en", "https://x.org/en", "Policy", english * 3, "hospital_web")] + [(k, f"https://x.org/{k}", "Policy", t * 3, "hospital_web") for k, t in other.items()] + [("state-zh", "https://x.org/s", "Policy", other["zh"] * 3, "state")]
    docs = spark.createDataFrame(rows, "source_id string, url string, title string, text string, kind string")
    hospitals = spark.createDataFrame([("h", "Elm Street Hospital", "Lynn", "MA", "x.org")], "ccn string, name string, city string, state string, website_domain string")
    held = spark.createDataFrame([("h", r[0]) for r in rows], "ccn string, source_id string")
    loans = spark.createDataFrame([], "ccn string, lender string, source_id string")
    found = lambda d: {(r["source_id"], r["clause"]) for r in aside.documents_set_aside(hospitals, d, held, loans).collect()}
    assert found(docs) == {(k, "translation") for k in other}
    assert found(docs.drop("kind")) == {(k, "translation") for k in [*other, "state-zh"]}


def test_words_that_are_no_towns_are_dropped_where_they_are_read(spark, monkeypatch):
    """However many hospitals there are: only towns' words go on to meet them, and texts of one part are dealt out first."""
    written = []
    materialise = aside.materialise
    monkeypatch.setattr(aside, "materialise", lambda df: written.append(df) or materialise(df))
    hospitals, documents, held, loans = _tables(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = aside.documents_set_aside(hospitals, documents, held, loans).collect()
        plans = [df._jdf.queryExecution().sparkPlan().toString() for df in written]
        monkeypatch.setattr(aside, "TOWNS", 2)  # more towns than are sent to all tasks
        unsent = aside.documents_set_aside(hospitals, documents, held, loans).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    words = plans[0].splitlines()
    semi, spread = (next(i for i, line in enumerate(words) if x in line) for x in ("BroadcastHashJoin [word", "Generate explode"))
    assert "LeftSemi" in words[semi] and semi < spread and not any("Exchange" in line for line in words[semi:spread])
    assert all("RepartitionByExpression" in p or "REPARTITION_BY_COL" in p for p in (plans[0], next(p for p in plans if "ArrowEvalPython" in p)))
    assert {(r["ccn"], r["source_id"]): r["clause"] for r in got} == WANT == {(r["ccn"], r["source_id"]): r["clause"] for r in unsent}


def test_forms_and_votes_equal_slow_versions(spark):
    rng = random.Random(8)
    names = list(places.STATES.values())
    parts = [*names, "West Virginia", "virginias", "arkansas-city", "kansasx", "it's", "the’", " ", "  ", "\t", "\n ", " \r\n", "\x0b", "of", "und", "que", "для", "Ωmega", "北京", "カ・ナ", "²", "Ⅷ", "½", "𝒜", "é", "ß", "9", "_", "[a](b) ", "![x](y)", "http://x.y z", "www.a b", "İ", "\u3000"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = docs.select("id", "text", aside.plain(F.col("text")).alias("plain"), places.states_named(F.col("text")).alias("states")).collect()
    for r in got:
        want = r["text"] and re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("['’]", "", r["text"].lower())).strip(" ")
        assert r["plain"] == want, r["text"]
    slow = docs.select(F.lower("text").alias("t"), "id").select("id", F.regexp_extract_all("t", F.lit(rf"\b({'|'.join(sorted(names, key=len, reverse=True))})\b"), F.lit(1)).alias("n"))
    codes = {v: k for k, v in places.STATES.items()}
    assert {r["id"]: r["states"] for r in got} == {r["id"]: list(dict.fromkeys(codes[x] for x in r["n"] or [])) for r in slow.collect()}
    t = F.regexp_replace(F.lower(corpus.compatible(F.coalesce("text", F.lit("")))), corpus.LINK_TARGETS, " ")
    count = lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    latin = count(r"[\p{L}\p{Nl}\p{No}&&[a-z\u00c0-\u024f\u1e00-\u1eff]]")
    words = docs.select("id", "text", t.alias("t")).withColumn("w", F.regexp_extract_all("t", F.lit(f"{corpus.LETTER}+"), F.lit(0)))
    votes = {f"votes_{x}": F.size(F.filter("w", corpus._common(x))).cast("long") for x in corpus.COMMON_WORDS}
    want = words.select(F.col("id").alias("doc_id"), latin.alias("latin"), (count(corpus.LETTER) - latin + count(corpus.DENSE_SCRIPT)).alias("other"), *[v.alias(k) for k, v in votes.items()], "text")
    mine = corpus.language_votes(docs, "id", "text", "text")
    assert mine.columns == want.columns and sorted(map(str, mine.collect())) == sorted(map(str, want.collect()))
