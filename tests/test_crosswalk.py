"""Best names and the crosswalk against brute force, and the choice of enrollment rows."""

from __future__ import annotations

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from same import assert_same, connect
from tallyworks.functions.fuzzy import token_set_ratio
from tallyworks.operators import cases, crosswalk, names
from tallyworks.plans import linking

WORDS = "saint mary general mercy north valley of hospital lake view oak st county memorial grace 1 2".split()


def some_names(rng, n):
    out = [" ".join(rng.choices(WORDS, [8, 8, 8, 5, 3, 3, 2, 9, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 4))) for _ in range(n)]
    return [t if rng.random() < 0.7 else t.replace("a", "").replace("  ", " ") for t in out]


@pytest.mark.parametrize(("k", "least", "seed"), [(1, 0.1, 1), (3, 0.1, 2), (1, 90.0, 3), (2, 0.0, 4)])
def test_best_names_equal_all_pairs(spark, monkeypatch, k, least, seed):
    monkeypatch.setattr(names, "QUERIES", 16)
    monkeypatch.setattr(names, "TARGETS", 24)
    rng = random.Random(seed)
    q = [(i, t, rng.choice("ab") if i else None) for i, t in enumerate(some_names(rng, 90))]
    t = [(i, t, rng.choice("ab")) for i, t in enumerate(some_names(rng, 120))] + [(500, None, "a")]
    shape = "id long, name string, b string"
    got = names.best_names(spark.createDataFrame(q, shape), "id", F.col("name"), spark.createDataFrame(t, shape).withColumnRenamed("id", "to"), "to", F.col("name"), ["b"], ["to"], k=k, least=least)
    want = []
    for i, name, block in q:
        scored = sorted((-round(token_set_ratio(name, other or ""), 1), j) for j, other, b in t if b == block)
        want += [(i, j, -s, place) for place, (s, j) in enumerate(scored[:k], 1) if -s >= least]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_few_pairs_are_compared_letter_by_letter(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(300)]
    targets = names.Names([f"{rng.choice(words)} {rng.choice(words)} {rng.choice(['hospital', 'center'])}" for _ in range(2000)])
    compared = []
    monkeypatch.setattr(names, "token_set_ratio", lambda a, b: compared.append(1) or token_set_ratio(a, b))
    for _ in range(50):
        name = f"{rng.choice(words)} {rng.choice(words)} hospital"
        assert targets.best(name, 1)[0][1] == max(round(token_set_ratio(name, t), 1) for t in targets.names)
    assert len(compared) < 0.2 * 50 * 2000


def test_bills_equal_all_pairs(spark):
    rng = random.Random(5)
    hospitals = [(f"{i:03}", t, rng.choice([None, "555-0100", "(555) 0101", ""]), rng.choice([None, "a.org", "b.a.org", "c.com"]), rng.choice(["Lynn", "Boston", ""]), rng.choice("XY")) for i, t in enumerate(some_names(rng, 80))]
    bills = [(i, rng.choice([t, None]), rng.choice([None, "5550100", ""]), rng.choice([None, "555 0101"]), rng.choice([None, "https://www.a.org/x", "z.b.a.org"]), rng.choice([None, "1 Road, LYNN"]), rng.choice("XY")) for i, t in enumerate(some_names(rng, 60))]
    got = cases.bill_matches(
        spark.createDataFrame(bills, "bill_id long, hospital_name string, hospital_phone string, fap_phone string, fap_url string, hospital_address string, state string"),
        spark.createDataFrame(hospitals, "ccn string, name string, phone string, website_domain string, city string, state string"),
    ).collect()
    clean = lambda t: re.sub(r"[^a-z0-9 ]", " ", (t or "").lower().replace("st.", "saint").replace("ctr", "center").replace("med ", "medical "))
    digits = lambda t: re.sub(r"\D", "", t or "")
    want = []
    for i, name, one, two, url, address, state in bills:
        if not (name or one or url):
            continue
        site = "" if not url else re.sub(r"^www\.", "", re.sub(r"^https?://", "", url).split("/")[0])
        scored = []
        for ccn, other, phone, domain, city, at in hospitals:
            if at != state:
                continue
            s = 0.6 * token_set_ratio(clean(name), clean(other)) + (30 if digits(phone) and digits(phone) in {digits(one), digits(two)} else 0)
            s += 0 if not (site and domain) else 30 if site == domain else 15 if site.endswith("." + domain) else 0
            s += 5 if address and city.lower() in address.lower() else 0
            if s > 0:
                scored.append((-round(s, 1), other, ccn))
        scored.sort()
        sure = bool(scored) and -scored[0][0] >= 75 and (len(scored) == 1 or scored[1][0] - scored[0][0] >= 10)
        want += [(i, c, -s, p, p == 1 and sure) for p, (s, _, c) in enumerate(scored[:3], 1)]
    assert sorted((r["bill_id"], r["ccn"], r["score"], r["place"], r["confident"]) for r in got) == sorted(want)


def slow_crosswalk(hospitals, listed, enrollments, stored):
    """The same rules as loops over rows, one state after the other."""
    common = "THE INC INCORPORATED HOSPITAL MEDICAL CENTER CORP CORPORATION OF AND & LLC HEALTH SYSTEM DBA".split()
    plain = lambda t: " ".join(w for w in re.sub(r"[^A-Z0-9]+", " ", (t or "").upper()).split() if w not in common)
    digits = lambda t: re.sub(r"\D", "", t or "")
    ein = lambda t: (d if len(d) == 9 and not d.startswith("00") else None) if (d := digits(t).zfill(9)) else None
    number = lambda t: t.strip().zfill(6) if (t or "").strip().isdigit() and len(t.strip()) < 6 else (t or "").strip()
    zip5 = lambda t: "" if not digits(t) else digits(t).zfill(9)[:5] if len(digits(t)) > 5 else digits(t).zfill(5)
    old = {r[0]: r for r in stored}
    out = {}
    for state in sorted({h[3] for h in hospitals}):
        mine = sorted((h for h in hospitals if h[3] == state), key=lambda h: (h[1], h[0]))
        rows = [r for r in sorted(listed) if r[8] == state and ein(r[6]) and (r[4] or state) == state]
        where = {h[0]: h[3] for h in hospitals}
        by_id = {r[2]: (r[1], r[4]) for r in sorted(stored) if r[3] == "cbi" and r[1] and r[2] and where.get(r[0], state) != state}
        pending = []
        for ccn, name, city, _, zipcode in mine:
            own = [e for e in sorted(enrollments, key=lambda e: e[1]) if number(e[0]) == ccn] or sorted((e for e in enrollments if re.fullmatch(ccn + "[A-Z]", number(e[0]))), key=lambda e: (number(e[0]), e[1]))
            chosen = next((e for e in own if (e[5] or "").upper().startswith("MAIN")), own[0] if own else None)
            was = old.get(ccn, (ccn, None, None, None, None, None))
            npi, who = (chosen[2], chosen[3]) if chosen else (None, was[2])
            if was[3] == "manual" and was[1]:
                out[ccn] = (npi, who, was[1], "manual", was[4], None, None)
                continue
            found = next((r for r in rows if number(r[1]) == ccn), None)
            if found:
                out[ccn] = (npi, who, ein(found[6]), "cbi", found[2].strip() or None, None, None)
                if who:
                    by_id[who] = (ein(found[6]), found[2].strip() or None)
                continue
            pending.append((ccn, name, city, zipcode, npi, who))
        for ccn, name, city, zipcode, npi, who in pending:
            if who in by_id:
                out[ccn] = (npi, who, by_id[who][0], "enrollments", by_id[who][1], None, None)
                continue
            same = [r for r in rows if zip5(zipcode) and zip5(r[5]) == zip5(zipcode)]
            exact = next((r for r in same if plain(name) and plain(r[2]) == plain(name)), None)

            def best(those, name=name):
                top = None
                for r in those if plain(name) else []:
                    if plain(r[2]) and (top is None or round(token_set_ratio(plain(name), plain(r[2])), 1) > top[0]):
                        top = (round(token_set_ratio(plain(name), plain(r[2])), 1), r)
                return top

            near = best([r for r in same if (r[3] or "").strip().lower() == (city or "").strip().lower()])
            if exact:
                out[ccn] = (npi, who, ein(exact[6]), "name_zip", exact[2].strip(), None, None)
            elif near and near[0] >= 90:
                out[ccn] = (npi, who, ein(near[1][6]), "fuzzy", near[1][2].strip(), None, None)
            else:
                top = best(rows)
                out[ccn] = (npi, who, None, None, None, top[1][2] if top else None, top[0] if top else 0.0)
    return out


def test_crosswalk_equals_loops(spark):
    rng = random.Random(11)
    pick = lambda *some: rng.choice(some)
    titles = [t.title() + pick("", " Hospital", ", Inc.") for t in some_names(rng, 400)]
    hospitals = [(f"{i:06}", titles[i], pick("Lynn", " LYNN", "Boston", None), pick("MA", "RI"), pick("02139", "2139", "021390001", "", None)) for i in range(150)]
    listed = [(i, pick(None, "", str(rng.randint(0, 400)), f"{rng.randint(0, 400):06}"), titles[rng.randint(0, 399)], pick("lynn", "Boston", None), pick(None, "", "MA", "RI"), pick("2139", "02139-0001", None), pick("42103606", "04-2103607", "1", None, str(rng.randint(10**8, 10**9 - 1))), pick(None, "December 6, 2024", "soon"), pick("MA", "RI")) for i in range(160)]
    enrollments = [(pick(str(k), f"{k:06}", f"{k:06}{pick('A', 'B', 'C')}"), i, str(i), pick(None, "o1", "o2", "o3", f"o{rng.randint(4, 40)}"), pick("N", "P", None), pick("MAIN/PRIMARY", "OTHER", None)) for i, k in enumerate(rng.choices(range(160), k=150))]
    stored = [(h[0], pick(None, "111111111", str(rng.randint(10**8, 10**9 - 1))), pick(None, "o1", "o3", f"o{rng.randint(4, 40)}"), pick("cbi", "manual", "fuzzy"), pick("Old", None), None) for h in hospitals if rng.random() < 0.4]
    got = crosswalk.crosswalk(
        spark.createDataFrame(hospitals, "ccn string, name string, city string, state string, zip string"),
        spark.createDataFrame(listed, "line long, ccn string, name string, city string, state string, zip string, ein string, updated string, file_state string"),
        spark.createDataFrame(enrollments, "ccn string, line long, npi string, associate_id string, nonprofit string, location_type string"),
        spark.createDataFrame(stored, "ccn string, ein string, associate_id string, match_method string, matched_name string, ein_vintage string"), "2026",
    ).collect()
    want = slow_crosswalk(hospitals, listed, enrollments, stored)
    mine = {r["ccn"]: (r["npi"], r["associate_id"], r["ein"], r["match_method"], r["matched_name"], r["best_name"], r["best_score"]) for r in got}
    assert len(got) == len(hospitals) and mine == want
    assert {m[3] for m in mine.values()} == {"manual", "cbi", "enrollments", "name_zip", "fuzzy", None}
    assert {r["match_confidence"] for r in got if r["match_method"] == "enrollments"} == {0.9}
    dates = {i: f"Community Benefit Insight, updated {datetime.strptime(u, '%B %d, %Y').date() if u == 'December 6, 2024' else u}" if u else "Community Benefit Insight" for i, *_, u, _ in listed}
    assert {r["ein_vintage"] for r in got if r["match_method"] == "cbi"} <= set(dates.values())


def test_enrollment_of_units(spark):
    rows = [("1", 3, "OTHER", "x"), ("000001", 1, None, "y"), ("000001A", 0, "MAIN", "z"), ("220083B", 1, "MAIN", "b"), ("220083A", 2, "OTHER", "a"), ("220083A", 3, "other", "c"), ("9", 1, "main", "q")]
    have = spark.createDataFrame([("000001",), ("220083",), ("000002",)], "ccn string")
    got = crosswalk.enrollment_of(have, spark.createDataFrame(rows, "ccn string, line int, location_type string, who string"))
    assert {r["ccn"]: r["who"] for r in got.collect()} == {"000001": "y", "220083": "b"}


def test_numbers_of_seven_digits_equal_sql(spark, tmp_path):
    n = range(100_000, 100_400)
    tables = {
        "customer": spark.createDataFrame([(k, k % 25) for k in n], "c_custkey long, c_nationkey int"),
        "part": spark.createDataFrame([(k,) for k in [*n, *range(1_000_000, 1_004_000)]], "p_partkey long"),
        "orders": spark.createDataFrame([(3 * k, k) for k in n], "o_orderkey long, o_custkey long"),
    }
    for name, frame in tables.items():
        frame.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert assert_same(linking.registry_crosswalk(spark, str(tmp_path)), connect(str(tmp_path)), linking.SQL["registry_crosswalk"]) == 400


def test_copies_are_scored_once(spark):
    def few(asked, part):
        if len(asked) > 2 or len(part) > 4:
            raise ValueError(f"{len(asked)} queries and {len(part)} targets in one chunk")
        return lambda i: part["town"].eq(asked["town"][asked.index[i]]).to_numpy() * 5.0

    q = spark.createDataFrame([(i, "saint mary", "x" if i % 2 else "y", "a") for i in range(60)], "id long, name string, town string, b string")
    t = spark.createDataFrame([(i, "saint mary" if i % 2 else "mary general", "x", i // 2, "a") for i in range(80)] + [(99, "saint mary", "x", None, "a")], "to long, name string, town string, line long, b string")
    got = names.best_names(q, "id", F.col("name"), t, "to", F.col("name"), ["b"], ["line"], k=2, scale=0.6, extra=few).collect()
    assert sorted(map(tuple, got)) == sorted((i, 1 + 2 * j, 65.0 if i % 2 else 60.0, j + 1) for i in range(60) for j in range(2))


@pytest.mark.parametrize(("letters", "longest", "most"), [("abcdé", 6, 4), ("0123456789", 9, 2), ("ab", 63, 2), ("abc", 1, 40), ("abcdefgh中\U0001f600", 20, 6)])
def test_best_of_many_at_once_equal_all_pairs(monkeypatch, letters, longest, most):
    monkeypatch.setattr(names, "FIRST", 8)
    monkeypatch.setattr(names, "LETTERS", 9)
    monkeypatch.setattr(names, "CELLS", 1000)
    monkeypatch.setattr(names, "PAIRS", 77)
    rng = random.Random(longest)
    words = ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(60)]
    asked, targets = ([rng.choice([" ", "  "]).join(rng.choices(words, k=rng.randint(0, most))) for _ in range(n)] for n in (40, 200))
    more = [[float(rng.choice([0, 0, 0, 5, 30])) for _ in targets] for _ in asked]
    for k, scale, digits, least in ((1, 1.0, 1, 0.1), (3, 0.6, 1, 0.0), (2, 1.0, 12, 50.0), (300, 0.6, 1, 0.1)):
        got = names.Names(targets).best_of(asked, k, scale, lambda i: more[i], digits, least)
        want = []
        for i, name in enumerate(asked):
            scored = sorted((-round(scale * token_set_ratio(name, t) + m, digits), j) for j, (t, m) in enumerate(zip(targets, more[i], strict=True)))
            want += [(i, j, -s) for s, j in scored[:k] if -s >= least]
        assert list(zip(*(c.tolist() for c in got), strict=True)) == want


def test_numbered_names_are_not_compared_one_pair_at_a_time(monkeypatch):
    rng = random.Random(11)
    targets = names.Names([f"supplier {n:09}" for n in rng.sample(range(50_000), 2000)])
    monkeypatch.setattr(names, "token_set_ratio", lambda a, b: pytest.fail("one pair at a time"))
    for _ in range(20):
        name = f"supplier {rng.randrange(900_000):09}"
        want = sorted((-round(token_set_ratio(name, t), 1), j) for j, t in enumerate(targets.names))[:3]
        assert targets.best(name, 3) == [(j, -s) for s, j in want]


def test_bills_that_share_phones_or_addresses_leave_the_rest_of_the_state_out(spark, monkeypatch):
    asked, best = [], cases.best_names
    monkeypatch.setattr(cases, "best_names", lambda bills, *a, **more: asked.append({r["bill_id"] for r in bills.select("bill_id").collect()}) or best(bills, *a, **more))
    # three of the same phone, address or address above; a name alone reaches 60, with its city 65
    hospitals = [("a", "Mary One", "1", None, "Lynn", "MA"), ("b", "Mary Two", "1", "x.org", "Lynn", "MA"), ("c", "Mary Three", "1", "x.org", "Lynn", "MA"), ("d", "Mary", None, "x.org", "Lynn", "MA"), ("e", "Grace", "2", "", "", "MA"), ("f", "Mary One", "1", "x.org", "Lynn", "NV"), ("d", "Mary", None, "x.org", "Lynn", "MA")]
    bills = [(1, "Mary One", "1", None, None, "Lynn", "MA"), (2, "Mary", None, "1", "x.org", None, "MA"), (3, "Mary", None, None, "y.x.org", "2 Road, Lynn", "MA"), (4, "Grace", "2", "2", None, "", "MA"), (5, "Mary", None, None, None, "Lynn", "MA"), (6, "zzz", "1", None, None, None, "MA")]
    got = cases.bill_matches(
        spark.createDataFrame(bills, "bill_id long, hospital_name string, hospital_phone string, fap_phone string, fap_url string, hospital_address string, state string"),
        spark.createDataFrame(hospitals, "ccn string, name string, phone string, website_domain string, city string, state string"),
    ).collect()
    assert asked == [{1, 2, 3, 4, 6}, {4, 5, 6}]
    assert sorted((r["bill_id"], r["place"], r["ccn"], r["score"]) for r in got) == [
        (1, 1, "a", 95.0), (1, 2, "b", 80.0), (1, 3, "c", 75.0), (2, 1, "c", 120.0), (2, 2, "b", 120.0), (2, 3, "d", 90.0),
        (3, 1, "d", 80.0), (3, 2, "d", 80.0), (3, 3, "c", 80.0), (4, 1, "e", 90.0), (4, 2, "a", 18.5), (4, 3, "c", 16.0),
        (5, 1, "d", 65.0), (5, 2, "d", 65.0), (5, 3, "a", 65.0), (6, 1, "a", 30.0), (6, 2, "c", 30.0), (6, 3, "b", 30.0),
    ]


@pytest.mark.parametrize(("letters", "longest", "most"), [("abcdé", 6, 4), ("0123456789", 9, 1), ("ab", 40, 2)])
def test_walks_through_names_of_the_same_words_equal_all_pairs(monkeypatch, letters, longest, most):
    for name, value in (("GROUP", 10), ("WIDE", 8), ("WALKED", 50), ("KEPT", 500)):
        monkeypatch.setattr(names, name, value)
    rng = random.Random(longest)
    words = ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(80)]
    asked, targets = ([" ".join(rng.sample(["saint", "general", "zeta"], rng.choice([0, 1, 1, 2])) + rng.choices(words, k=rng.randint(0, most))) for _ in range(n)] for n in (150, 260))
    more = [[float(rng.choice([0] * 40 + [5, 30])) for _ in targets] for _ in asked]
    walks, walk = [], names.Names._walk
    monkeypatch.setattr(names.Names, "_walk", lambda self, *a: walks.append(1) or walk(self, *a))
    for k, scale, digits, least in ((1, 1.0, 1, 0.1), (3, 0.6, 1, 0.0), (2, 1.0, 12, 50.0), (300, 0.6, 1, 0.1)):
        for extra in (None, lambda i: more[i]):
            got = names.Names(targets).best_of(asked, k, scale, extra, digits, least)
            want = []
            for i, name in enumerate(asked):
                scored = sorted((-round(scale * token_set_ratio(name, t) + (m if extra else 0.0), digits), j) for j, (t, m) in enumerate(zip(targets, more[i], strict=True)))
                want += [(i, j, -s) for s, j in scored[:k] if -s >= least]
            assert list(zip(*(c.tolist() for c in got), strict=True)) == want
    assert walks


def test_a_walk_bounds_no_pairs(monkeypatch):
    rng = random.Random(3)
    targets = names.Names([f"supplier {n:09}" for n in rng.sample(range(9000), 600)])
    monkeypatch.setattr(names.Names, "bounds", lambda self, asked: pytest.fail("all pairs are bounded"))
    asked = [f"supplier {n:09}" for n in rng.sample(range(90_000), 300)]
    i, j, score = targets.best_of(asked, 3)
    want = [(a, b, -s) for a in range(5) for s, b in sorted((-round(token_set_ratio(asked[a], t), 1), b) for b, t in enumerate(targets.names))[:3]]
    assert list(zip(i.tolist(), j.tolist(), score.tolist(), strict=True))[:15] == want


def test_a_walk_keeps_few_pairs_of_equal_scores(monkeypatch):
    kept, first = [], names._first
    monkeypatch.setattr(names, "KEPT", 2000)
    monkeypatch.setattr(names, "_first", lambda i, *a: kept.append(len(i)) or first(i, *a))
    # no letters but those of the shared word are alike
    asked, targets = [f"generalhospital {'abc'[i % 3]}{'def'[i // 3 % 3]}{'xyz'[i // 9 % 3]}" for i in range(300)], [f"generalhospital {i:03}" for i in range(600)]
    i, j, _ = names.Names(targets).best_of(asked, 2)
    assert i.tolist() == [a for a in range(300) for _ in "12"] and j.tolist() == [0, 1] * 300
    assert max(kept) < 300 * 600 / 10
