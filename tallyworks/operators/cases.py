"""Cases: which hospital a bill is from, who the payee is, and which registry rows are taken in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions import fuzzy
from tallyworks.functions import normalise as n
from tallyworks.operators.linkage import top_candidates
from tallyworks.operators.names import best_names
from tallyworks.store import materialise

# Programmes under whose rules cost-sharing may not be billed, lower case.
COST_SHARING_PROTECTED = ["qmb", "medicaid", "masshealth", "medi-cal", "nj familycare", "medical assistance"]
# Payees that a hospital's own policy doesn't cover by itself.
OUTSIDE_POLICY = ["physician_group", "anesthesia_radiology_pathology", "ambulance", "other"]
PAYEE_RATIO = 85.0


def cost_sharing_protected(programs: Column) -> Column:
    """Whether one of the programmes, in any case, forbids billing cost-sharing."""
    return F.coalesce(F.exists(programs, lambda p: F.lower(p).isin(COST_SHARING_PROTECTED)), F.lit(False))


def payee_routes(bills: DataFrame, listed: DataFrame, key: str = "bill_id", owner: str = "ccn") -> DataFrame:
    """(bill, route, listed): null for the hospital's own bills, covered if the payee is on the hospital's list by its
    whole name, else ship for ambulances and payee_request for the rest.

    ``bills`` has payee_kind and payee_name; ``listed`` is (owner, provider) in the order ``place``. Lists of one
    hospital are short, so each bill meets its own hospital's list alone; the first that matches is named.
    """
    outside = bills.where(F.col("payee_kind").isin(OUTSIDE_POLICY) & (n.payee_name("payee_name") != ""))
    pairs = outside.select(key, owner, n.payee_name("payee_name").alias("__name")).join(listed, owner)
    pairs = pairs.select(key, "provider", "place", fuzzy.ratio_of("__name", n.payee_name("provider")).alias("__score")).where(F.col("__score") >= PAYEE_RATIO)
    named = pairs.groupBy(key).agg(F.min_by("provider", "place").alias("listed"))
    route = F.when(F.col("listed").isNotNull(), "covered").when(F.col("payee_kind") == "ambulance", "ship").otherwise("payee_request")
    return bills.join(named, key, "left").select(key, F.when(F.col("payee_kind").isin(OUTSIDE_POLICY), route).alias("route"), "listed")


# What a bill's phone, policy address (the hospital's own, or one below it) and city add to its name's score.
NAME_SHARE, PHONE, SITE, BELOW_SITE, CITY = 0.6, 30.0, 30.0, 15.0, 5.0


def _beside_names(bills: pd.DataFrame, hospitals: pd.DataFrame) -> Callable[[int], np.ndarray]:
    """What each hospital of a chunk adds to its name's score for a bill."""
    by_phone, by_site, by_city = ({} for _ in range(3))
    for by, column in ((by_phone, "__phone"), (by_site, "website_domain"), (by_city, "__city")):
        for i, value in enumerate(hospitals[column]):
            if value is not None and (value or by is by_city):
                by.setdefault(value, []).append(i)

    phones, sites, addresses = (bills[c].tolist() for c in ("__phones", "__domain", "__address"))

    def of(i: int) -> np.ndarray:
        out = np.zeros(len(hospitals))
        for phone in set(phones[i]):
            if phone in by_phone:
                out[by_phone[phone]] += PHONE
        site = sites[i] or ""
        if site in by_site:
            out[by_site[site]] += SITE
        for below in (site[k + 1 :] for k, ch in enumerate(site) if ch == "."):
            if below in by_site:
                out[by_site[below]] += BELOW_SITE
        if addresses[i]:
            for city, at in by_city.items():
                if city in addresses[i]:
                    out[at] += CITY
        return out

    return of


def bill_matches(bills: DataFrame, hospitals: DataFrame, block: str = "state") -> DataFrame:
    """The three hospitals of a bill's block that fit it best, with place and whether the first is confident.

    The score is 0.6 of the names' token-set ratio, 30 for a phone, 30 for the address of its policy or 15 for one below
    it, and 5 for its city in the bill's address, to one decimal; of equal scores the first by name and ccn is first.
    ``bills``: bill_id, hospital_name, hospital_phone, fap_phone, fap_url, hospital_address and the block;
    ``hospitals``, a registry: ccn, name, phone, website_domain, city and the block. A bill without a hospital's name,
    phone or policy address has no candidates, nor has one that no hospital scores over 0.

    Hospitals that share a phone or an address with a bill are looked at first. Any other has at most 65 for its name
    and city, so only bills whose third of those scores no more than that are compared with all hospitals of the block.
    """
    told = bills.where(F.coalesce(F.nullif("hospital_name", F.lit("")), F.nullif("hospital_phone", F.lit("")), F.nullif("fap_url", F.lit(""))).isNotNull())
    read = told.select(
        "bill_id", block, n.bill_name(F.coalesce("hospital_name", F.lit(""))).alias("__bill"), n.host("fap_url").alias("__domain"), F.lower("hospital_address").alias("__address"),
        F.array(n.digits(F.coalesce("hospital_phone", F.lit(""))), n.digits(F.coalesce("fap_phone", F.lit("")))).alias("__phones"),
    )
    registry = hospitals.select("ccn", block, "name", "website_domain", n.digits("phone").alias("__phone"), F.lower("city").alias("__city"))
    # told apart by a number, should a ccn stand in it twice
    registry = materialise(registry.withColumn("__row", F.monotonically_increasing_id()))

    def best(bills: DataFrame, hospitals: DataFrame, by: list[str], several: bool) -> DataFrame:
        return best_names(bills, "bill_id", F.col("__bill"), hospitals, "ccn", n.bill_name("name"), by, ["name", "ccn", "__row"], k=3, scale=NAME_SHARE, extra=_beside_names, several=several)

    labels = F.split(F.coalesce("__domain", F.lit("")), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tie = lambda phones, sites: F.filter(F.array_distinct(F.concat(F.transform(phones, lambda p: F.concat(F.lit("p"), p)), F.transform(sites, lambda s: F.concat(F.lit("s"), s)))), lambda t: F.length(t) > 1)
    ties = materialise(best(read.withColumn("__tie", F.explode(tie(F.col("__phones"), above))), registry.withColumn("__tie", F.explode(tie(F.array("__phone"), F.array("website_domain")))), [block, "__tie"], True))
    done = ties.where((F.col("place") == 3) & (F.col("score") > 100 * NAME_SHARE + CITY)).select("bill_id")
    rest = best(read.join(done, "bill_id", "left_anti"), registry, [block], False)
    return top_candidates(ties.join(done, "bill_id", "left_semi").unionByName(rest), "bill_id", "score", F.col("place"))


# Registry types and owners that are taken in.
ELIGIBLE_TYPES = ["Acute Care Hospitals", "Critical Access Hospitals"]
NONPROFIT, DISTRICT, DISTRICT_STATES = "Voluntary non-profit", "Government - Hospital District", ["WA"]


def eligible(kind: Column, owner: Column, state: Column) -> Column:
    """A nonprofit acute-care or critical-access hospital, or a public hospital district where the law covers districts."""
    district = F.upper(state).isin(DISTRICT_STATES) & owner.startswith(DISTRICT)
    return F.coalesce(kind.isin(ELIGIBLE_TYPES) & (owner.startswith(NONPROFIT) | F.coalesce(district, F.lit(False))), F.lit(False))


def registry_rows(raw: DataFrame) -> DataFrame:
    """The registry's columns from published rows that are ``eligible``: trimmed, states upper case, phones in one form."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    kept = raw.where(eligible(F.col("hospital_type"), F.coalesce("hospital_ownership", F.lit("")), F.col("state")))
    return kept.select(
        F.col("facility_id").alias("ccn"), text("facility_name").alias("name"), text("address").alias("address"), text("citytown").alias("city"),
        F.upper("state").alias("state"), F.substring(text("zip_code"), 1, 10).alias("zip"), n.phone("telephone_number").alias("phone"),
        "hospital_type", F.col("hospital_ownership").alias("ownership"),
    )


def enrollment_of(rows: DataFrame) -> DataFrame:
    """One enrollment row for each ccn: that of the main location, else the first in file order ``line``."""
    main = F.upper(F.trim(F.coalesce("location_type", F.lit("")))).startswith("MAIN")
    place = F.row_number().over(Window.partitionBy("ccn").orderBy(main.desc(), "line"))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def attributed_facility(facilities: DataFrame, hospitals: DataFrame, least: float = 80.0) -> DataFrame:
    """(ccn, ein, facility, score): which facility of a filer's return a hospital is; others are left out.

    Only facilities in the hospital's state count. A single one is taken whatever its name (score 100); else the one
    of the best score, the first in ``line`` of equals: the token-set ratio of the names, at least ``least``, with 10
    for an equal ZIP and 5 for an equal city. ``facilities``: ein, line, facility, name, state, zip, city;
    ``hospitals``: ccn, ein, name, state, zip, city.
    """
    f = facilities.withColumn("state", F.upper(F.coalesce("state", F.lit(""))))
    count = f.groupBy("ein", "state").agg(F.count("*").alias("__n"))
    f = f.join(count, ["ein", "state"]).select("ein", "state", "line", "facility", "__n", F.col("name").alias("__name"), n.zip5("zip").alias("__zip"), F.upper("city").alias("__city"))
    pairs = hospitals.withColumn("state", F.upper(F.coalesce("state", F.lit("")))).join(f, ["ein", "state"])
    pairs = pairs.withColumn("__ratio", fuzzy.token_set_ratio_of(n.return_name("name"), n.return_name("__name")))
    place = F.when((n.zip5("zip") == F.col("__zip")) & (F.col("__zip") != ""), 10.0).otherwise(0.0) + F.when((F.upper("city") == F.col("__city")) & (F.col("__city") != ""), 5.0).otherwise(0.0)
    score = F.when(F.col("__n") == 1, 100.0).when(F.col("__ratio") >= least, F.col("__ratio") + place)
    scored = pairs.withColumn("score", score).where("score is not null")
    best = scored.groupBy("ccn", "ein").agg(F.max_by(F.struct("facility", "score"), F.struct(F.col("score"), -F.col("line"))).alias("b"))
    return best.select("ccn", "ein", "b.facility", "b.score")
