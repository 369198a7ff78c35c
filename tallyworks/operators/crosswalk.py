"""Which tax number and which provider identifier a registry hospital has, by the best method that finds one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import normalise as n
from tallyworks.operators.names import best_names
from tallyworks.store import materialise

# Methods in order of precedence and how far each is trusted; the score that a similar name needs.
CONFIDENCE = {"manual": 1.0, "cbi": 1.0, "enrollments": 0.9, "name_zip": 0.8, "fuzzy": 0.7}
FUZZY = 90.0
SOURCE, ENROLLMENTS = "Community Benefit Insight", "Hospital Enrollments"
NAME_CHARS, VINTAGE_CHARS = 200, 100


def enrollment_of(hospitals: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``rows`` for each ccn of ``hospitals`` that has any: its own, else those of its units, ccn with A to Z.

    Of several the first of the main location is taken, else the first; units go by their letter, then all by
    ``line``, the place in the file. ``rows``: ccn, line, location_type and any other columns; hospitals without a
    row are left out.
    """
    main = F.upper(F.coalesce("location_type", F.lit(""))).startswith("MAIN")
    number = n.ccn(F.coalesce("ccn", F.lit("")))
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "ccn"]).alias("__row")
    unit = number.rlike("^.+[A-Z]$")
    own = rows.select(number.alias("ccn"), whole, F.struct(F.lit(0), ~main, F.lit(""), "line").alias("__order"))
    units = rows.where(unit).select(F.regexp_replace(number, "[A-Z]$", "").alias("ccn"), whole, F.struct(F.lit(1), ~main, F.right(number, F.lit(1)), "line").alias("__order"))
    first = own.unionByName(units).join(hospitals.select("ccn").distinct(), "ccn", "left_semi").groupBy("ccn").agg(F.min_by("__row", "__order").alias("r"))
    return first.select("ccn", "r.*")


def _usable(listed: DataFrame) -> DataFrame:
    """Rows of the list with a tax number and of their file's own state, with names and ZIPs in the form they meet in."""
    own = F.upper("file_state")
    date = F.try_to_date(F.trim(F.coalesce("updated", F.lit(""))), "MMMM d, yyyy").cast("string")
    stamp = F.nullif(F.trim(F.coalesce("updated", F.lit(""))), F.lit(""))
    vintage = F.coalesce(F.concat(F.lit(f"{SOURCE}, updated "), F.coalesce(date, stamp)), F.lit(SOURCE))
    kept = listed.where(n.ein("ein").isNotNull() & (F.upper(F.coalesce(F.nullif("state", F.lit("")), "file_state")) == own))
    return kept.select(
        own.alias("state"), "line", n.ccn(F.coalesce("ccn", F.lit(""))).alias("number"), n.ein("ein").alias("ein"), F.coalesce("name", F.lit("")).alias("as_listed"),
        F.nullif(F.substring(F.trim("name"), 1, NAME_CHARS), F.lit("")).alias("matched_name"), fit(vintage, VINTAGE_CHARS).alias("ein_vintage"),
        n.crosswalk_name("name").alias("plain"), n.zip5("zip").alias("zip5"), F.lower(F.trim(F.coalesce("city", F.lit("")))).alias("town"),
    )


def fit(text: Column, most: int) -> Column:
    """A text cut to what its column holds, without blanks, commas and hyphens at a cut end."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), "[ ,-]+$", ""))


def crosswalk(hospitals: DataFrame, listed: DataFrame, enrollments: DataFrame, stored: DataFrame, enrollments_vintage: str = "") -> DataFrame:
    """One row a hospital: its identifiers, how the tax number was found, and for those without one the nearest name.

    Methods in order: ``manual`` (a stored one set by hand stays), ``cbi`` (a row of the list names its ccn, the first
    in the file), ``enrollments`` (a sibling with the same associate id that the list names: of this state's run the last
    by name, else the last stored one of another state), ``name_zip`` (equal plain name and ZIP), ``fuzzy`` (the most
    similar name in the same ZIP and city, from FUZZY up). Blank names and ZIPs match nothing. The rest have null ein,
    and ``best_name``, ``best_ein`` and ``best_score`` of the state's most similar name, the first of equals.

    ``hospitals``: ccn, name, city, state, zip. ``listed``: line, ccn, name, city, state, zip, ein, updated, and
    file_state, the state that the file is for. ``enrollments``: line, ccn, npi, associate_id, nonprofit,
    location_type. ``stored``: ccn, ein, associate_id, match_method, matched_name, ein_vintage of the last run.
    Returns ccn, state, npi, associate_id, nonprofit_flag, npi_vintage, ein, match_method, match_confidence,
    matched_name, ein_vintage, best_name, best_ein, best_score.
    """
    c = F.col
    blank = lambda x: F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit(""))
    rows = materialise(_usable(listed))
    h = hospitals.select("ccn", c("name").alias("hospital"), F.upper("state").alias("state"), n.crosswalk_name("name").alias("plain"), n.zip5("zip").alias("zip5"), F.lower(F.trim(F.coalesce("city", F.lit("")))).alias("town"))
    e = enrollment_of(hospitals, enrollments).select(
        "ccn", F.lit(True).alias("enrolled"), blank("npi").alias("npi"), blank("associate_id").alias("its"), F.nullif(F.substring(F.trim("nonprofit"), 1, 1), F.lit("")).alias("nonprofit_flag"),
        fit(F.lit(f"{ENROLLMENTS}, {enrollments_vintage}"), VINTAGE_CHARS).alias("npi_vintage"),
    )
    was = stored.select("ccn", blank("ein").alias("old_ein"), blank("associate_id").alias("old_id"), c("match_method").alias("old_method"), c("matched_name").alias("old_name"), c("ein_vintage").alias("old_vintage"))
    found = F.struct("ein", "matched_name", "ein_vintage")
    named = rows.where("number <> ''").groupBy("state", c("number").alias("ccn")).agg(F.min_by(found, "line").alias("cbi"))
    whole = h.join(e, "ccn", "left").join(was, "ccn", "left").join(named, ["state", "ccn"], "left")
    manual = F.when((c("old_method") == "manual") & c("old_ein").isNotNull(), F.struct(c("old_ein").alias("ein"), c("old_name").alias("matched_name"), c("old_vintage").alias("ein_vintage")))
    whole = materialise(whole.withColumns({"manual": manual, "associate_id": F.when(c("enrolled"), c("its")).otherwise(c("old_id"))}))

    # second pass: what siblings inherit
    fresh = whole.where("manual is null and cbi is not null and associate_id is not null").groupBy("state", "associate_id").agg(F.max_by("cbi", F.struct("hospital", "ccn")).alias("fresh"))
    theirs = whole.where("old_method = 'cbi' and old_ein is not null and old_id is not null").select(c("old_id").alias("associate_id"), c("state").alias("other"), F.struct("ccn", "old_ein", "old_name", "old_vintage").alias("was"))
    theirs = theirs.groupBy("associate_id", "other").agg(F.max("was").alias("was"))
    open_ids = whole.where("manual is null and cbi is null and associate_id is not null").select("state", "associate_id").distinct()
    old = open_ids.join(theirs, "associate_id").where("other <> state").groupBy("state", "associate_id").agg(F.max("was").alias("was"))
    old = old.select("state", "associate_id", F.struct(c("was.old_ein").alias("ein"), c("was.old_name").alias("matched_name"), c("was.old_vintage").alias("ein_vintage")).alias("old"))
    by_name = rows.where("zip5 <> '' and plain <> ''").groupBy("state", "zip5", "plain").agg(F.min_by(found, "line").alias("name_zip"))
    whole = whole.join(fresh, ["state", "associate_id"], "left").join(old, ["state", "associate_id"], "left").join(by_name, ["state", "zip5", "plain"], "left")
    whole = materialise(whole.withColumn("sibling", F.coalesce("fresh", "old")))

    pending = whole.where("coalesce(manual, cbi, sibling, name_zip) is null")
    near = best_names(pending.where("zip5 <> ''"), "ccn", c("plain"), rows, "line", c("plain"), ["state", "zip5", "town"], ["line"], least=FUZZY)
    near = near.join(hospitals.select("ccn", F.upper("state").alias("state")), "ccn").join(rows, ["state", "line"]).select("ccn", found.alias("fuzzy"))
    whole = materialise(whole.join(near, "ccn", "left"))
    nowhere = whole.where("coalesce(manual, cbi, sibling, name_zip, fuzzy) is null and plain <> ''")
    anywhere = best_names(nowhere, "ccn", c("plain"), rows.where("plain <> ''"), "line", c("plain"), ["state"], ["line"], least=0.0)
    anywhere = anywhere.join(hospitals.select("ccn", F.upper("state").alias("state")), "ccn").join(rows, ["state", "line"]).select("ccn", c("as_listed").alias("best_name"), c("ein").alias("best_ein"), c("score").alias("best_score"))
    levels = {"manual": "manual", "cbi": "cbi", "enrollments": "sibling", "name_zip": "name_zip", "fuzzy": "fuzzy"}
    method = F.coalesce(*[F.when(c(at).isNotNull(), F.lit(m)) for m, at in levels.items()])
    trust = F.coalesce(*[F.when(c(at).isNotNull(), F.lit(CONFIDENCE[m])) for m, at in levels.items()])
    got = F.coalesce(*levels.values())
    return whole.join(anywhere, "ccn", "left").select(
        "ccn", "state", "npi", "associate_id", "nonprofit_flag", "npi_vintage", got["ein"].alias("ein"), method.alias("match_method"), trust.alias("match_confidence"),
        got["matched_name"].alias("matched_name"), got["ein_vintage"].alias("ein_vintage"), "best_name", "best_ein",
        F.when(method.isNull(), F.coalesce("best_score", F.lit(0.0))).alias("best_score"),
    )
