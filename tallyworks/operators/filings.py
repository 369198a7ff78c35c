"""Hospital schedules of tax returns: parsed with a schema, and each facility given the answers that hold for it.

A return lists facilities (section A) and groups of answers (section B), and says in several ways which belong together.
``attributed`` tries the ways in order, for all returns at once, by windows within the return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions import normalise as n
from tallyworks.operators.choices import collection_flags

# Boxes of a group of answers, and what a ticked one holds.
BOXES = (
    "AssetLevelCriteriaInd AssetLevelInd ReportingToCreditAgencyInd OtherActionsTakenInd EngagedLegalJudicialProcessInd EngagedSellingDebtInd LawsuitInd "
    "LiensOnResidencesInd BodyAttachmentsInd PermitReportToCreditAgencyInd PermitSellingDebtInd PermitLegalJudicialProcessInd PermitLawsuitInd "
    "PermitLienOnResidenceInd PermitBodyAttachmentsInd PermitOtherActionsInd PermitNoActionsInd"
).split()
TICKED = ["x", "true", "1"]
_NAME = "STRUCT<BusinessNameLine1Txt: STRING, BusinessNameLine1: STRING>"
#: What is read of a return; elements that aren't named here are skipped.
SCHEMA = (
    "_returnVersion STRING, ReturnHeader STRUCT<TaxPeriodEndDt: STRING, TaxYr: STRING, Filer: STRUCT<EIN: STRING, BusinessName: " + _NAME + ">>, "
    "ReturnData STRUCT<IRS990ScheduleH: STRUCT<FinancialAssistanceAtCostTyp: STRUCT<TotalExpensePct: STRING>, CharityCareAtCostGrp: STRUCT<TotalExpensePct: STRING>, "
    "HospitalFacilitiesGrp: ARRAY<STRUCT<FacilityNum: STRING, BusinessName: " + _NAME + ", USAddress: STRUCT<CityNm: STRING, StateAbbreviationCd: STRING, ZIPCd: STRING>, "
    "StateLicenseNum: STRING, FacilityReportingGroupCd: STRING>>, "
    "HospitalFcltyPoliciesPrctcGrp: ARRAY<STRUCT<FacilityNum: STRING, HospitalFacilityName: " + _NAME + ", FPGFamilyIncmLmtFreeCarePct: STRING, FPGFamilyIncmLmtDscntCarePct: STRING, "
    + ", ".join(f"{b}: STRING" for b in BOXES) + ">>>>"
)
ANSWERS = ["free_care_fpl_pct", "discount_care_fpl_pct", "asset_test", "credit_reporting", "sells_debt", "legal_action", "lawsuits", "liens", "other_actions", "permitted_actions"]


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _name(c: Column) -> Column:
    return F.coalesce(_filled(c["BusinessNameLine1Txt"]), _filled(c["BusinessNameLine1"]))


def parsed(xml: DataFrame, filing: str, content: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, facilities and groups of answers of e-filed returns in a column of XML text or bytes.

    Headers: filing, ein, tax_year (of the header, else the year in which the period began), period_end, tax_period,
    filer_name, return_version, charity_pct (a fraction there, percent here). Facilities: filing, place (from 0, in the
    return's order), line, name, city, state, zip5, license, group. Answers: filing, place, line, name and ANSWERS, of
    which those that the return's schema didn't ask are null. Cells that can't be read are null, returns without the
    schedule have a header alone, and a text that is no XML has a header of nulls.
    """
    rows = xml.select(F.col(filing).alias("filing"), F.from_xml(F.col(content).cast("string"), SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("x"))
    head, part = F.col("x.ReturnHeader"), F.col("x.ReturnData.IRS990ScheduleH")
    end = F.substring(_filled(head["TaxPeriodEndDt"]), 1, 10).try_cast("date")
    began = F.year(end) - F.when(F.month(end) == 12, 0).otherwise(1)
    share = F.coalesce(_filled(part["FinancialAssistanceAtCostTyp"]["TotalExpensePct"]), _filled(part["CharityCareAtCostGrp"]["TotalExpensePct"]))
    version = F.col("x._returnVersion")
    headers = rows.select(
        "filing", n.ein(head["Filer"]["EIN"]).alias("ein"), F.coalesce(_filled(head["TaxYr"]).try_cast("int"), began).alias("tax_year"), end.alias("period_end"),
        F.date_format(end, "yyyyMM").alias("tax_period"), _name(head["Filer"]["BusinessName"]).alias("filer_name"), F.coalesce(version, F.lit("")).alias("return_version"),
        F.round(share.try_cast("double") * 100, 6).alias("charity_pct"),
    )
    each = rows.select("filing", version.alias("version"), F.posexplode(part["HospitalFacilitiesGrp"]).alias("place", "g"))
    g = F.col("g")
    facilities = each.select(
        "filing", "place", _filled(g["FacilityNum"]).try_cast("int").alias("line"), _name(g["BusinessName"]).alias("name"), _filled(g["USAddress"]["CityNm"]).alias("city"),
        _filled(g["USAddress"]["StateAbbreviationCd"]).alias("state"), F.substring(_filled(g["USAddress"]["ZIPCd"]), 1, 5).alias("zip5"), _filled(g["StateLicenseNum"]).alias("license"),
        F.upper(_filled(g["FacilityReportingGroupCd"])).alias("group"),
    )
    each = rows.select("filing", version.alias("version"), F.posexplode(part["HospitalFcltyPoliciesPrctcGrp"]).alias("place", "g"))
    ticked = lambda box: F.coalesce(F.lower(F.trim(g[box])).isin(TICKED), F.lit(False))
    year = F.coalesce(F.nullif(F.regexp_extract("version", r"^(\d{4})", 1), F.lit("")).cast("int"), F.lit(9999))
    flags = collection_flags(year, F.array_compact(F.array(*[F.when(ticked(b), F.lit(b)) for b in BOXES])))
    number = lambda c: _filled(g[c]).try_cast("double")
    answers = each.withColumn("flags", flags).select(
        "filing", "place", _filled(g["FacilityNum"]).try_cast("int").alias("line"), _name(g["HospitalFacilityName"]).alias("name"),
        number("FPGFamilyIncmLmtFreeCarePct").alias("free_care_fpl_pct"), number("FPGFamilyIncmLmtDscntCarePct").alias("discount_care_fpl_pct"),
        (ticked("AssetLevelCriteriaInd") | ticked("AssetLevelInd")).alias("asset_test"), ticked("ReportingToCreditAgencyInd").alias("credit_reporting"),
        "flags.sells_debt", "flags.legal_action", "flags.lawsuits", "flags.liens", ticked("OtherActionsTakenInd").alias("other_actions"), F.col("flags.permitted").alias("permitted_actions"),
    )
    return headers, facilities, answers


def group_code(name: Column) -> Column:
    """The reporting group that a name stands for: its code alone, or at the end of a name that calls it a group."""
    alone, last = F.regexp_extract(name, r"^\s*([A-Za-z0-9])\s*$", 1), F.regexp_extract(name, r"(?i)\bgroup\s*-?\s*([A-Za-z0-9])\s*$", 1)
    return F.upper(F.coalesce(F.nullif(alone, F.lit("")), F.nullif(last, F.lit(""))))


def attributed(facilities: DataFrame, answers: DataFrame, told: list[str] = ANSWERS) -> DataFrame:
    """Facilities with the answers that hold for them, and ``rule``, why; facilities without answers have nulls.

    The first rule that applies to a return decides: a lone group of answers holds for facilities that are all in one
    reporting group (``lone``); answers named by a group's code or a facility's name hold there, and what is left takes
    the answers of its own line if all lines differ (``named``); answers whose lines all differ go by line, and those
    whose line no facility has stand alone (``line``); equal answers hold for all (``equal``); as many answers as
    facilities go in order (``order``); else the first answers stand alone, without a line (``first``).
    ``told`` are the columns of the answers. Returns filing, place, line, name, city, state, zip5, license, rule and told.
    """
    c = F.col
    place, code = ["city", "state", "zip5", "license"], group_code(c("name"))
    f = facilities.select("filing", F.lit(True).alias("__f"), "place", "line", "name", *place, c("group").alias("__group"), n.return_name("name").alias("__own"))
    a = answers.where("filing is not null").select(
        "filing", F.lit(False).alias("__f"), "place", "line", "name", code.alias("__group"), F.when(code.isNull() & (c("name") != ""), n.return_name("name")).alias("__own"),
        F.struct(c("name").alias("as_named"), F.struct(*told).alias("all")).alias("__a"), F.to_json(F.struct(*told)).alias("__json"),
    )
    # the first window lays both together by return, all others lie within it: one shuffle in all, or none where they lie so
    rows = f.unionByName(a, allowMissingColumns=True)
    whole, own = Window.partitionBy("filing"), Window.partitionBy("filing", "__f")
    rows = rows.withColumns({"__n": F.count(F.when(~c("__f"), 1)).over(whole), "__m": F.count(F.when(c("__f"), 1)).over(whole)})
    rows = rows.withColumns({"__rank": F.row_number().over(own.orderBy("place")), "__at": F.when(~c("__f"), c("place"))})
    by = lambda key: F.when(c("__f") & c(key).isNotNull(), F.min_by("__a", "__at").over(Window.partitionBy("filing", key)))
    rows = rows.withColumn("__chosen", by("__group")).withColumn("__chosen", F.coalesce("__chosen", by("__own")))
    line = Window.partitionBy("filing", "line")
    rows = rows.withColumns({"__byline": by("line"), "__alike": F.count(F.when(~c("__f"), c("line"))).over(line), "__has_f": F.max("__f").over(line)})
    rows = rows.withColumn("__byrank", by("__rank"))
    group = F.when(c("__f"), c("__group"))
    rows = rows.withColumns({
        "__lines": F.min(F.when(~c("__f"), c("line").isNotNull() & (c("__alike") == 1))).over(whole),
        "__equal": F.min("__json").over(whole) == F.max("__json").over(whole), "__first": F.min_by("__a", "__at").over(whole),
        "__any": F.max(c("__chosen").isNotNull()).over(whole), "__grouped": F.count(group).over(whole), "__one": F.min(group).over(whole) == F.max(group).over(whole),
    })
    rule = (
        F.when(c("__n") == 0, None).when(c("__m") == 0, F.when(c("__lines"), "line").otherwise("first")).when((c("__n") == 1) & (c("__grouped") == c("__m")) & c("__one"), "lone").when(c("__any"), "named")
        .when(c("__lines"), "line").when(c("__equal"), "equal").when(c("__n") == c("__m"), "order").otherwise("first")
    )
    given = (
        F.when(c("rule").isin("lone", "equal"), c("__first")).when(c("rule") == "named", F.coalesce("__chosen", F.when(c("__lines"), c("__byline"))))
        .when(c("rule") == "line", c("__byline")).when(c("rule") == "order", c("__byrank"))
    )
    rows = rows.withColumn("rule", rule).withColumn("__given", F.when(c("__f"), given).otherwise(c("__a")))
    # answers that stand alone: of lines that no facility has, and the first of returns that nothing ties together
    alone = ((c("rule") == "line") & ~c("__has_f")) | ((c("rule") == "first") & (c("__rank") == 1))
    kept = rows.where(F.when(c("__f"), c("rule").isNull() | (c("rule") != "first")).otherwise(alone))
    return kept.select(
        "filing", F.when(c("__f"), c("place")).cast(facilities.schema["place"].dataType).alias("place"), F.when(c("__f") | (c("rule") != "first"), c("line")).alias("line"),
        F.when(c("__f"), F.coalesce(_filled(c("name")), c("__given")["as_named"])).otherwise(c("name")).alias("name"), *place, "rule", *[c("__given")["all"][t].alias(t) for t in told],
    )
