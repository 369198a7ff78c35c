"""Readers of landed files. Cells are read as text and cast with rules that turn bad cells into nulls, never errors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions import normalise as n

#: Parts in which a member of an archive is handed on, so that no cell grows with the member.
PART_BYTES = 16 << 20
# Forms of the object and batch ids of an e-file index.
OBJECT_ID, BATCH_ID = r"^[0-9]{18}$", r"^[0-9]{4}_TEOS_XML_[0-9]{2}[A-Z]$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_text(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A CSV with a header, all columns as text, a byte-order mark taken off the first name."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=False)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def csv_of_any_charset(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``csv_text`` of files in UTF-8, with or without a byte-order mark, or in Windows-1252, told file by file.

    A file is UTF-8 if all its lines are valid UTF-8, which its bytes say; lines are probed where they lie. Columns that
    a file lacks are null.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    told = lines.groupBy("file").agg(F.bool_and("valid").alias("utf8")).collect()  # one row a file
    utf8, other = sorted(r["file"] for r in told if r["utf8"]), sorted(r["file"] for r in told if not r["utf8"])
    frames = [csv_text(spark, utf8, sep)] if utf8 or not other else []
    if other:
        # the engine reads Latin-1, which differs from Windows-1252 in its control characters alone
        pairs = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
        odd = "".join(k for k, v in pairs.items() if v)
        plain = str.maketrans({k: v for k, v in pairs.items() if v})
        raw = csv_text(spark, other, sep, "ISO-8859-1")
        frames.append(raw.select(*[F.translate(F.col(f"`{c}`"), odd, odd.translate(plain)).alias(c.translate(plain)) for c in raw.columns]))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)


def needed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns; an error that names those that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def cost_reports(raw: DataFrame) -> DataFrame:
    """Rows with a provider number and both period dates, money in whole dollars."""
    df = needed(raw, ["rpt_rec_num", "Provider CCN", "Fiscal Year Begin Date", "Fiscal Year End Date", "Cost of Charity Care", "Total Bad Debt Expense", "Total Costs"])
    out = df.select(
        "rpt_rec_num", n.ccn("Provider CCN").alias("ccn"), n.either_date("Fiscal Year Begin Date").alias("fy_begin"),
        n.either_date("Fiscal Year End Date").alias("fy_end"), n.whole_dollars("Cost of Charity Care").alias("charity_care_cost"),
        n.whole_dollars("Total Bad Debt Expense").alias("bad_debt"), n.whole_dollars("Total Costs").alias("total_costs"),
    )
    return out.where("ccn <> '' and fy_begin is not null and fy_end is not null")


def inpatient_counts(raw: DataFrame) -> DataFrame:
    """(ccn, benes, discharges, dual_benes), the last row of a provider number."""
    df = needed(raw, ["Rndrng_Prvdr_CCN", "Tot_Benes", "Tot_Dschrgs", "Bene_Dual_Cnt"]).withColumn("__at", F.monotonically_increasing_id())
    row = F.struct(n.count_cell("Tot_Benes").alias("benes"), n.count_cell("Tot_Dschrgs").alias("discharges"), n.count_cell("Bene_Dual_Cnt").alias("dual_benes"))
    return df.groupBy(n.ccn("Rndrng_Prvdr_CCN").alias("ccn")).agg(F.max_by(row, "__at").alias("r")).select("ccn", "r.*")


def service_area(raw: DataFrame) -> DataFrame:
    """(ccn, zip, cases) with null for suppressed counts."""
    df = needed(raw, ["MEDICARE_PROV_NUM", "ZIP_CD_OF_RESIDENCE", "TOTAL_CASES"])
    return df.select(n.ccn("MEDICARE_PROV_NUM").alias("ccn"), n.zip_of_counts("ZIP_CD_OF_RESIDENCE").alias("zip"), n.count_cell("TOTAL_CASES").alias("cases"))


def array_table(spark: SparkSession, path: str) -> DataFrame:
    """Long form (file, row, name, value) of JSON files that are arrays of arrays with a header row."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    rows = text.select("file", F.from_json("value", "array<array<string>>").alias("a"))
    cells = rows.select("file", F.col("a")[0].alias("names"), F.posexplode(F.slice("a", 2, F.size("a"))).alias("row", "cells"))
    return cells.select("file", "row", F.explode(F.arrays_zip("names", "cells")).alias("c")).select("file", "row", F.col("c.names").alias("name"), F.col("c.cells").alias("value"))


def census_sums(cells: DataFrame, variables: list[str], place: str) -> DataFrame:
    """(place, total): the sum of the variables, a cell that is negative, missing or no number counting as zero."""
    v = F.col("value").try_cast("double")
    safe = F.when((v >= 0) & ~F.isnan(v) & (v < 9e18), v.cast("bigint")).otherwise(0)
    return cells.groupBy("file", "row").agg(
        F.max(F.when(F.col("name") == place, F.col("value"))).alias("place"), F.sum(F.when(F.col("name").isin(variables), safe).otherwise(0)).alias("total")
    ).select("place", "total")


def dataset_versions(catalogue: DataFrame, family: str) -> DataFrame:
    """All versions of a dataset family in a catalogue, newest first: (title, start, end, modified, url, vintage).

    ``catalogue`` has an array ``dataset``; a family is a title before " : ", compared whole and without case.
    """
    d = catalogue.select(F.explode("dataset").alias("d")).select("d.*")
    d = d.where(F.lower(F.trim(F.substring_index("title", " : ", 1))) == family.lower())
    csv = F.filter("distribution", lambda x: x["mediaType"] == "text/csv")
    period = F.get("temporal", F.lit(0))
    out = d.select("title", period["startDate"].alias("start"), period["endDate"].alias("end"), "modified", F.get(csv, F.lit(0))["downloadURL"].alias("url"))
    return out.withColumn("vintage", n.vintage("start", "end", "modified")).orderBy(F.desc_nulls_last("end"), F.desc_nulls_last("modified"))


def newest_returns(index: DataFrame, wanted: DataFrame, return_type: str = "990") -> DataFrame:
    """Each wanted EIN's newest return in an index: by period, submission date and object id as text."""
    index = index.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("RETURN_TYPE", "OBJECT_ID", "XML_BATCH_ID")})
    valid = index.where((F.col("RETURN_TYPE") == return_type) & F.col("OBJECT_ID").rlike(OBJECT_ID) & F.col("XML_BATCH_ID").rlike(BATCH_ID))
    valid = valid.withColumn("ein", n.ein_of_return("EIN"))
    kept = valid.join(wanted.select("ein").distinct(), "ein", "left_semi")
    rest = [c for c in kept.columns if c != "ein"]
    newest = kept.groupBy("ein").agg(F.max_by(F.struct(*rest), F.struct("TAX_PERIOD", "SUB_DATE", "OBJECT_ID")).alias("r"))
    return newest.select("ein", "r.*")


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, member, part, content) of the members of ZIP files whose names match, each in parts of PART_BYTES.

    A compression that can't be read is an error. Members of one part, as single documents are, need no joining.
    """
    import re

    wanted = re.compile(pattern)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, body in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for info in z.infolist():
                        if not wanted.fullmatch(info.filename):
                            continue
                        with z.open(info) as member:
                            part = 0
                            while (content := member.read(PART_BYTES)) or not part:
                                yield pd.DataFrame({"archive": [archive], "member": [info.filename], "part": [part], "content": [content]})
                                part += 1

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, part int, content binary")


def filings(xml: DataFrame, content: str = "content") -> DataFrame:
    """Header and schedule fields of e-filed returns in a column of XML text; absent flags are null, unset ones false."""
    text = F.regexp_replace(F.col(content).cast("string"), r'\sxmlns(:\w+)?="[^"]*"', "")
    x = xml.withColumn("__x", text)
    at = lambda path: F.nullif(F.xpath_string("__x", F.lit(path)), F.lit(""))
    flag = lambda path: F.when(F.xpath_boolean("__x", F.lit(path)), F.lower(at(path)).isin("x", "true", "1"))
    part = "/Return/ReturnData/IRS990ScheduleH"
    return x.select(
        *[c for c in xml.columns if c != content],
        n.ein_of_return(at("/Return/ReturnHeader/Filer/EIN")).alias("ein"), at("/Return/ReturnHeader/TaxYr").cast("int").alias("tax_year"),
        at("/Return/ReturnHeader/TaxPeriodEndDt").try_cast("date").alias("period_end"),
        F.round(at(f"{part}/FinancialAssistanceAtCostTyp/TotalExpensePct").try_cast("double") * 100, 6).alias("charity_pct"),
        F.xpath("__x", F.lit(f"{part}/HospitalFacilitiesGrp/BusinessName/BusinessNameLine1Txt/text()")).alias("facilities"),
        flag(f"{part}/HospitalFcltyPoliciesPrctcGrp/FAPAssetsInd").alias("asset_test"),
    )


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """An event log of JSON lines; a bad line is an error if ``strict``, else a row of nulls."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "PERMISSIVE")
