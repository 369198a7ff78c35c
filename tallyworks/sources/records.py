"""Readers of JSON records and the summary file: crosswalk rows, drafts, skip lists and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions import normalise as n
from tallyworks.sources.readers import csv_text, needed

#: Fixed value: what begins the code of a ZIP area in the summary file.
ZIP_AREA = "860Z200US"


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): whole JSON files under a path, none where the path doesn't exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        return spark.createDataFrame([], "file string, value string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def crosswalk_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, row) of files that are a list of objects, or an object whose first list has them; row maps names to texts.

    Parts of the list that are no objects are left out; a file without a list has no rows.
    """
    files = json_files(spark, path)
    of_object = F.filter(F.map_values(F.from_json("value", "map<string,string>")), lambda v: F.startswith(F.trim(v), F.lit("[")))
    listed = F.when(F.startswith(F.trim("value"), F.lit("[")), F.col("value")).otherwise(F.get(of_object, F.lit(0)))
    parts = files.select("file", F.explode(F.from_json(listed, "array<string>")).alias("part"))
    return parts.where(F.startswith(F.trim("part"), F.lit("{"))).select("file", F.from_json("part", "map<string,string>").alias("row"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    files = json_files(spark, path)
    checked = F.when(F.startswith(F.trim("value"), F.lit("[")), F.col("value")).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": expected a JSON list"))))
    parts = files.select("file", F.posexplode(F.from_json(checked, "array<string>")).alias("place", "part")).where(F.startswith(F.trim("part"), F.lit("{")))
    return parts.select("file", "place", F.from_json("part", "map<string,string>").alias("row"))


def skip_list(spark: SparkSession, path: str) -> DataFrame:
    """(ccn, state, name, reason, urls_seen, last_tried): a missing file is an empty list, one that is no list an error.

    Rows without a ccn or a reason are left out; of several with one ccn the last counts.
    """
    rows = _listed(spark, path).where("row['ccn'] <> '' and row['reason'] <> ''")
    last = rows.groupBy(F.col("row")["ccn"].alias("ccn")).agg(F.max_by("row", F.struct("file", "place")).alias("r"))
    blank = lambda k: F.coalesce(F.col("r")[k], F.lit(""))
    urls = F.coalesce(F.from_json(F.col("r")["urls_seen"], "array<string>"), F.array().cast("array<string>"))
    return last.select("ccn", blank("state").alias("state"), blank("name").alias("name"), F.col("r")["reason"].alias("reason"), urls.alias("urls_seen"), F.nullif(F.col("r")["last_tried"], F.lit("")).alias("last_tried"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """(ccn, decision, note) of an owner's decisions, the last of each ccn; a missing file has none."""
    rows = _listed(spark, path).where("row['ccn'] <> ''")
    last = rows.groupBy(F.col("row")["ccn"].alias("ccn")).agg(F.max_by("row", F.struct("file", "place")).alias("r"))
    return last.select("ccn", F.col("r")["decision"].alias("decision"), F.col("r")["note"].alias("note"))


def drafts(spark: SparkSession, folder: str, states: list[str] | None = None) -> DataFrame:
    """(state, file, draft) of folder/XX/*.json: one folder a state, files that begin with _ left out."""
    files = json_files(spark, f"{folder}/*/*.json")
    state, name = F.regexp_extract("file", "/([^/]*)/[^/]*$", 1), F.regexp_extract("file", "([^/]*)$", 1)
    rows = files.select(state.alias("state"), name.alias("file"), F.from_json("value", "map<string,string>").alias("draft")).where(F.col("state").rlike("^[A-Z]{2}$") & ~F.startswith("file", F.lit("_")))
    return rows.where(F.col("state").isin(states)) if states else rows


def summary_file(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """(zip, name, value) of the ZIP areas in a pipe-delimited summary file; missing columns are an error.

    Variables are named as the other form of the source names them, B17024_107E for B17024_E107 here.
    """
    there = {v: f"{v[:7]}E{v[7:10]}" for v in variables}
    raw = needed(csv_text(spark, path, sep="|"), ["GEO_ID", *there.values()]).where(F.startswith("GEO_ID", F.lit(ZIP_AREA)))
    area = n.zip5(F.substring("GEO_ID", len(ZIP_AREA) + 1, 99)).alias("zip")
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(c).alias("value")) for v, c in there.items()]))
    return raw.select(area, cells.alias("c")).select("zip", "c.name", "c.value")
