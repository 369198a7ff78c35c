"""Sets of tables that change as one: written beside the current set, audited, and published by one rename.

A root holds version folders and a small file, CURRENT, that names one of them. Readers follow the file, so they see the
whole old set or the whole new one, and a run that is lost before its rename leaves what was there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.operators.facts import multiset_difference

CURRENT = "CURRENT"
#: (table, problem) rows of what an audit finds in a set of tables.
Audit = Callable[[dict[str, DataFrame]], Iterable[str]]


class AuditFailed(Exception):
    """A set of tables that wasn't published, and why."""


def _files(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the published version; None before the first."""
    jvm, path, fs = _files(spark, root)
    pointer = jvm.org.apache.hadoop.fs.Path(path, CURRENT)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def read_tables(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The published tables by name; those that the version lacks, and all before the first one, are left out."""
    version = current_version(spark, root)
    if version is None:
        return {}
    jvm, path, fs = _files(spark, root)
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(path, f"{version}/{n}"))}


def without_nul(df: DataFrame) -> DataFrame:
    """NUL characters out of strings, which many stores refuse."""
    return df.withColumns({c: F.replace(F.col(f"`{c}`"), F.lit("\x00"), F.lit("")) for c, t in df.dtypes if t == "string"})


def difference(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows that come (+) and go (-), repeats counted; all rows come where there was no table or one of other columns."""
    if old is None or set(old.columns) != set(new.columns):
        return new.withColumn("sign", F.lit("+"))
    return multiset_difference(old.select(*new.columns), new)


def dry_run(spark: SparkSession, root: str, tables: dict[str, DataFrame], allow: Iterable[str]) -> dict[str, DataFrame]:
    """What publishing would change in each allowed table, without writing anything."""
    allowed = [n for n in tables if n in set(allow)]
    there = read_tables(spark, root, allowed)
    return {n: difference(there.get(n), without_nul(tables[n])) for n in allowed}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], allow: Iterable[str], audit: Audit = lambda tables: ()) -> str:
    """Write the allowed tables as a new version, audit what was written, and make it the current one. Returns its name.

    Tables that aren't allowed are an error before anything is written. What is audited are the files: each table must
    hold the same bag of rows as the frame given, and ``audit`` must find nothing; else AuditFailed, the version is
    deleted and the current one stays.
    """
    refused = sorted(set(tables) - set(allow))
    if refused:
        raise ValueError(f"tables that are not allowed: {', '.join(refused)}")
    version = f"v-{uuid.uuid4().hex}"
    jvm, path, fs = _files(spark, root)
    folder = jvm.org.apache.hadoop.fs.Path(path, version)
    try:
        given = {n: without_nul(df) for n, df in tables.items()}
        for n, df in given.items():
            df.write.parquet(f"{root}/{version}/{n}")
        written = {n: spark.read.parquet(f"{root}/{version}/{n}") for n in tables}
        problems = [f"{n}: written rows differ" for n in tables if not multiset_difference(given[n], written[n]).isEmpty()]
        problems += list(audit(written))
        if problems:
            raise AuditFailed("; ".join(problems))
    except BaseException:
        fs.delete(folder, True)
        raise
    # the pointer is written beside and renamed over the old one in one step
    fresh, pointer = jvm.org.apache.hadoop.fs.Path(path, f"{CURRENT}-{version}"), jvm.org.apache.hadoop.fs.Path(path, CURRENT)
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, pointer, options)
    return version


def drop_old(spark: SparkSession, root: str, keep: Iterable[str] = ()) -> list[str]:
    """Delete all versions but the current one and those of ``keep``, once no reader uses them. Returns their names."""
    jvm, path, fs = _files(spark, root)
    stay = {current_version(spark, root), *keep}
    gone = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("v-") and s.getPath().getName() not in stay]
    for name in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, name), True)
    return sorted(gone)


def exported_facts(facts: DataFrame, sheets: DataFrame, demo: list[str]) -> DataFrame:
    """Facts of the latest version of each sheet that is published and no demo: what is exported by state.

    ``sheets``: ccn, state, version, status. The latest version counts even if it is held: then nothing is exported.
    """
    latest = sheets.groupBy("ccn").agg(F.max_by(F.struct("version", "status", "state"), "version").alias("s")).where("s.status = 'published'").where(~F.col("ccn").isin(demo) if demo else F.lit(True))
    return facts.join(latest.select("ccn", F.col("s.version").alias("version"), F.upper("s.state").alias("state")), ["ccn", "version"])
