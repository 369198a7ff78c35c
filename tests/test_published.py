"""Tables that change as one, and versions appended from a stream that is lost and run again."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyworks.sources import published as pub
from tallyworks.streaming import versions
from tallyworks.streaming.events import read_events


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_set_of_tables_changes_as_one(spark, tmp_path):
    root, allow = str(tmp_path / "set"), ["a", "b"]
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y\x00")], "k int, t string"), spark.createDataFrame([(1.5,)], "v double")
    assert pub.current_version(spark, root) is None and pub.read_tables(spark, root, allow) == {}
    assert rows_of(pub.dry_run(spark, root, {"a": a, "c": b}, allow)["a"]) == [(1, "x", "+"), (1, "x", "+"), (2, "y", "+")] and not (tmp_path / "set").exists()
    first = pub.publish(spark, root, {"a": a, "b": b}, allow)
    assert pub.current_version(spark, root) == first
    now = pub.read_tables(spark, root, allow)
    assert rows_of(now["a"]) == [(1, "x"), (1, "x"), (2, "y")] and rows_of(now["b"]) == [(1.5,)]
    less = spark.createDataFrame([(1, "x"), (3, "z")], "k int, t string")
    assert rows_of(pub.dry_run(spark, root, {"a": less}, allow)["a"]) == [(1, "x", "-"), (2, "y", "-"), (3, "z", "+")]
    # neither a refused table nor a failed audit or write leaves a trace
    before = sorted(p.name for p in (tmp_path / "set").iterdir() if not p.name.startswith("."))
    with pytest.raises(ValueError, match="not allowed: c"):
        pub.publish(spark, root, {"a": less, "c": b}, allow)
    with pytest.raises(pub.AuditFailed, match="a: too few"):
        pub.publish(spark, root, {"a": less}, allow, lambda t: ["a: too few"] if t["a"].count() < 3 else [])
    with pytest.raises(Exception, match="lost"):
        pub.publish(spark, root, {"a": less.withColumn("t", F.raise_error(F.lit("lost")).cast("string"))}, allow)
    assert sorted(p.name for p in (tmp_path / "set").iterdir() if not p.name.startswith(".")) == before and pub.current_version(spark, root) == first
    old = pub.read_tables(spark, root, allow)["a"]
    second = pub.publish(spark, root, {"a": less}, allow)
    assert rows_of(pub.read_tables(spark, root, allow)["a"]) == [(1, "x"), (3, "z")] and set(pub.read_tables(spark, root, allow)) == {"a"}
    assert rows_of(old) == [(1, "x"), (1, "x"), (2, "y")]  # a reader of the old set keeps it
    assert pub.drop_old(spark, root) == [first] and pub.current_version(spark, root) == second


def test_exported_facts(spark):
    sheets = spark.createDataFrame([("a", "ma", 1, "published"), ("a", "ma", 2, "published"), ("b", "MA", 1, "published"), ("b", "MA", 2, "held"), ("d", "MA", 1, "published")], "ccn string, state string, version int, status string")
    facts = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x"), ("b", 2, "y"), ("d", 1, "demo")], "ccn string, version int, value string")
    assert [tuple(r) for r in pub.exported_facts(facts, sheets, ["d"]).collect()] == [("a", 2, "new", "MA")]


def expected(rows):
    by_key = defaultdict(list)
    for key, ts, value in rows:
        by_key[key].append((ts, value))
    out = []
    for key, some in by_key.items():
        last, n = object(), 0
        for ts, value in sorted(some, key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            if value != last:
                n, last = n + 1, value
                out.append((key, n, value))
    return sorted(out, key=repr)


def test_versions_survive_a_lost_run_and_overlapping_files(spark, tmp_path, monkeypatch):
    rng, first = random.Random(8), dt.datetime(2024, 1, 1)
    files = []
    for day in range(6):  # each file reaches back over the one before
        files.append([(f"k{rng.randint(0, 5)}", first + dt.timedelta(hours=24 * day - rng.uniform(0, 20)), rng.choice(["a", "b", None])) for _ in range(60)])
    files.append([("end", first + dt.timedelta(days=30), "z")])  # moves the watermark past all others
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(files):
        frame = pd.DataFrame(rows, columns=["key", "ts", "value"])
        frame["ts"] = frame["ts"].astype("datetime64[us]")
        frame.to_parquet(tmp_path / "in" / f"{i}.parquet", index=False)
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")

    def run():
        log = read_events(spark, str(tmp_path / "in"), "key string, ts timestamp_ntz, value string", 1).withColumn("ts", F.col("ts").cast("timestamp"))
        versions.append_versions(versions.in_order(log, "2 days"), table, checkpoint)

    real, calls = versions.next_versions, []

    def breaks(latest, rows):
        calls.append(1)
        if len(calls) == 4:  # after some batches were written
            raise RuntimeError("lost")
        return real(latest, rows)

    monkeypatch.setattr(versions, "next_versions", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(versions, "next_versions", real)
    run()
    run()  # nothing is left
    want = expected([r for rows in files[:-1] for r in rows])
    got = sorted(((r["key"], r["version"], r["value"]) for r in versions.read_versions(spark, table).where("key <> 'end'").collect()), key=repr)
    assert got == want
    # a batch that is run again writes the same rows over its own folder
    spark.read.schema(versions.VERSIONS).parquet(f"{table}/batch-0")
    assert versions.read_versions(spark, table, 0).collect() == []


def test_versions_of_one_batch(spark):
    latest = spark.createDataFrame([("a", 3, "x"), ("b", 1, None)], "key string, version long, value string")
    at = lambda n: dt.datetime(2024, 1, n)
    rows = spark.createDataFrame([("a", at(2), "y"), ("a", at(1), "x"), ("a", at(3), "y"), ("b", at(1), None), ("b", at(2), "n"), ("c", at(1), None)], versions.SHAPE)
    assert sorted((r["key"], r["version"], r["value"]) for r in versions.next_versions(latest, rows).collect()) == [("a", 4, "y"), ("b", 2, "n"), ("c", 1, None)]
    assert versions.next_versions(latest, rows.limit(0)).collect() == []
