"""Whole jobs: small inputs on which a cut would show."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from same import assert_same, connect
from tallyworks.operators import corpus
from tallyworks.plans import streams, texts
from tallyworks.streaming import events as ev


def written(spark, folder, name, rows, shape):
    spark.createDataFrame(rows, shape).coalesce(1).toPandas().to_parquet(folder / f"{name}.parquet", index=False)
    return str(folder)


def test_shells_are_equal_in_their_whole_text(spark, tmp_path):
    head = "<!doctype html><html lang='en'><head><title>A hospital of the county</title></head><body>"
    menu, policy = head + "Home About Contact", head + "Our charity care policy"
    rows = [(1, "http://a/1", menu), (2, "http://a/2", menu), (3, "http://a/3", menu + " Us"), (4, "http://a/4", policy), (5, "http://a/5", policy), (6, "http://a/6.PDF", menu), (7, "http://a/7", head), (8, "http://a/7", head), (9, "http://a/8", None)]
    sf_dir = written(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    by_text = defaultdict(set)
    for _, url, html in rows:
        if html is not None and not url.lower().endswith(".pdf"):
            by_text[html.strip()].add(url)
    shells = {u for t, urls in by_text.items() if len(urls) > 1 and "charity care" not in t for u in urls}
    got = texts.QUERIES["whole_page_shells"](spark, sf_dir)
    assert {r["url"] for r in got.collect()} == shells == {"http://a/1", "http://a/2"}
    assert assert_same(got, connect(sf_dir), texts.SQL["whole_page_shells"]) == 2


@pytest.fixture(scope="module")
def overlapping(tmp_path_factory):
    """Events of 30 days in three files that each cover all of them, and one user of more rows than an Arrow batch."""
    rng, first = random.Random(5), dt.datetime(2024, 1, 1)
    at = [first + dt.timedelta(seconds=rng.randrange(30 * 86400)) for _ in range(15_000)]
    rows = pd.DataFrame({"event_id": range(15_000), "ts": at, "user_id": [1 if i % 5 else i % 7 for i in range(15_000)], "event_type": [f"t{i % 3}" for i in range(15_000)], "value": 1.0, "props": "{}"})
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    folder = tmp_path_factory.mktemp("log")
    (folder / "events.parquet").mkdir()
    for i in range(3):
        rows[rows["event_id"] % 3 == i].to_parquet(folder / f"events.parquet/part-{i}.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return str(folder), rows, con


@pytest.mark.parametrize("name", ["stream_daily_usage", "stream_once"])
def test_overlapping_files_lose_no_rows(spark, overlapping, name):
    sf_dir, _, con = overlapping
    assert assert_same(streams.QUERIES[name](spark, sf_dir), con, streams.SQL[name])


def test_windows_and_sessions_of_overlapping_files(spark, overlapping):
    sf_dir, rows, _ = overlapping
    us = rows["ts"].astype("int64")
    hour = 3_600_000_000
    sums = Counter(start for t in us for start in (t // (6 * hour) * 6 * hour, t // (6 * hour) * 6 * hour - 6 * hour))
    over = us.max() - 24 * hour
    got = {r["start_us"]: r["n"] for r in streams.QUERIES["stream_sliding_usage"](spark, sf_dir).collect()}
    assert got == {s: n for s, n in sums.items() if s + 12 * hour <= over}
    runs = []
    for user, ts in us.groupby(rows["user_id"]):
        ts = sorted(ts)
        cuts = [0, *[i for i in range(1, len(ts)) if ts[i] - ts[i - 1] >= 2 * hour], len(ts)]
        runs += [(user, ts[a], b - a) for a, b in zip(cuts, cuts[1:], strict=False) if ts[b - 1] + 2 * hour <= over]
    assert sorted(map(tuple, streams.QUERIES["stream_sessions"](spark, sf_dir).collect())) == sorted(runs)


def test_rate_limit_takes_a_hot_user_in_order(spark, overlapping):
    sf_dir, rows, _ = overlapping
    want = {}
    for _, g in rows.sort_values(["ts", "event_id"]).groupby("user_id"):
        start, used = None, 0
        for i, t in zip(g["event_id"], g["ts"], strict=True):
            if start is None or t - start >= pd.Timedelta(days=1):
                start, used = t, 0
            used += 1
            want[i] = used <= 3
    assert {r["event_id"]: r["allowed"] for r in streams.QUERIES["stream_rate_limit"](spark, sf_dir).collect()} == want


def test_late_rows_are_counted(spark, overlapping, tmp_path):
    sf_dir, _, _ = overlapping
    log = ev.read_events(spark, f"{sf_dir}/event[s].parquet", streams.FILED).withColumn("ts", F.col("ts").cast("timestamp"))
    assert ev.run_once(ev.windowed(log, "1 day"), str(tmp_path / "out"), str(tmp_path / "checkpoint")) > 0


def test_phrases_without_an_inner_word_are_found(spark):
    phrases = [(1, "uncompensated care"), (2, "本院为低收入患者提供经济援助计划"), (3, "otorhinolaryngology"), (4, "short one"), (5, "the cost of care"), (6, "uncompensated cash"), (7, " uncompensated"), (8, None)]
    texts = ["All uncompensated care, at the cost of care", "详情：本院为低收入患者提供经济援助计划。", "xotorhinolaryngologyx a short one", "uncompensatedcare", "", None, "an uncompensated\tcareer", "uncompensated careers " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = corpus.phrases_found(docs, "doc_id", "text", spark.createDataFrame(phrases, "item_id long, text string"), "item_id", "text")
    want = sorted((d, p) for d, t in enumerate(texts) for p, q in phrases if t and q and len(q) >= 12 and q in t)
    assert sorted(map(tuple, got.collect())) == want and {1, 2, 3, 5, 7} == {p for _, p in want}
