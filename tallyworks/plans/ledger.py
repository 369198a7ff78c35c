"""Queries of the ledger: exposure, behaviour, coverage, evidence, usage and queues over the driver's tables.

Suppliers stand for hospitals, parts for places, customers for households, orders for reports and outcomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.operators import allocate, ranks, work
from tallyworks.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""
WITH pair AS (SELECT l_suppkey, l_partkey, count(*) AS cases FROM lineitem GROUP BY 1, 2),
place AS (SELECT l_partkey, sum(cases) AS place_cases FROM pair GROUP BY 1),
score AS (SELECT l_suppkey, round(sum(coalesce(p_size, 0) * cases / place_cases), 6) AS served, count(*) AS places
  FROM pair JOIN place USING (l_partkey) LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1),
ranked AS (SELECT *, percent_rank() OVER (ORDER BY served) AS r, count(*) OVER () AS peers FROM score)
SELECT l_suppkey, served, places, CASE WHEN peers > 1 THEN round(r, 9) END AS rank, CASE WHEN peers > 1 THEN peers END AS peers,
  CASE WHEN r >= 2.0 / 3 THEN 'high' WHEN r >= 1.0 / 3 THEN 'medium' ELSE 'low' END AS label FROM ranked""")
def exposure_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share-weighted allocation of place weights, ranked and labelled by thirds."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.lit(1).alias("one"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    by_pair, by_place, _ = allocate.service_counts(rows, "l_suppkey", "l_partkey", "one")
    score = allocate.allocate(by_pair, by_place, parts, "l_suppkey", "l_partkey", "p_size").withColumn("served", F.round("served", 6))
    ranked = ranks.percentile_ranks(score, "served", "rank", "peers")
    return ranked.select("l_suppkey", "served", "places", F.round("rank", 9).alias("rank"), "peers", ranks.third_label("rank").alias("label"))


@query("""
WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey AS version, o_orderstatus AS status FROM v WHERE rn = 1""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order of the highest key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return ranks.latest_version(orders, ["o_custkey"], "version")


REPORTS = """reports AS (
  SELECT l_orderkey, l_suppkey, CAST(min(l_shipdate) AS DATE) AS b, CAST(max(l_shipdate) AS DATE) AS e,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS lines
  FROM lineitem GROUP BY ALL),
dated AS (SELECT l_suppkey % 50 AS ccn, l_orderkey, l_suppkey, e, year(e) AS fiscal_year, date_diff('day', CAST(o_orderdate AS DATE), e) AS period_days, total
  FROM reports JOIN orders ON o_orderkey = l_orderkey),
yearly AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ccn, fiscal_year ORDER BY period_days DESC, e DESC, l_orderkey, l_suppkey) AS rn FROM dated) WHERE rn = 1)"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.to_date(F.max("l_shipdate")).alias("e"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("b"))
    return lines.join(orders, "l_orderkey").withColumn("ccn", F.col("l_suppkey") % 50)


@query(f"WITH {REPORTS} SELECT ccn, fiscal_year, l_orderkey, period_days, total FROM yearly")
def pick_one_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per key and fiscal year: the longest period, then the latest, then the first seen."""
    tie = [F.col("l_orderkey"), F.col("l_suppkey")]
    return ranks.one_report_per_year(_reports(spark, sf_dir), "ccn", "b", "e", tie).select("ccn", "fiscal_year", "l_orderkey", "period_days", "total")


@query(f"""WITH {REPORTS} SELECT ccn, fiscal_year, period_days, total FROM (
  SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY CASE WHEN period_days >= 300 THEN 1 ELSE 0 END DESC, fiscal_year DESC) AS k FROM yearly) WHERE k = 1""")
def best_full_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of a full year, else the newest of any length."""
    yearly = ranks.one_report_per_year(_reports(spark, sf_dir), "ccn", "b", "e", [F.col("l_orderkey"), F.col("l_suppkey")])
    return ranks.best_report(yearly, "ccn").select("ccn", "fiscal_year", "period_days", "total")


@query("""
WITH spent AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1),
base AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS promised, total AS delivered FROM customer LEFT JOIN spent ON o_custkey = c_custkey),
p AS (SELECT c_custkey, percent_rank() OVER (ORDER BY promised) AS r FROM base WHERE promised IS NOT NULL),
d AS (SELECT c_custkey, percent_rank() OVER (ORDER BY delivered) AS r FROM base WHERE delivered IS NOT NULL)
SELECT c_custkey, round(p.r, 9) AS promised_rank, round(d.r, 9) AS delivered_rank, round(p.r - d.r, 9) AS gap,
  CASE WHEN round(p.r - d.r, 9) >= 0.25 THEN 'promises_more' WHEN round(p.r - d.r, 9) <= -0.25 THEN 'promises_less' WHEN p.r - d.r IS NOT NULL THEN 'delivers' END AS label,
  CASE WHEN p.r IS NOT NULL AND d.r IS NOT NULL THEN 'known' WHEN p.r IS NOT NULL OR d.r IS NOT NULL THEN 'partial' ELSE 'unknown' END AS status
FROM base LEFT JOIN p USING (c_custkey) LEFT JOIN d USING (c_custkey)""")
def gap_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two ranks, its label, and how much of it is known."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("delivered"))
    base = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("promised")).join(spent, "c_custkey", "left")
    ranked = ranks.percentile_ranks(ranks.percentile_ranks(base, "promised", "p"), "delivered", "d")
    gap = F.round(F.col("p") - F.col("d"), 9)
    known = F.col("p").isNotNull().cast("int") + F.col("d").isNotNull().cast("int")
    return ranked.select(
        "c_custkey", F.round("p", 9).alias("promised_rank"), F.round("d", 9).alias("delivered_rank"), gap.alias("gap"), ranks.gap_label(gap).alias("label"),
        F.when(known == 2, "known").when(known == 1, "partial").otherwise("unknown").alias("status"),
    )


@query("""
SELECT r_name AS region, n_name AS nation, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS published,
  count(*) FILTER (o_orderstatus = 'P') AS held, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS others
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ROLLUP (r_name, n_name)""")
def coverage_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, rolled up from nation to region to all."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # one row per customer before any order meets a name
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p")
    )
    named = per.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rolled = named.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    return rolled.agg(F.sum("n").alias("orders"), F.sum("f").alias("published"), F.sum("p").alias("held"), F.sum(F.col("n") - F.col("f") - F.col("p")).alias("others"))


@query("""
SELECT o_orderpriority AS source, count(*) AS cases, count(DISTINCT o_custkey) AS customers FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'MACHINERY') GROUP BY 1""")
def public_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source without the rows of excluded keys."""
    demo = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(demo, "o_custkey", "left_anti").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("cases"), F.count_distinct("o_custkey").alias("customers"))


@query("""
SELECT source, count(*) AS outcomes, sum(quality) AS matched, round(sum(quality) / count(*), 9) AS accuracy,
  count(*) >= 3 AND sum(quality) / count(*) < 0.8 AS needs_recheck
FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1""")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by source, and which sources need another look."""
    outcomes = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return work.scoreboard(outcomes, "source", "quality").withColumn("accuracy", F.round("accuracy", 9))


@query("""
SELECT event_type AS field, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS cases,
  CASE WHEN count(DISTINCT user_id) >= 5 THEN 'public' WHEN count(DISTINCT user_id) >= 3 THEN 'internal' END AS level
FROM events GROUP BY 1, 2""")
def evidence_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different cases report a value, and the level that allows."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), F.to_date("ts").cast("string").alias("day"), "user_id")
    return work.support(events, ["field", "day"], "user_id")


@query("""
WITH v AS (SELECT event_type AS field, json_extract_string(props, '$.k') AS value, count(DISTINCT user_id) AS cases FROM events GROUP BY 1, 2)
SELECT field, count(*) AS vals, min(cases) AS weakest, CAST(round(least(1.0, min(cases) / 10.0), 6) AS DOUBLE) AS confidence FROM v WHERE cases >= 5 GROUP BY 1""")
def reported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that at least five cases report, with the confidence of the weakest."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), F.get_json_object("props", "$.k").alias("value"), "user_id")
    known = work.support(events, ["field", "value"], "user_id").where("level = 'public'")
    weakest = F.min("cases")
    return known.groupBy("field").agg(F.count("*").alias("vals"), weakest.alias("weakest"), F.round(F.least(F.lit(1.0), weakest / 10), 6).alias("confidence"))


@query("""
SELECT CAST(CAST(d.day AS DATE) AS VARCHAR) AS day, CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))), 0) AS DOUBLE) AS used
FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) AS d(day) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d.day AS DATE) GROUP BY 1""")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by day, with the days of no usage."""
    out = work.usage_by_day(table(spark, sf_dir, "events"), F.to_date("ts"), F.col("value").cast("decimal(18,2)"), "2023-12-25", "2024-02-05")
    return out.select(F.col("day").cast("string").alias("day"), F.col("used").cast("double").alias("used"))


@query("SELECT event_type, count(*) AS units, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS usd, count(*) AS events FROM events GROUP BY 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and money by provider."""
    out = work.usage_totals(table(spark, sf_dir, "events"), "event_type", F.lit(1), F.col("value").cast("decimal(18,2)"))
    return out.withColumn("usd", F.col("usd").cast("double"))


@query("""
SELECT o_orderpriority, CAST(floor(median(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01'))) AS BIGINT) AS median_days, count(*) AS n FROM orders GROUP BY 1""")
def median_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median age in whole days."""
    age = F.datediff(F.to_date(F.lit("2002-01-01")), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.floor(F.median(age)).alias("median_days"), F.count("*").alias("n"))


@query("""
SELECT lang, count(*) AS docs, round(avg((CASE WHEN text <> '' THEN 1 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END) / 4.0), 6) AS completeness FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of core fields that are filled."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    filled = [F.col("text") != "", F.col("source").isNotNull(), F.col("quality").isNotNull(), F.col("n_chars") >= 1000]
    share = sum(F.coalesce(c, F.lit(False)).cast("int") for c in filled) / len(filled)
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg(share), 6).alias("completeness"))


QUEUE = """last AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS d, count(*) FILTER (o_orderstatus = 'O') AS demand,
    avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS accuracy FROM orders GROUP BY 1),
  entries AS (SELECT c_custkey, c_name, coalesce(date_diff('day', d, DATE '2002-01-01'), 90) AS staleness_days, coalesce(demand, 0) AS demand,
    CAST(round(round_even(greatest(1, coalesce(date_diff('day', d, DATE '2002-01-01'), 90)) * greatest(1, coalesce(demand, 0)) * greatest(0.2, 1.0 - coalesce(round(accuracy, 2), 0.5)), 2), 2) AS DOUBLE) AS priority
    FROM customer LEFT JOIN last ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3)"""


def _queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.to_date("o_orderdate")).alias("looked_on"), F.count_if(F.col("o_orderstatus") == "O").alias("demand"),
        F.round(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")), 2).alias("accuracy"),
    )
    skips = [("skip_listed", customers.where("c_mktsegment = 'BUILDING'")), ("recent_failure", customers.where("c_nationkey = 3"))]
    return work.build_queue(
        customers, "c_custkey", per.select("c_custkey", "looked_on"), per.select("c_custkey", "demand"), per.select("c_custkey", "accuracy"),
        skips, F.to_date(F.lit("2002-01-01")), "c_name",
    )


@query(f"WITH {QUEUE} SELECT c_custkey, staleness_days, demand, priority FROM entries")
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work by staleness, demand and doubt, without skipped keys."""
    return _queue(spark, sf_dir)[0].select("c_custkey", "staleness_days", "demand", "priority")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'skip_listed' ELSE 'recent_failure' END AS reason FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
def queue_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys left out of the queue, with the first reason."""
    return _queue(spark, sf_dir)[1]


@query(f"""WITH {QUEUE}, ordered AS (SELECT *, sum(CASE WHEN demand > 2 THEN 9 ELSE 7 END) OVER (ORDER BY priority DESC, c_name, c_custkey ROWS UNBOUNDED PRECEDING) AS spent FROM entries)
  SELECT c_custkey, priority, spent FROM ordered WHERE spent <= 500""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the queue that a budget of 500 credits reaches."""
    cost = F.when(F.col("demand") > 2, 9).otherwise(7)
    order = [F.col("priority").desc(), F.col("c_name"), F.col("c_custkey")]
    return work.within_budget(_queue(spark, sf_dir)[0], order, cost, 500).select("c_custkey", "priority", "spent")


@query("""
WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, k <= 2 AS granted FROM n""")
def read_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads a user, kind and day are granted."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return work.read_quota(events, ["user_id", "event_type", "day"], [F.col("ts"), F.col("event_id")], 2).select("event_id", "granted")


@query("""
WITH wanted AS (SELECT page_id AS owner, regexp_replace(url, '[?#].*$', '') AS u, page_id % 10 AS batch FROM pages),
missing AS (SELECT u, min(batch) AS batch FROM wanted WHERE u NOT LIKE '%/en/%' GROUP BY 1)
SELECT batch, count(*) AS urls, CAST(ceil(count(*) / 5) * 2 AS BIGINT) AS cost FROM missing GROUP BY 1""")
def refetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a refetch of missing addresses costs, by batch key."""
    wanted = table(spark, sf_dir, "pages").select(F.col("page_id").alias("owner"), F.regexp_replace("url", r"[?#].*$", "").alias("u"), (F.col("page_id") % 10).alias("batch"))
    _, cost = work.refetch_plan(wanted, wanted.where(F.col("u").contains("/en/")), "u", "owner", 5, 2)
    return cost


@query("""
SELECT event_type, CAST(time_bucket(INTERVAL 6 HOURS, ts) AS VARCHAR) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events GROUP BY 1, 2""")
def tumbling_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage in windows of six hours."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sums = events.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("amount"))
    return sums.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "amount")


@query("""
WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
runs AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, count(*) AS n, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us FROM runs GROUP BY user_id, run""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a pause of two hours."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = events.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("start_us"))
    return s.select("user_id", "n", "start_us")


@query("""
SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS matched, count(*) FILTER (o_totalprice > 100000) AS known,
  count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's report in one aggregate."""
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("matched"), F.count_if(F.col("o_totalprice") > 100000).alias("known"),
        F.count_distinct("o_custkey").alias("customers"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query("""
SELECT n_name, s_suppkey, s_acctbal, place FROM (SELECT n_name, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS place
FROM supplier JOIN nation ON n_nationkey = s_nationkey) WHERE place <= 3""")
def top_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest balances of each nation, unknown ones last."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey"))
    return joined.select("n_name", "s_suppkey", "s_acctbal", place.alias("place")).where("place <= 3")
