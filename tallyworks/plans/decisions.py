"""Queries of decision tables, bands, versions and publication over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.operators import bands, facts, rules
from tallyworks.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _bands(*rows: tuple[float, float, float]) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.lit(float(c)).alias("percent")) for a, b, c in rows])


def _household(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as households: an income from the balance, a size and a state from keys."""
    income = F.round(F.abs("c_acctbal") * 8, 2).cast("decimal(18,2)")
    state = F.element_at(F.array(F.lit("AK"), F.lit("HI"), F.lit("WA"), F.lit("OR")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, income).alias("income"), (F.col("c_custkey") % 6).cast("int").alias("people"), state.alias("state"))


HOUSE = """house AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN CAST(round(abs(c_acctbal) * 8, 2) AS DECIMAL(18,2)) END AS income, CAST(c_custkey % 6 AS INTEGER) AS people,
    list_value('AK', 'HI', 'WA', 'OR')[c_nationkey % 4 + 1] AS state FROM customer),
  line AS (SELECT *, CASE state WHEN 'AK' THEN 19950 WHEN 'HI' THEN 18360 ELSE 15960 END + (greatest(people, 1) - 1) * CASE state WHEN 'AK' THEN 7100 WHEN 'HI' THEN 6530 ELSE 5680 END AS pov FROM house),
  pct AS (SELECT *, CASE WHEN income IS NOT NULL THEN CAST(((CAST(income * 100 AS HUGEINT) * 200 + pov) // (2 * pov)) AS DOUBLE) / 100 END AS percent FROM line)"""


@query(f"WITH {HOUSE} SELECT c_custkey, percent, CASE WHEN percent <= 100 THEN '<=100' WHEN percent <= 200 THEN '101-200' WHEN percent <= 300 THEN '201-300' WHEN percent <= 400 THEN '301-400' WHEN percent > 400 THEN '>400' END AS band FROM pct")
def fpl_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income in percent of the poverty line, halves up, and its band."""
    from tallyworks.functions.normalise import fpl_band

    p = rules.fpl_percent(F.col("income"), F.col("people"), F.col("state"))
    return _household(spark, sf_dir).select("c_custkey", p.cast("double").alias("percent"), fpl_band(p).alias("band"))


@query("""
SELECT c_custkey, CAST(CASE WHEN v >= 0 AND v <= 200 THEN 100 WHEN v > 200 AND v <= 300 THEN 75 WHEN v > 320 AND v <= 400 THEN 50 END AS DOUBLE) AS percent
FROM (SELECT c_custkey, round(c_acctbal / 20, 2) AS v FROM customer)""")
def band_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band that holds a value, without a join."""
    table_of = _bands((0, 200, 100), (200, 300, 75), (320, 400, 50))
    return table(spark, sf_dir, "customer").select("c_custkey", bands.band_of(table_of, F.round(F.col("c_acctbal") / 20, 2))["percent"].alias("percent"))


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with three bands that some keys pull apart, turn over or overlap."""
    k = F.col("p_partkey")
    low2 = F.lit(100.0) + (k % 5) * 20
    tiers = F.array(
        F.struct(F.lit(0.0).alias("low"), F.lit(100.0).alias("high"), (F.lit(100.0) - (k % 3) * 30).alias("percent")),
        F.struct(low2.alias("low"), F.lit(300.0).alias("high"), F.lit(60.0).alias("percent")),
        F.struct((F.lit(300.0) - (k % 7 == 0).cast("double") * 50).alias("low"), F.lit(400.0).alias("high"), (F.lit(20.0) + (k % 4) * 15).alias("percent")),
    )
    free = F.when(k % 4 != 0, F.lit(50.0) + (k % 9) * 15)
    ceiling = F.when(k % 6 == 0, F.lit(250.0) + (k % 13) * 20)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 10 != 0, tiers).alias("tiers"), free.alias("free"), ceiling.alias("ceiling"))


TIERED = """t AS (SELECT p_partkey AS k, p_partkey % 10 <> 0 AS has, 100 - (p_partkey % 3) * 30 AS p1, 100 + (p_partkey % 5) * 20 AS low2,
    300 - CASE WHEN p_partkey % 7 = 0 THEN 50 ELSE 0 END AS low3, 20 + (p_partkey % 4) * 15 AS p3,
    CASE WHEN p_partkey % 4 <> 0 THEN 50 + (p_partkey % 9) * 15 END AS free, CASE WHEN p_partkey % 6 = 0 THEN 250 + (p_partkey % 13) * 20 END AS ceiling FROM part),
  g AS (SELECT *, CASE WHEN has THEN CASE WHEN free IS NOT NULL AND 0 > free + 1 THEN 1 ELSE 0 END
      + CASE WHEN low2 > greatest(coalesce(free, 100), 100) + 1 THEN 1 ELSE 0 END
      + CASE WHEN low3 > greatest(coalesce(free, 300), 300) + 1 THEN 1 ELSE 0 END END AS gaps,
    coalesce(has AND (60 > p1 OR p3 > 60), false) AS rises, coalesce(has AND (low3 < 300 OR low2 < 100), false) AS crossing FROM t)"""


@query(f"WITH {TIERED} SELECT k AS p_partkey, CAST(gaps AS BIGINT) AS gaps, rises, crossing FROM g")
def band_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, rising discounts and overlaps of bands."""
    t = _tiered(spark, sf_dir)
    has = F.col("tiers").isNotNull()
    return t.select("p_partkey", F.when(has, F.size(bands.gaps(F.col("tiers"), F.col("free")))).cast("long").alias("gaps"), bands.rises(F.col("tiers")).alias("rises"), bands.overlaps(F.col("tiers")).alias("crossing"))


@query(f"""WITH {TIERED}, p AS (SELECT *, list_filter(list_value(
    CASE WHEN has AND rises THEN 'discount rises with income' END,
    CASE WHEN ceiling < greatest(CASE WHEN has THEN 400 END, free) THEN 'ceiling below own rules' END,
    CASE WHEN has AND gaps > 0 THEN 'incomes without a rule' END,
    CASE WHEN has AND free > 0 THEN 'free limit above first band' END,
    CASE WHEN NOT has AND free > 400 THEN 'free limit reads like a ceiling' END), lambda x: x IS NOT NULL) AS problems FROM g)
SELECT k AS p_partkey, array_to_string(problems, ';') AS problems,
  CASE WHEN k % 17 = 0 OR (free IS NULL AND ceiling IS NULL AND NOT has) OR len(problems) > 0 THEN 'held' ELSE 'published' END AS status FROM p""")
def publish_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions of a sheet's income rules and whether it is published."""
    t = _tiered(spark, sf_dir).withColumn("problems", facts.inconsistencies(F.col("free"), F.col("tiers"), F.col("ceiling"), F.lit(None).cast("double")))
    held = (F.col("p_partkey") % 17 == 0).cast("int")
    return t.select("p_partkey", F.array_join("problems", ";").alias("problems"), facts.status(held, F.lit(0), F.col("free"), F.col("tiers"), F.col("ceiling"), F.col("problems")).alias("status"))


@query(f"""WITH {HOUSE}, r AS (SELECT *, c_custkey % 5 = 0 AS resident_rule, c_custkey % 9 = 0 AS enrolled, CASE WHEN c_custkey % 3 = 0 THEN 150 END AS free,
    c_custkey % 4 = 0 AS has, CASE WHEN c_custkey % 7 = 0 THEN 300 END AS ceiling FROM pct),
  d AS (SELECT *, free IS NULL AND NOT has AND ceiling IS NOT NULL AS alone,
    CASE WHEN has AND percent > 200 AND percent <= 300 THEN 60.0 WHEN has AND percent > 300 AND percent <= 400 THEN 30.0 END AS band FROM r)
SELECT c_custkey, CASE WHEN resident_rule AND state <> 'WA' THEN 'not_eligible' WHEN enrolled AND alone THEN 'assistance' WHEN enrolled THEN 'free'
    WHEN free IS NULL AND NOT has AND ceiling IS NULL THEN 'unknown' WHEN percent IS NULL THEN 'needs_info'
    WHEN alone AND percent <= ceiling THEN 'assistance' WHEN alone THEN 'not_eligible' WHEN band IS NOT NULL THEN 'discount'
    WHEN percent <= free THEN 'free' WHEN percent <= CASE WHEN has THEN 400 ELSE free END THEN 'unknown' ELSE 'not_eligible' END AS tier,
  CAST(CASE WHEN resident_rule AND state <> 'WA' THEN NULL WHEN enrolled AND alone THEN NULL WHEN enrolled THEN 100.0
    WHEN free IS NULL AND NOT has THEN NULL WHEN percent IS NULL THEN NULL WHEN band IS NOT NULL THEN band WHEN percent <= free THEN 100.0 END AS DOUBLE) AS discount FROM d""")
def eligibility_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first income rule that decides for a household."""
    k = F.col("c_custkey")
    h = _household(spark, sf_dir).withColumn("percent", rules.fpl_percent(F.col("income"), F.col("people"), F.col("state")).cast("double"))
    out = rules.eligibility(
        F.col("percent"), F.col("state"), F.when(k % 9 == 0, F.array(F.lit("Snap"))).otherwise(F.array().cast("array<string>")),
        F.when(k % 5 == 0, F.array(F.lit("wa"))), F.when(k % 3 == 0, F.lit(150.0)), F.when(k % 4 == 0, _bands((200, 300, 60), (300, 400, 30))),
        F.when(k % 7 == 0, F.lit(300.0)), F.array(F.lit("SNAP"), F.lit("WIC")),
    )
    return h.select("c_custkey", out.alias("o")).select("c_custkey", "o.tier", "o.discount")


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first, CASE WHEN o_orderkey % 3 = 0 THEN 200 + o_orderkey % 100 END AS win, CASE WHEN o_orderkey % 4 = 0 THEN 100 + o_orderkey % 60 END AS wait,
   CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 250 AS INTEGER) END AS notice, o_orderkey % 5 <> 0 AS confirmed FROM orders),
d AS (SELECT *, first + CAST(greatest(coalesce(win, 240), 240) AS INTEGER) AS last, first + CAST(greatest(coalesce(wait, 120), 120) AS INTEGER) AS collect FROM o)
SELECT o_orderkey, CAST(last AS VARCHAR) AS application_deadline, CAST(collect AS VARCHAR) AS collections_from, date_diff('day', DATE '1999-01-01', last) AS days_left,
  CASE WHEN confirmed AND notice IS NOT NULL THEN notice < collect END AS notice_too_early FROM d""")
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and waits with their legal least."""
    k = F.col("o_orderkey")
    first = F.to_date("o_orderdate")
    out = rules.deadlines(first, F.to_date(F.lit("1999-01-01")), F.when(k % 3 == 0, 200 + k % 100), F.when(k % 4 == 0, 100 + k % 60), F.when(k % 2 == 0, F.date_add(first, (k % 250).cast("int"))), k % 5 != 0)
    text = {c: v.cast("string") if c in ("application_deadline", "collections_from") else v for c, v in out.items()}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[v.cast("long").alias(c) if c == "days_left" else v.alias(c) for c, v in text.items()])


@query("""
WITH e AS (SELECT event_id, list_value('free', 'discount', 'assistance', 'not_eligible')[event_id % 4 + 1] AS tier, list_value('approved', 'partial', 'denied', 'more_info')[event_id // 4 % 4 + 1] AS decision,
   event_id // 16 % 3 AS why, event_id // 48 % 3 AS docs, event_id % 5 = 0 AS changed FROM events),
f AS (SELECT *, why = 1 AS case_issue, docs = 1 AS fresh FROM e),
k AS (SELECT *, CASE WHEN decision = 'more_info' THEN CASE WHEN fresh THEN 'sheet_missing' ELSE 'matched' END
   WHEN tier = 'not_eligible' AND decision = 'denied' THEN 'matched' WHEN tier = 'not_eligible' THEN 'sheet_wrong'
   WHEN decision = 'approved' OR (decision = 'partial' AND tier IN ('discount', 'assistance')) THEN 'matched'
   WHEN decision = 'denied' AND case_issue THEN 'case_issue' WHEN decision = 'denied' AND tier = 'assistance' THEN 'case_issue'
   WHEN changed THEN 'sheet_wrong' ELSE 'hospital_slip' END AS kind FROM f)
SELECT event_id, kind, CASE WHEN decision = 'more_info' OR kind = 'case_issue' THEN NULL ELSE kind = 'matched' END AS matched,
  CAST(CASE WHEN fresh AND NOT (tier = 'not_eligible' AND decision <> 'more_info') THEN 1 ELSE 0 END AS BIGINT) AS new_documents,
  CASE WHEN kind = 'hospital_slip' THEN CASE WHEN decision = 'partial' THEN 'partial_despite_free' ELSE 'denied_despite_policy' END END AS slip,
  CASE WHEN kind = 'hospital_slip' THEN true WHEN kind = 'sheet_wrong' AND tier = 'not_eligible' THEN NOT changed ELSE false END AS rescout FROM k""")
def triage_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outcome says about the prediction."""
    i = F.col("event_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    none = F.array().cast("array<string>")
    fourth, sixteenth, last = F.expr("event_id div 4"), F.expr("event_id div 16") % 3, F.expr("event_id div 48") % 3
    reasons = F.when(sixteenth == 1, F.array(F.lit("income_too_high"), F.lit("late"))).when(sixteenth == 2, F.array(F.lit("not_resident"), F.lit("missing_documents"))).otherwise(none)
    asked = F.when(last == 1, F.array(F.lit("pay_stub"), F.lit("other"), F.lit("tax_return"))).when(last == 2, F.array(F.lit("other"))).otherwise(none)
    out = rules.triage(pick(["free", "discount", "assistance", "not_eligible"], i), pick(["approved", "partial", "denied", "more_info"], fourth), reasons, asked, F.array(F.lit("tax_return")), i % 5 == 0)
    rows = table(spark, sf_dir, "events").select("event_id", out.alias("o"))
    return rows.select("event_id", "o.kind", "o.matched", F.size("o.new_documents").cast("long").alias("new_documents"), "o.slip", "o.rescout")


def _facts(spark: SparkSession, sf_dir: str, turn: int) -> DataFrame:
    """Orders as two versions of facts: a later turn loses, changes and adds some."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    lost = F.col("key") % 10 == turn
    value = F.when((F.col("key") % 7 == 0) & F.lit(turn == 1), F.concat("p", F.lit("!"))).otherwise(F.col("p"))
    return o.where(~lost).select("key", value.alias("value"), F.col("s").alias("state"))


FACTS = """a AS (SELECT o_orderkey AS key, o_orderpriority AS value, o_orderstatus AS state FROM orders WHERE o_orderkey % 10 <> 0),
  b AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS value, o_orderstatus AS state FROM orders WHERE o_orderkey % 10 <> 1)"""


@query(f"WITH {FACTS} SELECT coalesce(a.key, b.key) AS key, a.value AS old, b.value AS new FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose value differs between two versions."""
    return facts.version_diff(_facts(spark, sf_dir, 0), _facts(spark, sf_dir, 1), ["key"])


@query(f"WITH {FACTS} SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NOT NULL THEN b.value ELSE a.value END AS value, a.state AS state FROM a FULL JOIN b ON a.key = b.key")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert of one owned column."""
    return facts.upsert(_facts(spark, sf_dir, 0), _facts(spark, sf_dir, 1), ["key"], ["value"])


@query(f"""WITH {FACTS}, x AS (SELECT state, value FROM a), y AS (SELECT state, value FROM b)
SELECT state, value, sign, count(*) AS n FROM (SELECT *, '-' AS sign FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT *, '+' AS sign FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)) GROUP BY ALL""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of either version beyond those of the other."""
    a, b = (_facts(spark, sf_dir, t).select("state", "value") for t in (0, 1))
    return facts.multiset_difference(a, b).groupBy("state", "value", "sign").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT o_orderkey AS key, o_orderpriority AS v1, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS v2,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority WHEN o_orderkey % 4 = 1 THEN o_orderstatus WHEN o_orderkey % 4 = 2 THEN 'x' END AS v3 FROM orders)
SELECT key, v1 AS first, v2 AS second, v3 AS third, CASE WHEN v3 = v1 THEN 'primary' WHEN v3 = v2 THEN 'secondary' ELSE 'unsettled' END AS verdict FROM f WHERE v1 <> v2""")
def reading_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disputed facts and what a third reading decides."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.lit(facts.CRITICAL_PATHS[0]).alias("path"))
    k = F.col("key")
    second = o.withColumn("value", F.when(k % 3 == 0, F.col("s")).otherwise(F.col("p")))
    third = o.withColumn("value", F.when(k % 4 == 0, F.col("p")).when(k % 4 == 1, F.col("s")).when(k % 4 == 2, F.lit("x")))
    found = facts.conflicts(o.withColumnRenamed("p", "value"), second.drop("p"), third.drop("p"), ["key"], facts.CRITICAL_PATHS)
    return found.select("key", "first", "second", "third", "verdict")


@query(f"""WITH {FACTS}, prev AS (SELECT key, value, CASE WHEN key % 2 = 0 THEN 'reported' ELSE 'document' END AS layer FROM a),
cur AS (SELECT key, value, 'document' AS layer FROM b)
SELECT * FROM cur UNION ALL SELECT prev.* FROM prev WHERE layer = 'reported' AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.key = prev.key)""")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported facts of the version before that the new one lacks."""
    layer = F.when(F.col("key") % 2 == 0, "reported").otherwise("document")
    prev = _facts(spark, sf_dir, 0).select("key", F.lit("p").alias("path"), "value", layer.alias("layer"))
    cur = _facts(spark, sf_dir, 1).select("key", F.lit("p").alias("path"), "value", F.lit("document").alias("layer"))
    return facts.carry_over(cur, prev, ["key"]).select("key", "value", "layer")


@query("""
SELECT o_orderkey, CASE WHEN length(o_orderpriority) < 5 THEN 'too short' WHEN o_orderpriority NOT LIKE '%' || left(o_orderstatus, 1) || '%' AND o_orderkey % 2 = 0 THEN 'quote not found'
  WHEN o_totalprice > 300000 THEN 'number not stated' WHEN o_custkey % 10 = 0 THEN 'document set aside' END AS reason FROM orders""")
def first_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered cascade of rejections: the first rule that fails names the reason."""
    reason = facts.first_reason(
        ("too short", F.length("o_orderpriority") < 5),
        ("quote not found", ~F.col("o_orderpriority").contains(F.substring("o_orderstatus", 1, 1)) & (F.col("o_orderkey") % 2 == 0)),
        ("number not stated", F.col("o_totalprice") > 300000),
        ("document set aside", F.col("o_custkey") % 10 == 0),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("""
SELECT o_orderkey, CASE WHEN d >= 45 AND o_orderkey % 3 <> 0 THEN 45 WHEN d >= 30 AND o_orderkey % 5 <> 0 THEN 30 WHEN d >= 14 THEN 14 END AS due
FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS d FROM orders)""")
def due_check_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest check-in that is due and not answered."""
    k = F.col("o_orderkey")
    answered = F.array_compact(F.array(F.when(k % 3 == 0, F.lit(45)), F.when(k % 5 == 0, F.lit(30))))
    days = F.datediff(F.to_date(F.lit("1998-01-01")), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.due_check_in(days, answered).alias("due"))
