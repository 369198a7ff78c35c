"""Queries of choices among rows, stores that grow, and figures of the ledger, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions import normalise as n
from tallyworks.operators import allocate, choices, facts, ranks, rules, work
from tallyworks.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


c = F.col


@query("""
WITH h AS (SELECT o_custkey % 300 AS ccn, 'u' || CAST(o_orderkey % 37 AS VARCHAR) AS url, CASE o_orderkey % 5 WHEN 0 THEN 'fap' WHEN 1 THEN 'application' WHEN 2 THEN 'summary' WHEN 3 THEN 'billing' END AS cls, o_totalprice AS score FROM orders),
b AS (SELECT ccn, url, arg_max(coalesce(cls, ''), (score, coalesce(cls, ''))) AS cls, max(score) AS score FROM h GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY ccn, cls ORDER BY score DESC, url) = 1 AS first FROM b WHERE cls <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY CASE WHEN first THEN list_position(['fap', 'application', 'summary', 'billing'], cls) ELSE 5 END, score DESC, url) AS place FROM p)
SELECT ccn, url, cls AS doc_class, place FROM r WHERE place <= 4""")
def selected_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses to fetch for each hospital: the best of each class, then the best of the rest."""
    k = c("o_orderkey") % 5
    cls = F.when(k == 0, "fap").when(k == 1, "application").when(k == 2, "summary").when(k == 3, "billing")
    hits = table(spark, sf_dir, "orders").select((c("o_custkey") % 300).alias("ccn"), F.concat(F.lit("u"), (c("o_orderkey") % 37).cast("string")).alias("url"), cls.alias("doc_class"), c("o_totalprice").alias("score"))
    return choices.select_urls(hits, "ccn")


@query("""
WITH h AS (SELECT s_suppkey AS ccn, 'site' || CAST(s_suppkey % 40 AS VARCHAR) AS site, s_nationkey % 3 AS state FROM supplier),
v AS (SELECT l_suppkey AS ccn, arg_max(l_returnflag, l_orderkey * 10000 + l_partkey) AS flag FROM lineitem GROUP BY 1),
p AS (SELECT ccn, site, state FROM h JOIN v USING (ccn) WHERE flag = 'N')
SELECT h.ccn, min(p.ccn) AS sibling FROM h JOIN p ON p.site = h.site AND p.state = h.state AND p.ccn <> h.ccn GROUP BY 1""")
def sibling_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hospital the first other one of its website and state whose newest sheet is published."""
    h = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("ccn"), F.concat(F.lit("site"), (c("s_suppkey") % 40).cast("string")).alias("website_domain"), (c("s_nationkey") % 3).alias("state"))
    sheets = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("ccn"), (c("l_orderkey") * 10000 + c("l_partkey")).alias("version"), F.when(c("l_returnflag") == "N", "published").otherwise("held").alias("status"))
    # of rows with one version any may be taken, so the flag decides among them
    sheets = sheets.groupBy("ccn", "version").agg(F.max("status").alias("status"))
    return choices.siblings(h, sheets).select("ccn", "sibling")


SQL["sibling_sheets"] = SQL["sibling_sheets"].replace("SELECT l_suppkey AS ccn, arg_max(l_returnflag, l_orderkey * 10000 + l_partkey) AS flag FROM lineitem GROUP BY 1", "SELECT ccn, arg_max(flag, version) AS flag FROM (SELECT l_suppkey AS ccn, l_orderkey * 10000 + l_partkey AS version, CASE WHEN bool_or(l_returnflag = 'N') THEN 'N' ELSE 'X' END AS flag FROM lineitem GROUP BY 1, 2) GROUP BY 1")


@query("""
WITH s AS (SELECT o_custkey AS ccn, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey FROM orders LEFT JOIN s ON ccn = o_custkey WHERE last IS NULL OR o_orderdate > last""")
def items_since_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders filed after the last one of their customer that is published."""
    items = table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("ccn"), c("o_orderdate").alias("created_at"))
    sheets = table(spark, sf_dir, "orders").select(c("o_custkey").alias("ccn"), F.when(c("o_orderstatus") == "F", "published").otherwise("held").alias("status"), c("o_orderdate").alias("created_at"))
    return choices.since_published(items, sheets).select("o_orderkey")


@query("""
SELECT l_suppkey AS ccn, max(CAST(o_orderdate AS DATE)) AS fetched_on FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 4 <> 0 GROUP BY 1""")
def newest_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fetch of each hospital's own documents; a state's don't count."""
    links = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("ccn"), F.when(c("l_orderkey") % 4 == 0, F.concat(F.lit("state-"), c("l_orderkey").cast("string"))).otherwise(c("l_orderkey").cast("string")).alias("source_id"))
    kind = F.when(c("o_orderstatus") == "F", "hospital_web").when(c("o_orderstatus") == "P", "state_repository").otherwise("upload")
    sources = table(spark, sf_dir, "orders").select(F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit("state-"), c("o_orderkey").cast("string"))).otherwise(c("o_orderkey").cast("string")).alias("source_id"), kind.alias("kind"), F.to_date("o_orderdate").alias("fetched_on"))
    return choices.newest_fetch(links, sources).select("ccn", "fetched_on")


@query("""
SELECT l_suppkey, l_partkey, 'file ' || CAST(min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) AS VARCHAR) AS vintage FROM lineitem GROUP BY 1, 2""")
def newest_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that several files repeat, once each, with the vintage of the newest file."""
    rank = F.when(c("l_returnflag") == "N", 0).when(c("l_returnflag") == "R", 1).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", rank.alias("rank"), F.concat(F.lit("file "), rank.cast("string")).alias("vintage"))
    return choices.newest_vintage(rows, ["l_suppkey", "l_partkey"], c("rank"), "vintage")


@query("""
WITH x AS (SELECT event_type AS service, ts, CAST(round(value, 2) AS DECIMAL(18,2)) AS cost FROM events), m AS (SELECT max(ts) AS t FROM events)
SELECT 'click' AS service, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS used, coalesce(sum(cost), 0) + 5 <= 1000 AS more FROM x, m WHERE service = 'click' AND ts >= t - INTERVAL 7 DAY""")
def service_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one service has cost in the last seven days, and whether five more fit under the cap."""
    e = table(spark, sf_dir, "events").select(c("event_type").alias("service"), c("ts").alias("at"), F.round("value", 2).cast("decimal(18,2)").alias("cost"))
    last = e.agg(F.max("at").alias("t")).first()["t"]
    used = choices.used_since(e, "click", F.lit(last) - F.expr("interval 7 days"))
    return used.select(F.lit("click").alias("service"), c("used").cast("double").alias("used"), choices.within_cap(c("used"), F.lit(5), F.lit(1000)).alias("more"))


@query("""
WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice < 400000 THEN 1 END AS seen, o_custkey % 5 AS name, o_totalprice AS amount, o_orderkey % 5 AS r_name, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS r_amount FROM orders)
SELECT unnest(['name', 'amount']) AS field, unnest([avg(CAST(seen IS NOT NULL AND name = r_name AS DOUBLE)), avg(CAST(seen IS NOT NULL AND abs(amount - r_amount) < 0.5 AS DOUBLE))]) AS accuracy, count(*) AS n FROM t""")
def field_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of labelled rows that were read right, by field; unread rows fail."""
    o = table(spark, sf_dir, "orders")
    truth = o.select(c("o_orderkey").alias("k"), (c("o_custkey") % 5).alias("name"), c("o_totalprice").alias("amount"))
    read = o.where("o_totalprice < 400000").select(c("o_orderkey").alias("k"), (c("o_orderkey") % 5).alias("name"), F.when(c("o_orderkey") % 6 == 0, c("o_totalprice") + 1).otherwise(c("o_totalprice")).alias("amount"))
    return choices.field_accuracy(truth, read, "k", {"name": c("t_name") == c("r_name"), "amount": F.abs(c("t_amount") - c("r_amount")) < 0.5})


@query("""
WITH x AS (SELECT o_orderkey, 2010 + o_orderkey % 9 AS y, o_custkey % 2 = 0 AS a, o_custkey % 3 = 0 AS b, o_custkey % 5 = 0 AS d FROM orders)
SELECT o_orderkey, CASE WHEN y <= 2013 THEN a END AS lawsuits, CASE WHEN y <= 2013 THEN b END AS liens, CASE WHEN y >= 2016 THEN d WHEN y <= 2013 THEN a OR b END AS legal_action, CASE WHEN y > 2013 THEN a END AS sells_debt,
  CASE WHEN b THEN 'legal_action' ELSE '' END AS permitted FROM x""")
def filing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a filing's boxes say, by the year of its form."""
    k = c("o_custkey")
    boxes = F.array_compact(F.array(*[F.when(k % m == 0, F.lit(x)) for m, x in ((2, "LawsuitInd"), (2, "EngagedSellingDebtInd"), (3, "LiensOnResidencesInd"), (3, "PermitLawsuitInd"), (5, "EngagedLegalJudicialProcessInd"))]))
    flags = choices.collection_flags((c("o_orderkey") % 9 + 2010).cast("int"), boxes)
    out = table(spark, sf_dir, "orders").select("o_orderkey", flags.alias("f")).select("o_orderkey", "f.lawsuits", "f.liens", "f.legal_action", "f.sells_debt", F.array_join("f.permitted", ",").alias("permitted"))
    return out


@query("""
WITH e AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)
SELECT DISTINCT user_id, event_type, day FROM e WHERE event_type IN (SELECT event_type FROM e WHERE event_type < 'p') EXCEPT SELECT user_id, event_type, day FROM e WHERE value < 10""")
def evidence_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of an allowed kind that isn't stored, each once."""
    e = table(spark, sf_dir, "events").select("value", "user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    keys = ["user_id", "event_type", "day"]
    return work.add_evidence(e.where("value < 10"), e, keys, e.where("event_type < 'p'").select("event_type").distinct(), "event_type").select(*keys)


@query("""
WITH x AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 = 0 AS sealed, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') AS age FROM orders)
SELECT o_orderkey FROM x WHERE NOT (age > 400 OR (o_orderstatus = 'O' AND NOT sealed AND age > 1))""")
def kept_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that retention keeps on a day: not past their link's life, not abandoned."""
    cases = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "O", "new").otherwise("sent").alias("status"), F.when(c("o_orderkey") % 3 == 0, "s").alias("sealed"), c("o_orderdate").alias("updated_at"))
    return rules.purge(cases, F.lit("1998-06-01").cast("date"), 400).select("o_orderkey")


@query("""
WITH cur AS (SELECT s_suppkey AS k, 1 + s_suppkey % 4 AS version FROM supplier WHERE s_acctbal >= 0),
changed AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 3 = 0)
SELECT k, coalesce(version, 0) + 1 AS version, path, value FROM changed LEFT JOIN cur USING (k),
  LATERAL (SELECT 'a' AS path, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'same' END AS value UNION ALL SELECT 'b', 'same')""")
def versions_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets that differ from their latest version, as the next one; the others are left out."""
    k = c("k")
    s = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), "s_acctbal")
    fact = lambda df, a: df.select(*df.columns, F.explode(F.array(F.struct(F.lit("a").alias("path"), a.alias("value")), F.struct(F.lit("b").alias("path"), F.lit("same").alias("value")))).alias("f")).select(*df.columns, "f.*")
    stored = s.where("s_acctbal >= 0").select("k", F.explode(F.sequence(F.lit(1), (1 + k % 4).cast("int"))).alias("version"))
    old = fact(stored, F.when(c("version") < 1 + k % 4, "older").otherwise("same"))
    return facts.append_changed(old, fact(s.select("k"), F.when(k % 3 == 0, "new").otherwise("same")), ["k"], "path", "value")


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def filed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose key no item on file has, each once."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linestatus")
    return facts.file_once(li.where("l_linestatus = 'O'"), li, ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey")


@query("""
WITH x AS (SELECT c_custkey AS k, c_acctbal AS a, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS p, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 7 AS DOUBLE) END AS w FROM customer)
SELECT k, CASE WHEN w > 0 THEN round_even(p / w * 100, 4) END AS share, CASE WHEN p IS NOT NULL OR w IS NOT NULL THEN coalesce(p, 0) + coalesce(w, 0) END AS known,
  CASE WHEN w <> 0 THEN 100.0 * p / w END AS dual, round_even((k % 90) * (1 + 0.5 * coalesce(p / 50, 0)), 2) AS priority, CAST(coalesce(CASE WHEN k % 5 = 0 THEN DATE '2026-01-01' END, DATE '2026-02-01' + CAST(k % 60 AS INTEGER)) AS VARCHAR) AS respond_by,
  CAST(((3.0 * k + 15.0 * (k % 10)) / 1000000) AS DOUBLE) AS dollars, CAST(ceil((k % 23) / 5.0) * CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS extract, CAST(greatest(1, ceil((k % 23) / 10.0)) AS BIGINT) AS mapped FROM x""")
def ledger_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, sums of what is known, parts, weighted priorities, deadlines and costs of customers."""
    k = c("c_custkey")
    x = table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 3 != 0, (k % 50).cast("double")).alias("p"), F.when(k % 4 != 0, (k % 7).cast("double")).alias("w"), F.lit(100.0).alias("whole"))
    k = c("k")
    due = rules.respond_deadline(F.when(k % 5 == 0, F.lit("2026-01-01").cast("date")), F.lit("2026-02-01").cast("date"), (k % 60).cast("int"))
    return x.select(
        "k", ranks.share_percent("p", "w").alias("share"), ranks.sum_of_known("p", "w").alias("known"), allocate.dual_part("whole", "p", "w").alias("dual"),
        rules.weighted_priority((k % 90).cast("double"), 0.5, c("p") / 50).alias("priority"), due.cast("string").alias("respond_by"),
        choices.token_cost(k, k % 10, F.lit(3), F.lit(15)).cast("double").alias("dollars"), choices.extract_cost(k % 23, k % 2 == 0).alias("extract"), choices.map_cost(k % 23).alias("mapped"),
    )


@query(r"""
WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN ' ' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) || '-1' WHEN 2 THEN '*' WHEN 3 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '.7' END AS cell, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT k, CASE WHEN regexp_matches(trim(cell), '^[0-9]{1,4}$') THEN lpad(trim(cell), 5, '0') ELSE trim(cell) END AS zip, CASE WHEN regexp_matches(trim(cell), '^[0-9.]+$') THEN CAST(trunc(CAST(trim(cell) AS DOUBLE)) AS BIGINT) END AS cell_count,
  substring(sha256(CAST(k AS VARCHAR)), 1, 16) AS hash, CASE WHEN k % 2 = 0 THEN '2020-01-01 to ' || d || ', file of 2021' ELSE '2020-01-01' END AS vintage, CASE WHEN k % 2 = 0 THEN CAST(substring(d, 1, 4) AS INTEGER) ELSE 2020 END AS year FROM x""")
def normalised_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residence ZIPs, published counts, case hashes and vintages as sources write them."""
    k, w = c("o_orderkey"), c("o_custkey").cast("string")
    cell = F.when(k % 5 == 0, F.concat(F.lit(" "), w)).when(k % 5 == 1, F.concat(w, F.lit("-1"))).when(k % 5 == 2, "*").when(k % 5 == 4, F.concat(w, F.lit(".7")))
    even = k % 2 == 0
    label = n.vintage(F.lit("2020-01-01"), F.when(even, F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(even, "2021"))
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), n.zip_of_counts(cell).alias("zip"), n.count_cell(cell).alias("cell_count"), n.case_hash(k.cast("string")).alias("hash"), label.alias("vintage"), n.year_of_vintage(label).alias("year"),
    )
