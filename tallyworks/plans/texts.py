"""Queries over texts: names, addresses, duplicates, quotes, numbers, languages and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions import normalise as n
from tallyworks.functions import passages as p
from tallyworks.functions import text as t
from tallyworks.operators import corpus
from tallyworks.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(r"""
WITH s AS (SELECT s_suppkey, 'St. ' || s_name || ' Med Ctr, Inc.' AS name, CAST(s_suppkey * 137 AS VARCHAR) AS num FROM supplier)
SELECT s_suppkey,
  array_to_string(list_filter(string_split(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'THE', 'INC', 'INCORPORATED', 'HOSPITAL', 'MEDICAL', 'CENTER', 'CORP', 'CORPORATION', 'OF', 'AND', '&', 'LLC', 'HEALTH', 'SYSTEM', 'DBA')), ' ') AS crosswalk_name,
  array_to_string(list_filter(string_split(regexp_replace(replace(replace(lower(name), 'st.', 'saint'), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'inc', 'llc', 'corp', 'corporation', 'co', 'the', 'of', 'and', 'dba', 'ltd')), ' ') AS return_name,
  regexp_replace(replace(replace(replace(lower(name), 'st.', 'saint'), 'ctr', 'center'), 'med ', 'medical '), '[^a-z0-9 ]', ' ', 'g') AS bill_name,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '\b(p\.?a\.?|p\.?c\.?|l\.?l\.?c\.?|l\.?l\.?p\.?|inc\.?|ltd\.?|corp\.?|co\.?)\b', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS payee_name,
  CASE WHEN length(num) BETWEEN 8 AND 9 THEN lpad(num, 9, '0') END AS ein,
  CASE WHEN length(num) BETWEEN 1 AND 9 THEN lpad(num, 9, '0') END AS return_ein,
  CASE WHEN length(num) > 5 THEN left(lpad(num, 9, '0'), 5) ELSE lpad(num, 5, '0') END AS zip5,
  CASE WHEN length(num) < 6 THEN lpad(num, 6, '0') ELSE num END AS ccn FROM s""")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name, number and code forms that sources are matched by."""
    name = F.concat(F.lit("St. "), F.col("s_name"), F.lit(" Med Ctr, Inc."))
    num = (F.col("s_suppkey") * 137).cast("string")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", n.crosswalk_name(name).alias("crosswalk_name"), n.return_name(name).alias("return_name"), n.bill_name(name).alias("bill_name"),
        n.payee_name(name).alias("payee_name"), n.ein(num).alias("ein"), n.ein_of_return(num).alias("return_ein"), n.zip5(num).alias("zip5"), n.ccn(num).alias("ccn"),
    )


@query(r"""
WITH h AS (SELECT page_id, url, regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)', 1), '^www\.', '') AS host FROM pages)
SELECT page_id, host, array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - 1, 1):], '.') AS domain,
  regexp_replace(regexp_replace(regexp_replace(lower(url), '^http://', 'https://'), '^(https://)www\.', '\1'), '/+$', '') AS same_url FROM h""")
def normalised_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, registered domains and one form for equal addresses."""
    return table(spark, sf_dir, "pages").select("page_id", n.host("url").alias("host"), n.registered_domain("url").alias("domain"), n.same_url("url").alias("same_url"))


@query(r"""
SELECT doc_id, array_to_string(list_filter(list_value(
  CASE WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') THEN 'ssn' END,
  CASE WHEN regexp_matches(text, '(?i)\b(?:acct|account|mrn|guarantor)\b[^\n]{0,20}?\d{5,}') THEN 'account_number' END,
  CASE WHEN regexp_matches(text, '\b\d{9,}\b') THEN 'long_number' END,
  CASE WHEN regexp_matches(text, '(?i)\b(?:dob|date of birth|birth ?date)\b') THEN 'date_of_birth' END,
  CASE WHEN regexp_matches(text, '(?i)\b(?:patient(?: name)?|name|guarantor)\s*:\s*[A-Z][a-z]+|\bdear\s+(?:mr|mrs|ms|dr)\b') THEN 'patient_name' END), lambda x: x IS NOT NULL), ',') AS hits FROM documents""")
def personal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which patterns of personal texts a document has."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(n.personal_hits("text"), ",").alias("hits"))


@query("SELECT sha256(coalesce(text, '')) AS sha, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def sha_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies."""
    return corpus.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


NAMED = r"""regexp_matches(replace(lower(regexp_replace({t}, '\[[^\]]*\]\(\s*<?[^\s<>()"]+>?(?:\s+"[^"]*")?\s*\)', ' ', 'g')), '_', '-'),
  'financial assistance|financial-assistance|financialassistance|charity|billing and collection|billing-and-collection|(^|[^a-z0-9])fap($|[^a-z0-9])')"""
SAID = r"regexp_replace(html, '<[^>]*>|\s+', ' ', 'g')"


def _shells_sql(text: str) -> str:
    return rf"""
WITH w AS (SELECT url, sha256(trim({text})) AS sha, {NAMED.format(t=text)} AS named FROM pages WHERE NOT regexp_matches(url, '(?i)^[^?#]*\.pdf([?#].*)?$')),
g AS (SELECT sha FROM w GROUP BY 1 HAVING count(DISTINCT url) > 1 AND NOT bool_or(named)) SELECT DISTINCT url FROM w WHERE sha IN (SELECT sha FROM g)"""


@query(_shells_sql(SAID))
def navigation_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses whose pages say the same apart from markup and spacing, and don't name assistance anywhere."""
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_replace("html", r"<[^>]*>|\s+", " ").alias("said"))
    return corpus.navigation_shells(pages, "url", "said")


@query(_shells_sql("html"))
def whole_page_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that answer with the same whole page, and don't name assistance anywhere in it."""
    return corpus.navigation_shells(table(spark, sf_dir, "pages"), "url", "html")


@query(r"""
WITH p AS (SELECT item_id, text AS phrase FROM benchmark WHERE length(text) >= 12)
SELECT doc_id, item_id AS phrase_id FROM documents JOIN p ON contains(text, phrase)""")
def quotes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark passages, word for word."""
    return corpus.phrases_found(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(r"""
SELECT doc_id, regexp_matches(replace(text, ',', ''), '(^|[^\d.])' || CAST(doc_id % 90 + 10 AS VARCHAR) || '(\.0+)?(\.?$|[^\d.]|\.[^\d])') AS stated FROM documents""")
def numbers_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document states a number of its own."""
    return table(spark, sf_dir, "documents").select("doc_id", corpus.number_stated("text", (F.col("doc_id") % 90 + 10)).alias("stated"))


def _votes_sql() -> str:
    lists = {lang: ", ".join(f"'{w}'" for w in words.split()) for lang, words in corpus.COMMON_WORDS.items()}
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN ({words}))) AS votes_{lang}" for lang, words in lists.items())
    most = ", ".join(f"votes_{lang}" for lang in corpus.COMMON_WORDS if lang != "english")
    return rf"""WITH p AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '!\[[^\]]*\]\([^)]*\)|\]\([^)]*\)|https?://\S+|www\.\S+', ' ', 'g') AS t FROM documents),
d AS (SELECT doc_id, len(regexp_extract_all(t, '[a-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{24f}}\x{{1e00}}-\x{{1eff}}]')) AS latin, len(regexp_extract_all(t, '[\p{{L}}\p{{Nl}}\p{{No}}]')) AS letters,
  len(regexp_extract_all(t, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{ac00}}-\x{{d7af}}]')) AS dense, regexp_extract_all(t, '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS w FROM p),
v AS (SELECT doc_id, latin, letters - latin + dense AS other, {counts} FROM d)
SELECT *, NOT (other > 0 AND other >= 0.4 * (latin + other)) AND NOT (greatest({most}) >= 3 AND greatest({most}) > votes_english) AS english FROM v"""


@query(_votes_sql())
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words by language and whether a text reads as English."""
    return corpus.language_votes(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("english", corpus.reads_as_english())


@query("""
SELECT CASE WHEN a.url IS NULL THEN b.url ELSE a.url END AS url, CASE WHEN b.url IS NULL THEN 'unreachable' WHEN a.url IS NULL THEN 'new' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS outcome
FROM (SELECT url, sha256(html) AS h FROM pages WHERE page_id % 10 <> 0) a FULL JOIN
     (SELECT url, CASE WHEN page_id % 4 = 0 THEN sha256(html || '!') ELSE sha256(html) END AS h FROM pages WHERE page_id % 10 <> 1) b ON a.url = b.url""")
def refresh_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second fetch says about every address."""
    pages = table(spark, sf_dir, "pages")
    old = pages.where("page_id % 10 <> 0").select("url", F.sha2("html", 256).alias("h"))
    changed = F.when(F.col("page_id") % 4 == 0, F.sha2(F.concat("html", F.lit("!")), 256)).otherwise(F.sha2("html", 256))
    return corpus.refresh(old, pages.where("page_id % 10 <> 1").select("url", changed.alias("h")), "url", "h")


@query("""
WITH s AS (SELECT doc_id, 'empty' AS reason, 1 AS k FROM documents WHERE n_chars < 200 UNION ALL SELECT doc_id, 'translation', 2 FROM documents WHERE lang <> 'en'
  UNION ALL SELECT doc_id, 'repeat', 3 FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS c FROM documents) WHERE c > 1)
SELECT doc_id, arg_min(reason, k) AS reason FROM s GROUP BY 1""")
def set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set aside, each with the first reason that holds."""
    docs = table(spark, sf_dir, "documents")
    first = corpus.exact_duplicates(docs, "doc_id", "text").select("sha", "first_id")
    repeats = docs.select("doc_id", F.sha2("text", 256).alias("sha")).join(first, "sha").where("doc_id <> first_id").select("doc_id")
    stages = [("empty", docs.where("n_chars < 200").select("doc_id")), ("translation", docs.where("lang <> 'en'").select("doc_id")), ("repeat", repeats)]
    return corpus.set_aside_first(docs.select("doc_id"), ["doc_id"], stages)


@query(r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[\x20\x09-\x0D]+')) AS w, generate_subscripts(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), 1) - 1 AS pos FROM documents),
m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 10 THEN 0 ELSE 1 END AS fresh FROM w WHERE regexp_matches(w, '^(that|que|nicht)$')),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT doc_id, greatest(min(pos) - 5, 0) AS start, max(pos) + 5 AS end FROM r GROUP BY doc_id, run""")
def keyword_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of words around a keyword, merged where they overlap."""
    return corpus.passages(table(spark, sf_dir, "documents"), "doc_id", "text", "^(that|que|nicht)$", 5)


@query()
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text."""
    return table(spark, sf_dir, "pages").select("page_id", t.html_text_of("html", "url").alias("text"))


@query()
def quotes_found_loosely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes cut from documents, with their spacing changed, found again in the same documents; short ones hold none."""
    docs = table(spark, sf_dir, "documents")
    quote = F.replace(F.substring("text", 20, 60), F.lit(" "), F.lit("  "))
    return docs.select("doc_id", t.quote_found_of(quote, F.col("text")).alias("found"))


@query()
def budgeted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is kept under a budget of characters: its begin and windows around words, rarest list first."""
    docs = table(spark, sf_dir, "documents").withColumn("spans", p.spans_of("text", ("password|token|license", "benchmark|@", r"\b(?:that|que|nicht)\b"), limit=4000, head=600, radius=150))
    kept = p.selected(F.col("text"), F.col("spans"))
    return docs.select("doc_id", F.size("spans").alias("n_passages"), F.length(kept).alias("n_kept"), F.sha2(kept, 256).alias("kept_sha256"))
