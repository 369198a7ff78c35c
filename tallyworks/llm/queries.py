"""The queries of this subpackage's operators, each over its whole table, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import langid, lexical, lines, media, middle, mixing, pieces, pii, quality, secrets, simhash, toxicity, vectors
from tallyworks.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms near it that disclose it."""
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.sanitise(docs))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))["documents"]
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(list_value(5, 2, 1)[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3 * CAST(source_size AS DOUBLE) AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * CAST(source_size AS DOUBLE)) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM per
  WINDOW before AS (ORDER BY 3 * CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT min_by(o.level, o.cap / o.weight) FROM ordered o WHERE o.level * o.weight <= o.cap) * weight, cap)) AS target
  FROM ordered),
placed AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, CAST(round(f.target) AS BIGINT) AS quota,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM sized d JOIN filled f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0
            ELSE quota // source_size * size + greatest(0, least(start + size, quota % source_size) - start) END AS BIGINT) AS taken
FROM placed
"""


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best segmentations, and whether the best spells the text again."""
    docs = pieces.with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.col("nbest")[0]
    docs = docs.select("doc_id", "text", best["ids"].alias("ids"), best["score"].alias("score"), F.col("nbest.score").alias("nbest_scores"))
    docs = pieces.with_text(docs)
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "ids", "nbest_scores",
        F.expr("decoded = coalesce(text, '')").alias("exact"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_wav_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a WAV file, read back, with its time-coded fingerprint and the fingerprint's digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = media.with_fingerprint(media.with_media(docs))
    wanted = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "peak_times", "peak_hashes")
    return out.select("doc_id", "n_bytes", *[F.col("fingerprint")[c].alias(c) for c in wanted])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def _op8_sql() -> str:
    """Each rule's matches with the gaps before them; a match starts where the gaps and matches before it end."""
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {no} AS kind_no, '{r.kind}' AS kind, {r.least} AS least,
        regexp_extract_all(t, '{r.regex.replace("'", "''")}') AS m, regexp_extract_all(t, '{r.regex.replace("'", "''")}', {r.group}) AS h,
        string_split_regex(t, '{r.regex.replace("'", "''")}') AS g FROM whole"""
        for no, r in enumerate(secrets.RULES)
    )
    return f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({each}),
long AS (SELECT doc_id, kind_no, kind, least, m, h, g, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
spans AS (
  SELECT doc_id, kind_no, kind,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a,
         length(m[i]) AS n
  FROM long WHERE length(h[i]) >= least),
shown AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS s FROM spans)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY a, kind_no) FILTER (kind_no < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY a, kind_no), '') AS spans
FROM documents d LEFT JOIN shown USING (doc_id) GROUP BY d.doc_id
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.classify(table(spark, sf_dir, "documents"))


def op10_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links within its label and its component."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier document has."""
    kept = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM placed),
held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
told AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.first AS dropped FROM keyed k LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
whole AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM cut),
tf AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM cut),
postings AS (SELECT doc_id, term, CAST(any_value(n) AS BIGINT) AS n, count(*) AS tf FROM tf GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
counted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
weighted AS (
  SELECT item_id, term, times, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counted JOIN df USING (term), whole),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM postings JOIN weighted USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY rank <= 20
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-the-middle order, and put back."""
    out = middle.with_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored("output", "form"), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || doc_id) AS s FROM documents),
drawn AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
         CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4
  FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(tokens[1:lo], '') AS p, array_to_string(tokens[lo + 1:hi], '') AS m, array_to_string(tokens[hi + 1:], '') AS x FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_pii": op2_pii,
        "op3_simhash": op3_simhash,
        "op4_source_mix": op4_source_mix,
        "op5_pieces": op5_pieces,
        "op6_toxicity": op6_toxicity,
        "op7_wav_fingerprint": op7_wav_fingerprint,
        "op8_secret_scan": op8_secret_scan,
        "op9_language": op9_language,
        "op10_vector_duplicates": op10_vector_duplicates,
        "op11_line_dedup": op11_line_dedup,
        "op12_ranked_search": op12_ranked_search,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mix": OP4_SQL, "op8_secret_scan": _op8_sql(), "op11_line_dedup": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
