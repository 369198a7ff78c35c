"""Personal data, and terms that would give it away: information-theoretic sanitisation.

Protected entities are the values of e-mail addresses, IP addresses, payment cards and phone numbers in the texts.
A term t in the documents of an entity e discloses pmi(t; e) = log(p(e|t) / p(e)) of the information content
ic(e) = -log p(e), with probabilities over documents of the whole corpus. Where that share reaches ALPHA in at least
SUPPORT documents, knowing the term is as good as knowing the entity, and the term is generalised at every place of
the documents that hold the entity.

Pairs are made only for entities of at least SUPPORT documents and for terms whose counts can reach ALPHA with any
entity, both exact bounds; every count is a grouped sum over all documents, and no group is gathered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.llm.common import join_skewed, materialise, row_key, with_arrow_column

KINDS = ("email", "ip", "card", "phone")
ALPHA = 0.9
SUPPORT = 3
#: Terms that a task holds counts of before it hands them on.
HELD_TERMS = 1 << 18

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every text with personal data has, and few others; a filter that needs no Python.
MAYBE = r"@[A-Za-z0-9-]+\.|[0-9](?:\.[0-9]+){3}|\+[0-9]|[0-9](?:[\x20-]?[0-9]){12}"
TERM = re.compile(r"[^\W\d_]{2,}")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping addresses; linear, since the part before an @ is read backwards from it."""
    last = 0  # no address starts before the end of the one before, nor before an earlier @
    for m in AT.finditer(text):
        before = text[last : m.start()]
        local = len(before) - len(before.rstrip(LOCAL))
        last = m.start() + 1
        if local:
            yield m.start() - local, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four kinds, by kind as listed, then start. A match that fails its test is dropped."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if 13 <= len(m[0]) <= 38 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def entities_of(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The distinct values of the spans, each with its kind."""
    return sorted({f"{k}:{re.sub(r'[^0-9]', '', text[a:b]) if k in ('card', 'phone') else text[a:b].lower()}" for k, a, b in spans})


def terms_outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every term of the whole text that overlaps no span."""
    cover, i = sorted((a, b) for _, a, b in spans), 0
    upto = 0  # the furthest end of the spans that start before the term's end
    for m in TERM.finditer(text):
        while i < len(cover) and cover[i][0] < m.end():
            upto = max(upto, cover[i][1])
            i += 1
        if upto <= m.start():
            yield m[0].lower(), *m.span()


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii`` (array of kind, start, end) and ``entities`` (their distinct values) to each row."""
    out = T.StructType([T.StructField("pii", T.ArrayType(SPAN)), T.StructField("entities", T.ArrayType(T.StringType()))])

    @F.pandas_udf(out)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = base_spans(t or "")
            rows.append((spans, entities_of(t, spans) if spans else []))
        return pd.DataFrame(rows, columns=["pii", "entities"])

    # a filter on pii must not pull a second call of it below, which scans each text again in a Python worker of its own
    found = find.asNondeterministic()(F.col(text))
    return docs.withColumn("__found", found).select("*", "__found.pii", "__found.entities").drop("__found")


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, n): in how many rows a term stands, within spans or not, in partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "n"])
            held.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                held.update({x.lower() for x in set(TERM.findall(t.as_py() or ""))})
                if len(held) > HELD_TERMS:
                    yield flush()
        yield flush()

    return docs.select(F.col(text)).mapInArrow(run, "term string, n long")


def disclosing_terms(scanned: DataFrame, docs: DataFrame, text: str, alpha: float = ALPHA, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """((entity, term, disclosure), (doc_key, entity, term)): the terms that disclose at least ``alpha`` of an entity's
    information, and where both are in a document.

    ``scanned`` holds (doc_key, entities, text) of the documents with entities, ``docs`` all documents. Pairs are
    counted once a document, wherever the term stands outside personal data, and a term counts in every document of
    the corpus that has it.
    """
    total = docs.count()
    n = F.lit(total)
    p = F.col("n_entity") / n

    mentions = scanned.select("doc_key", F.explode("entities").alias("entity"))
    # no pair is in more documents than its entity
    of_entity = materialise(mentions.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support))
    asked = of_entity.agg(F.sum("n_entity")).first()[0] or 0
    shared = join_skewed(mentions, of_entity, ["entity"], "n_entity", asked).groupBy("doc_key").agg(F.collect_set("entity").alias("entities"))

    def work():
        return lambda texts: pa.array([sorted({x for x, *_ in terms_outside(t, base_spans(t))}) for t in texts], pa.list_(pa.string()))

    held = with_arrow_column(scanned.select("doc_key", text).join(shared, "doc_key"), text, "terms", T.ArrayType(T.StringType()), work)
    held = materialise(held.select("doc_key", "entities", "terms"))

    def pairs(terms: DataFrame) -> DataFrame:
        """(doc_key, entity, term) of the given (term, n_near)."""
        met = held.select("doc_key", "entities", F.explode("terms").alias("term"))
        met = join_skewed(met, terms.select("term", "n_near"), ["term"], "n_near", every)
        return met.select("doc_key", F.explode("entities").alias("entity"), "term")

    wanted = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    wanted = materialise(wanted.where(F.col("n_near") >= support))
    every = wanted.agg(F.sum("n_near")).first()[0] or 0
    # summed before they meet the terms asked for: a row a term, not one for each task that saw it
    of_term = term_counts(docs, text).groupBy("term").agg(F.sum("n").alias("n_term"))
    # n_both is at most n_near and n_entity, so a share of alpha needs n_term <= n_near^alpha * n^(1 - alpha)
    reaches = F.log("n_term") <= alpha * F.log("n_near") + (1 - alpha) * F.log(n) + 1e-9
    kept = materialise(wanted.join(of_term, "term").where(reaches).select("term", "n_near", "n_term"))

    pmi = F.log(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term")) / p)
    # an entity of every document has no information to disclose
    share = F.when(F.col("n_entity") < n, pmi / -F.log(p)).otherwise(0.0)
    joint = pairs(kept).groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    scored = joint.join(of_entity, "entity").join(kept, "term").select("entity", "term", "n_both", share.alias("disclosure"))
    found = materialise(scored.where(F.col("disclosure") >= alpha))
    telling = materialise(kept.join(found.select("term").distinct(), "term", "left_semi"))
    hits = found.agg(F.sum("n_both")).first()[0] or 0
    where = join_skewed(pairs(telling), found.select("entity", "term", "n_both"), ["entity", "term"], "n_both", hits)
    return found.drop("n_both"), where.select("doc_key", "entity", "term")


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(doc_key, doc_id, pii, terms) of the rows with personal data; ``terms`` are spans of kind ``term``.

    ``doc_key`` is ``row_key`` of id and text, so repeated rows share one entry. Null and empty texts, and an empty
    table, have no personal data. Rows with a null id are told apart by their texts. A term that discloses several
    entities is reported once at each place.
    """
    rows = docs.select(row_key(doc_id, text).alias("doc_key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    maybe = rows.where(F.col("__text").rlike(MAYBE))
    scanned = materialise(scan(maybe, "__text").where("size(pii) > 0").dropDuplicates(["doc_key"]))
    _, where = disclosing_terms(scanned, rows, "__text", alpha, support)
    hidden = where.groupBy("doc_key").agg(F.collect_set("term").alias("__hide"))

    @F.pandas_udf(T.ArrayType(SPAN))
    def places(texts: pd.Series, hide: pd.Series) -> pd.Series:
        out = []
        for t, terms in zip(texts, hide, strict=True):
            chosen = set(terms)
            out.append([("term", a, b) for x, a, b in terms_outside(t, base_spans(t)) if x in chosen])
        return pd.Series(out, index=texts.index, dtype=object)

    hits = scanned.select("doc_key", "__text").join(hidden, "doc_key").select("doc_key", places("__text", "__hide").alias("terms"))
    none = F.array().cast(T.ArrayType(SPAN))
    return scanned.drop("__text", "entities").join(hits, "doc_key", "left").withColumn("terms", F.coalesce("terms", none))


def digest(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each kind, the hash of the base spans and all spans as text, for every row of ``docs``."""
    key = row_key(doc_id, text)
    show = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    none = F.array().cast(T.ArrayType(SPAN))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("doc_key")).join(found.drop("doc_id"), "doc_key", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("pii", "terms")})
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(show(F.col("pii")), 256).alias("base_sha256"), show(F.concat("pii", "terms")).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with personal data and disclosing terms in ``text`` replaced by their kind in brackets.

    All other columns stay, and so do rows without personal data. Overlapping spans are replaced as one, under the
    kind of the first.
    """
    found = sanitise(docs, text, doc_id, **settings).select(F.col("doc_key").alias("__pii_key"), F.concat("pii", "terms").alias("__pii_spans"))
    found = materialise(found)  # else a task finds places in one Python worker and covers them in another

    @F.pandas_udf(T.StringType())
    def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans, strict=True):
            if t is None or found is None or not len(found):
                out.append(t)
                continue
            parts, at = [], 0
            for kind, a, b in sorted(((s["kind"], s["start"], s["end"]) for s in found), key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [t[at:a], f"[{kind}]"]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, index=texts.index, dtype=object)

    # texts that can't have any stay where they are
    maybe = F.coalesce(F.col(text).rlike(MAYBE), F.lit(False))
    hidden = docs.where(maybe).withColumn("__pii_key", row_key(doc_id, text)).join(found, "__pii_key", "left").withColumn(text, cover(text, "__pii_spans"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return hidden.select(*names).unionByName(docs.where(~maybe).select(*names))
