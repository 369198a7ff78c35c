"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over the trigrams that any match must hold: alternatives
that each ask for up to ASKED trigrams. One pass cuts every text into trigrams and keeps the postings (trigram,
document) of those that some rule asks for; an alternative's postings are intersected by counting them, which gives
the candidates (document, rules), and only those run the rule's expression. Rules without a mandatory trigram scan
every document where it lies. Of the texts only candidates are shuffled, and few others that share a bit with one in a
map of the candidates' keys, however many there are.
"""

from __future__ import annotations

import re
import re._constants as c
import re._parser as parser
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import materialise, may_have, row_key


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group that holds the secret, and the least length of that group."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1

    @cached_property
    def query(self) -> frozenset[frozenset[str]]:
        """Alternatives, each a set of trigrams that a lower-cased match holds; an empty one matches anything."""
        return trigram_query(self.regex)


#: The base kinds, then further well-known token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,256}:[^\x20\x09-\x0D/:@]{1,256}@"),
)
BASE = ("assign", "access", "hex")
MOST_STRINGS = 64
#: Most trigrams that an alternative of a query asks for.
ASKED = 6


def _strings(node) -> set[str] | None:
    """All lower-cased strings that a parse node matches, if few; None if it can match others."""
    op, arg = node
    if op is c.LITERAL:
        return {chr(arg).lower()}
    if op is c.SUBPATTERN:
        return _product(arg[3])
    if op is c.BRANCH:
        each = [_product(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op is c.IN and all(k is c.LITERAL for k, _ in arg):
        return {chr(v).lower() for _, v in arg}
    if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] <= 2:
        once = _product(arg[2])
        return None if once is None else set().union(*[_times(once, n) for n in range(arg[0], arg[1] + 1)])
    return None


def _times(strings: set[str], n: int) -> set[str]:
    return {""} if n == 0 else {a + b for a in _times(strings, n - 1) for b in strings}


def _product(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def trigram_query(regex: str) -> frozenset[frozenset[str]]:
    """The Boolean trigram query of an expression, as alternatives of trigrams that must all occur.

    Neighbouring parts that match few strings are joined to runs; a match holds one string of every run.
    """
    clauses: list[set[frozenset[str]]] = []
    run: set[str] = {""}

    def close() -> None:
        each = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in each:
            clauses.append(each)

    def walk(nodes) -> None:
        nonlocal run
        for node in nodes:
            op, arg = node
            found = _strings(node)
            if found is not None and len(run) * len(found) <= MOST_STRINGS:
                run = {a + b for a in run for b in found}
                continue
            close()
            run = {""}
            if op is c.SUBPATTERN:
                walk(arg[3])
                close()
                run = {""}
            elif found is not None:
                run = found

    walk(parser.parse(regex))
    close()
    alternatives = reduce(lambda a, b: {x | y for x in a for y in b}, clauses, {frozenset()})
    return frozenset(x for x in alternatives if not any(y < x for y in alternatives))


def asked_of(query: frozenset[frozenset[str]]) -> list[list[str]]:
    """At most ASKED trigrams of each alternative, those with the fewest letters first: prose has them least."""
    return [sorted(a, key=lambda t: (sum(map(str.isalpha, t)), t))[:ASKED] for a in sorted(query, key=sorted)]


def _one_of(trigrams: list[str]) -> str:
    """An expression that finds the given trigrams at every place, overlaps included, in one pass over a text."""
    heads: dict[str, list[str]] = {}
    for t in trigrams:
        heads.setdefault(t[0], []).append(t[1:])
    each = "|".join(f"{re.escape(h)}(?:{'|'.join(map(re.escape, tails))})" for h, tails in heads.items())
    return f"(?=({each}))"


def postings(rows: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """The inverted index (trigram, key) of the trigrams that some rule's query asks for."""
    wanted = sorted({t for r in rules for a in asked_of(r.query) for t in a})
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_one_of(wanted)), F.lit(1)))
    return rows.select(key, F.explode(found).alias("trigram"))


def candidates(index: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, rules): the rules for one of whose alternatives a document is in the postings of all trigrams."""
    asks = [(r.kind, no, len(a), t) for r in rules for no, a in enumerate(asked_of(r.query)) for t in a]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(no).alias("no"), F.lit(n).alias("need"), F.lit(t).alias("trigram")) for k, no, n, t in asks])
    query = index.sparkSession.range(1).select(F.explode(rows).alias("q")).select("q.*")  # as large as the rules
    met = index.distinct().join(F.broadcast(query), "trigram").groupBy(key, "kind", "no").agg(F.count("*").alias("have"), F.first("need").alias("need"))
    return met.where("have = need").groupBy(key).agg(F.collect_set("kind").alias("rules"))


def _parts(text: str, rule: Rule) -> Column:
    """Each match with the gap before it: array of (kind, gap, whole, long enough), lengths in code points."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.regex, -1)
    return F.transform(
        F.arrays_zip(whole.alias("m"), held.alias("h"), F.slice(gaps, 1, F.size(whole)).alias("g")),
        lambda x: F.struct(
            F.lit(rule.kind).alias("kind"), F.length(x["g"]).cast("long").alias("gap"),
            F.length(x["m"]).cast("long").alias("whole"), (F.length(x["h"]) >= rule.least).alias("kept"),
        ),
    )


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of every row: spans an array of (start, kind_no, kind, end) by start, then kind as listed.

    Starts and ends are code points, ends exclusive. Matches of a kind are leftmost and don't overlap; one whose
    group is too short is dropped and not retried. Null and empty texts have no spans. Repeated rows each come back
    with the spans of their text, rows with a null id too. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__key", row_key("doc_id", "__text"))
    selective, scans = [r for r in rules if frozenset() not in r.query], [r for r in rules if frozenset() in r.query]
    found = []
    if scans:
        hit = reduce(Column.__or__, [F.col("__text").rlike(r.regex) for r in scans])
        found.append(rows.where(hit).select("__key", F.concat(*[_parts("__text", r) for r in scans]).alias("parts")))
    if selective:
        picked = materialise(candidates(postings(rows, "__key", "__text", selective), "__key", selective))
        none = F.array().cast("array<struct<kind:string,gap:bigint,whole:bigint,kept:boolean>>")
        each = [F.when(F.array_contains("rules", r.kind), _parts("__text", r)).otherwise(none) for r in selective]
        found.append(may_have(rows, picked, "__key").join(picked, "__key").select("__key", F.concat(*each).alias("parts")))
    parts = [f.where("size(parts) > 0").dropDuplicates(["__key"]) for f in found]
    long = reduce(DataFrame.unionByName, parts).select("__key", F.posexplode("parts").alias("no", "p")).select("__key", "no", "p.*")
    upto = Window.partitionBy("__key", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("whole")).over(upto)
    order = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    spans = (
        long.withColumn("end", end)
        .where("kept")
        .groupBy("__key")
        .agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("whole")).alias("start"), order.alias("kind_no"), "kind", "end"))).alias("spans"))
    )
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>")
    return rows.select("doc_id", "__key").join(spans, "__key", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    show = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_base = F.filter("spans", lambda x: x["kind"].isin(*base))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(show(of_base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))
