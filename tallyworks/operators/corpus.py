"""Document corpora: what is set aside, what is found in what, and what language it reads as."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.functions.text import compatible

# Words by which a page's prose names assistance, a word that does alone, and links, which are no prose.
ASSISTANCE = ["financial assistance", "financial-assistance", "financialassistance", "charity", "billing and collection", "billing-and-collection"]
ASSISTANCE_WORD = "(?<![a-z0-9])fap(?![a-z0-9])"
MARKDOWN_LINK = r'(?<!!)\[([^\]]*)\]\(\s*<?([^\s<>()"]+)>?(?:\s+"[^"]*")?\s*\)'
#: Characters of a page that is no menu.
THIN_CHARS = 1000
PDF = r"(?i)^[^?#]*\.pdf(?:[?#].*)?$"
MIN_QUOTE = 12
#: Character runs that a task hands on at once.
GRAMS = 1 << 16
# Common words of languages, and what has no language: targets of links, images and bare addresses.
COMMON_WORDS = {
    "english": (
        "the and of to is are for with you your will be this that by if may not from have has which who our it all any can must their they we would should than "
        "been were was its such these those"
    ),
    "spanish": "que y para por con una usted su sus se como más este esta son pueden puede cuando también sobre ser",
    "tagalog": "ang ng mga sa ay kung ito hindi ninyo iyong nito sila siya upang dahil kapag lamang",
    "german": "der die das und ist nicht mit von zu den dem ein eine einen für auf sind oder wird werden bei auch nach wenn dass kann ihre",
    "portuguese": "que em uma um não ao é são seu sua ou pelo pela também você",
    "french": "les et une pour dans qui sur par vous votre vos cette sont être avec aux",
    "vietnamese": "của và là có được cho các những không một trong với người này để khi theo từ tài chính hỗ trợ đơn",
    "polish": "nie się jest oraz lub dla przez który która które jeśli może są być jako tym pomocy finansowej",
    "hmong": "kev pab nyiaj koj yuav thiab rau ntawm uas muaj cov tsis yog hauv txog neeg",
    "haitian_creole": "pou nan yo ki li gen sou oswa lè fè kote avèk epi konsa sèvis pasyan",
    "italian": "che della delle degli dei sono questo questa gli nel nella alla sulla anche più può assistenza finanziaria",
    "albanian": "dhe të në për nga një është janë që ose nuk kjo ky tyre ndihma financiare",
    "bosnian": "je su za koji koja koje ili ako može nije biti kao pomoć",
}
LINK_TARGETS = r"!\[[^\]]*\]\([^)]*\)|\]\([^)]*\)|https?://\S+|www\.\S+"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
LATIN = r"[a-z]+|[a-z\u00c0-\u024f\u1e00-\u1eff]+"
DENSE_SCRIPT = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af]"
#: Share of letters of another script, and number of common words, that make a text no English one.
OTHER_SCRIPT_SHARE, FOREIGN_WORDS = 0.4, 3


def is_pdf(url: str | Column) -> Column:
    return (F.col(url) if isinstance(url, str) else url).rlike(PDF)


def names_assistance(text: str | Column) -> Column:
    """Whether the prose of a page, its text outside links, names financial assistance."""
    prose = F.replace(F.lower(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), MARKDOWN_LINK, " ")), F.lit("_"), F.lit("-"))
    said = prose.rlike(ASSISTANCE_WORD)
    for words in ASSISTANCE:
        said = said | F.contains(prose, F.lit(words))
    return said


def _length(text: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\r\x0b\x0c")))


def thin(url: str, text: str) -> Column:
    """Whether a page was read but is mostly its menu; PDFs are what they are, and empty texts are no pages."""
    return (_length(text) > 0) & (_length(text) < THIN_CHARS) & ~is_pdf(url)


def usable(url: str, text: str) -> Column:
    """Whether a download may be kept: a PDF, a page that isn't thin, or one whose prose names assistance."""
    return F.coalesce(is_pdf(url), F.lit(False)) | (_length(text) >= THIN_CHARS) | names_assistance(text)


def navigation_shells(pages: DataFrame, url: str, text: str) -> DataFrame:
    """(url) of pages, PDFs aside, that share their text with another address and never name assistance."""
    web = pages.where(~is_pdf(url)).select(F.col(url).alias("url"), F.sha2(F.trim(text), 256).alias("sha"), names_assistance(text).alias("named"))
    groups = web.groupBy("sha").agg(F.count_distinct("url").alias("n"), F.bool_or("named").alias("named")).where("n > 1 and not named")
    return web.join(groups.select("sha"), "sha", "left_semi").select("url").distinct()


def exact_duplicates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(sha, first id, copies) of each different text."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha")).agg(F.min(doc_id).alias("first_id"), F.count("*").alias("copies"))


def refresh(old: DataFrame, new: DataFrame, url: str, sha: str) -> DataFrame:
    """(url, outcome) of a second fetch: unchanged, changed, unreachable or new."""
    a = old.select(F.col(url).alias("url"), F.col(sha).alias("a"))
    b = new.select(F.col(url).alias("url"), F.col(sha).alias("b"))
    outcome = F.when(F.col("b").isNull(), "unreachable").when(F.col("a").isNull(), "new").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return a.join(b, "url", "full").select("url", outcome.alias("outcome"))


def _grams(rows: DataFrame) -> DataFrame:
    """(__d, __w) of the distinct runs of MIN_QUOTE characters of each text in (__d, __t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            grams: list[str] = []
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                found = {text[k : k + MIN_QUOTE] for k in range(len(text) - MIN_QUOTE + 1)}
                grams += found
                at += [i] * len(found)
                if len(grams) >= GRAMS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(grams, pa.string())], ["__d", "__w"])
                    at, grams = [], []

    return rows.select("__d", "__t").mapInArrow(run, T.StructType([rows.schema["__d"], T.StructField("__w", T.StringType())]))


def phrases_found(docs: DataFrame, doc_id: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str) -> DataFrame:
    """(doc_id, phrase_id) where a document holds a phrase.

    Both sides meet on the phrase's rarest-looking word, its longest, so that the work grows with the words of the
    corpus and not with documents times phrases; what meets is checked on the text. Phrases without a word between
    white space meet the texts on their first MIN_QUOTE characters; shorter phrases are never found.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    probe = phrases.where(F.length(phrase) >= MIN_QUOTE).select(F.col(phrase_id).alias("__p"), F.col(phrase).alias("__phrase"))
    # the first and last words of a phrase may be parts of words in the text
    inner = F.regexp_extract_all(F.col("__phrase"), F.lit(r"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]+(?=[\x20\x09-\x0D])"), F.lit(0))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    probe = probe.withColumn("__w", longest["w"])
    rows = docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("__t"))
    met = rows.select("__d", F.explode(words("__t")).alias("__w")).join(probe.select("__p", "__w"), "__w").select("__d", "__p").distinct()
    wordless = probe.where(F.col("__w").isNull()).select("__p", F.substring("__phrase", 1, MIN_QUOTE).alias("__w"))
    if not wordless.isEmpty():
        met = met.unionByName(_grams(rows).join(wordless, "__w").select("__d", "__p").distinct())
    checked = met.join(rows, "__d").join(probe.select("__p", "__phrase"), "__p").where(F.expr("contains(__t, __phrase)"))
    return checked.select(F.col("__d").alias("doc_id"), F.col("__p").alias("phrase_id"))


def number_stated(text: str | Column, number: str | Column) -> Column:
    """Whether a text states a number itself: never inside a longer number, trailing zeros allowed."""
    t = F.replace(F.col(text) if isinstance(text, str) else text, F.lit(","), F.lit(""))
    n = (F.col(number) if isinstance(number, str) else number).cast("string")
    zeros = F.when(n.contains("."), F.lit("0*")).otherwise(F.lit(r"(?:\.0+)?"))
    return F.rlike(t, F.concat(F.lit(r"(?<![\d.])"), F.replace(n, F.lit("."), F.lit(r"\.")), zeros, F.lit(r"(?!\.?\d)")))


def language_votes(docs: DataFrame, doc_id: str, text: str, *kept: str) -> DataFrame:
    """(doc_id, latin, other, votes by language): letters of the Latin and of other scripts, and common words of each language.

    Links' targets, images and addresses are left out; Han, kana and Hangul count twice. Every occurrence counts, a
    word for all languages that have it, and nothing is shuffled. A null text has none. Columns ``kept`` follow.
    """
    kept = {f"__{c}": F.col(c) for c in kept}
    out = docs.select(F.col(doc_id).alias("doc_id"), F.lower(compatible(F.coalesce(F.col(text), F.lit("")))).alias("t"), *[c.alias(k) for k, c in kept.items()])
    linked = F.contains("t", F.lit("](")) | F.contains("t", F.lit("://")) | F.contains("t", F.lit("www."))
    out = out.withColumn("t", F.when(linked, F.regexp_replace("t", LINK_TARGETS, " ")).otherwise(F.col("t"))).withColumn("w", F.regexp_extract_all("t", F.lit(f"{LETTER}+"), F.lit(0)))
    # words of no list are dropped once, not once a language; all letters are in words
    every = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
    out = out.select("doc_id", *kept, F.array_join("w", "").alias("letters"), F.regexp_count("t", F.lit(DENSE_SCRIPT)).cast("long").alias("dense"), F.filter("w", lambda w: w.isin(every)).alias("w"))
    out = out.withColumn("others", F.length(F.regexp_replace("letters", LATIN, "")).cast("long"))
    counts = [F.size(F.filter("w", _common(lang))).cast("long").alias(f"votes_{lang}") for lang in COMMON_WORDS]
    latin = F.length("letters").cast("long") - F.col("others")
    return out.select("doc_id", latin.alias("latin"), (F.col("others") + F.col("dense")).alias("other"), *counts, *[F.col(k).alias(k[2:]) for k in kept])


def _common(lang: str):
    return lambda w: w.isin(COMMON_WORDS[lang].split())


def reads_as_english() -> Column:
    """English, by ``language_votes``, unless other scripts have OTHER_SCRIPT_SHARE of the letters, or common words of
    another language, FOREIGN_WORDS at least, outnumber its own. A table of figures or a list of names is nobody's."""
    foreign = F.greatest(*[F.col(f"votes_{lang}") for lang in COMMON_WORDS if lang != "english"])
    script = (F.col("other") > 0) & (F.col("other") >= OTHER_SCRIPT_SHARE * (F.col("latin") + F.col("other")))
    return ~script & ~((foreign >= FOREIGN_WORDS) & (foreign > F.col("votes_english")))


def set_aside_first(docs: DataFrame, key: list[str], stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, reason): the first stage whose keys hold a document; each stage sees only what earlier ones left."""
    rest, out = docs, None
    for reason, hit in stages:
        got = rest.join(hit.select(*key).distinct(), key, "left_semi").select(*key, F.lit(reason).alias("reason"))
        out = got if out is None else out.unionByName(got)
        rest = rest.join(hit.select(*key), key, "left_anti")
    return out


def passages(docs: DataFrame, doc_id: str, text: str, keyword: str, reach: int) -> DataFrame:
    """(doc_id, start, end) of the text within ``reach`` words of a keyword, overlapping stretches merged.

    Word positions of matches are rows; a stretch ends where the next match is further away than both reaches.
    """
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    at = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(words).alias("pos", "w")).where(F.col("w").rlike(keyword))
    w = Window.partitionBy("doc_id").orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(w) > 2 * reach, F.lit(True))
    runs = at.withColumn("run", F.sum(fresh.cast("int")).over(w))
    return runs.groupBy("doc_id", "run").agg(F.greatest(F.min("pos") - reach, F.lit(0)).alias("start"), (F.max("pos") + reach).alias("end")).drop("run")
