"""Lines that repeat across documents: hashed, counted by distinct documents, dropped, the rest put together by position.

Only a hash of a line leaves its document. A document's own row is met again by the positions that it loses, so texts
are shuffled once. Lines that stand in very many documents are joined by broadcast of their verdict (``join_skewed``)
and counted in two steps, documents first, so no key meets in one task. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import join_skewed, materialise, row_key

#: White space that a key loses at both ends.
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys have at least so many code points and stand in at least so many documents.
SHORTEST, DOCUMENTS = 10, 2


def lines_of(text: str | Column) -> Column:
    """A text's lines; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: str | Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased and no other letter."""
    key = F.trim(line, F.lit(BLANKS))
    # the built-in lower case is the same on ASCII, and much faster
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def without_repeats(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, documents: int = DOCUMENTS) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, and how many lines it had and lost (``n_lines``, ``n_dropped``).

    A key of at least ``shortest`` code points in at least ``documents`` documents keeps its lines in the smallest
    doc_id that holds it, repeats within it included, and loses all others. Rows of one doc_id are one document; null
    ids are one document that comes after all others. A null or empty text has one empty line and becomes empty; a
    text that loses all lines becomes empty. Every row comes back, repeated ones too; an empty table gives an empty
    one. Columns called n_lines or n_dropped are replaced, all others stay.
    """
    rows = docs.withColumn("__row", row_key("doc_id", text))
    lines = rows.select("__row", "doc_id", F.posexplode(lines_of(text)).alias("pos", "line")).withColumn("key", key_of("line"))
    # 128 bits: no two of 10**12 different lines share them
    lines = materialise(lines.where(F.length("key") >= shortest).select("__row", "doc_id", "pos", F.unhex(F.md5("key")).alias("key")))
    each = lines.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    held = each.groupBy("key").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"), F.sum("n").alias("n"))
    held = materialise(held.where(F.col("documents") >= documents).drop("documents"))
    found = join_skewed(lines, held, ["key"], "n", lines.count()).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    lost = found.groupBy("__row").agg(F.collect_set("pos").alias("__lost"))
    cut = rows.join(lost, "__row", "left").withColumn("__lost", F.coalesce("__lost", F.array().cast("array<int>"))).withColumn("__lines", lines_of(text))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    kept = F.array_join(F.transform(stay, lambda p: F.col("__lines")[p]), "\n")
    names = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(*names, F.size("__lines").cast("long").alias("n_lines"), F.size("__lost").cast("long").alias("n_dropped"))
