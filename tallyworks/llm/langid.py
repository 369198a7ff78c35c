"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to ORDER bytes with the counts of the bytes that follow. A byte's
code length is that of its probability in the longest context known, each shorter context being reached by an
escape (method C: as many escapes as the context has different followers). The statistics are frozen, so a text's
code length is a sum over its bytes; the language with the shortest code wins.

Counting is one pass with sums that are combined before a shuffle, into a table. The trees are cut by the byte before
the last: all contexts that end in it, of every order, are in one part. A part of at most PART counts at a time goes
to every task, where one sorted lookup per byte gives the code lengths in all languages at once; texts are gone through
once a part, each byte with the one part that has its contexts, and the parts' code lengths are added. What the driver
and a task hold doesn't grow with the counts, only the number of parts does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import crc_bucket, materialise, row_key

FOLDS, HELD = 3, 1
ORDER = 3
SLICE = 1 << 20
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 1 << 21
#: Counts (of a language and a string) of a part, but for those of one byte.
PART = 4_000_000
LETTER = re.compile(r"[^\W\d_]")


def strings_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(string, text number) of every byte: the byte with the ORDER bytes before it, NULs before the start."""
    pad = b"\0" * ORDER
    flat = np.frombuffer(pad + pad.join(texts) if texts else pad, np.uint8).astype(np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = ORDER + np.concatenate([[0], np.cumsum(lengths[:-1] + ORDER)]).astype(np.int64) if texts else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    out = flat[at]
    for k in range(1, ORDER + 1):
        out |= flat[at - k] << np.uint32(8 * k)
    return out, of


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about SLICE bytes, each with the number of its first text; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _merge(a: tuple[np.ndarray, np.ndarray] | None, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.unique(strings, return_counts=True)
    if a is None:
        return key, n
    both, where = np.unique(np.concatenate([a[0], key]), return_inverse=True)
    return both, np.bincount(where, weights=np.concatenate([a[1], n])).astype(np.int64)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for lang, (key, n) in held.items():
            yield pd.DataFrame({"lang": lang, "string": key.astype(np.int64), "n": n})
        held.clear()

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            for _, part in _slices([t.encode("utf-8", "surrogatepass") for t in texts]):
                held[lang] = _merge(held.get(lang), strings_of(part)[0])
        if sum(len(k) for k, _ in held.values()) > HELD_COUNTS:
            yield from flush()
    yield from flush()


@dataclass
class Trees:
    """Code lengths in bits. For each order, sorted strings with one column a language, and contexts with escapes."""

    langs: list[str]
    strings: list[np.ndarray] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def grow(counts: dict[str, tuple[np.ndarray, np.ndarray]], single: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> Trees:
        """From each language's strings of ORDER + 1 bytes and their counts.

        ``single``, the languages' bytes and their counts, is needed where the strings are only a part; languages that it
        has and the part lacks are known all the same.
        """
        trees, part = Trees(sorted(single or counts)), counts
        for order in range(ORDER + 1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            counts = single if single is not None and order == 0 else {x: part.get(x, none) for x in trees.langs}
            tails = {x: counts[x][0] & mask for x in trees.langs}
            strings = np.unique(np.concatenate([*tails.values()])) if tails else np.zeros(0, np.uint32)
            contexts = np.unique(strings >> np.uint32(8))
            lengths = np.full((len(strings), len(trees.langs)), np.nan)
            escapes = np.zeros((len(contexts), len(trees.langs)))
            for c, lang in enumerate(trees.langs):
                n = np.bincount(np.searchsorted(strings, tails[lang]), weights=counts[lang][1], minlength=len(strings))
                of = np.searchsorted(contexts, strings >> np.uint32(8))
                total = np.bincount(of, weights=n, minlength=len(contexts))
                kinds = np.bincount(of, weights=n > 0, minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    lengths[:, c] = np.where(n > 0, np.log2((total + kinds)[of] / n), np.nan)
                    escapes[:, c] = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            lower = trees.code_lengths(strings & (mask >> np.uint32(8)), order - 1)
            missing = np.isnan(lengths)
            lengths[missing] = (escapes[np.searchsorted(contexts, strings >> np.uint32(8))] + lower)[missing]
            trees.strings.append(strings)
            trees.bits.append(lengths)
            trees.contexts.append(contexts)
            trees.escapes.append(escapes)
        return trees

    def code_lengths(self, strings: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each string's last byte after the bytes before it, one column a language."""
        if order < 0:
            return np.full((len(strings), len(self.langs)), 8.0)
        known, contexts = self.strings[order], self.contexts[order]
        at = np.minimum(np.searchsorted(known, strings), len(known) - 1)
        out = self.bits[order][at]
        miss = np.flatnonzero(known[at] != strings)
        if len(miss):
            rest = strings[miss]
            mask = np.uint32((1 << (8 * order)) - 1)
            to = np.minimum(np.searchsorted(contexts, rest >> np.uint32(8)), len(contexts) - 1)
            escape = np.where((contexts[to] == rest >> np.uint32(8))[:, None], self.escapes[order][to], 0.0)
            out[miss] = escape + self.code_lengths(rest & mask, order - 1)
        return out

    def totals(self, texts: list[bytes], after: np.ndarray | None = None) -> np.ndarray:
        """Code length of each text in each language; of the bytes after one of ``after`` (256 flags) alone if given."""
        out = np.zeros((len(texts), len(self.langs)))
        for first, part in _slices(texts):
            strings, of = strings_of(part)
            if after is not None:
                own = after[(strings >> np.uint32(8)) & np.uint32(255)]
                strings, of = strings[own], of[own]
            for at in range(0, len(strings), SLICE):
                bits, rows = self.code_lengths(strings[at : at + SLICE]), of[at : at + SLICE]
                for c in range(len(self.langs)):
                    out[first : first + len(part), c] += np.bincount(rows, weights=bits[:, c], minlength=len(part))
        return out


def counted(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(lang, string, n) over all documents with text and language outside the held-out fold."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_bucket("doc_id", folds) != held))
    counts = known.select("lang", "text").mapInPandas(_counts, "lang string, string long, n long")
    return counts.groupBy("lang", "string").agg(F.sum("n").alias("n"))


def _by_language(rows: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {x: (g["string"].to_numpy(np.uint32), g["n"].to_numpy(np.int64)) for x, g in rows.groupby("lang")}


def train(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> Trees:
    """All trees at once, for corpora whose counts fit the driver; ``classify`` takes them in parts."""
    return Trees.grow(_by_language(counted(docs, folds, held).toPandas()))


def parts_of(counts: DataFrame, most: int = PART) -> list[list[int]]:
    """Bytes in runs whose strings, those with the byte before the last, have at most ``most`` counts together; a byte with more is alone."""
    before = F.shiftright("string", 8).bitwiseAND(F.lit(255))
    sizes = counts.groupBy(before.alias("byte")).agg(F.count("*").alias("n")).orderBy("byte").collect()  # 256 rows at most
    parts, room = [], 0
    for r in sizes:
        if not parts or r["n"] > room:
            parts.append([])
            room = most
        parts[-1].append(r["byte"])
        room -= r["n"]
    return parts


def _bits_of(docs: DataFrame, trees: Trees, after: list[int] | None, text: str, out: str) -> DataFrame:
    """Adds ``out``, the code length of each text in each of the trees' languages; null for texts without a letter."""
    flags = None if after is None else np.isin(np.arange(256), after)
    model = docs.sparkSession.sparkContext.broadcast((trees, flags))  # at most a part

    @F.pandas_udf("array<double>")
    def bits(texts: pd.Series) -> pd.Series:
        trees, flags = model.value
        seen = [t is not None and LETTER.search(t) is not None for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") if s else b"" for t, s in zip(texts, seen, strict=True)]
        found = trees.totals(raw, flags)
        return pd.Series([b if s else None for b, s in zip(found, seen, strict=True)], dtype=object)

    return docs.withColumn(out, bits(F.col(text)))


def _verdict(bits: Column, langs: list[str]) -> Column:
    """struct(lang, score): the first language of the least code length, and its share by code length."""
    least = F.array_min(bits)
    share = 1 / F.aggregate(bits, F.lit(0.0), lambda s, b: s + F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), least - b)))
    known = F.get(F.array(*map(F.lit, langs)), F.array_position(bits, least).cast("int") - 1)
    return F.when(bits.isNotNull(), F.struct(known.alias("lang"), share.alias("score"))).otherwise(F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))


def with_language(docs: DataFrame, trees: Trees, text: str = "text", out: str = "language") -> DataFrame:
    """Add a struct (lang, score) of every text; an existing column of that name is replaced, all others stay."""
    if not trees.langs:
        return docs.withColumn(out, _nothing())
    return _bits_of(docs, trees, None, text, "__bits").withColumn(out, _verdict(F.col("__bits"), trees.langs)).drop("__bits")


def _nothing() -> Column:
    return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))


def with_learned_language(docs: DataFrame, counts: DataFrame, text: str = "text", out: str = "language", part: int = PART) -> DataFrame:
    """``with_language`` by the trees of a table of counts, a part of them after the other.

    Code lengths of parts are written for each row (by id and text), added, and joined to the rows; of a single part
    they are not.
    """
    parts = parts_of(counts, part)
    if not parts:
        return docs.withColumn(out, _nothing())
    byte = F.col("string").bitwiseAND(F.lit(255))
    single = _by_language(counts.groupBy("lang", byte.alias("string")).agg(F.sum("n").alias("n")).toPandas())  # 256 rows a language at most
    langs = sorted(single)
    before = F.shiftright("string", 8).bitwiseAND(F.lit(255))

    def trees(own: list[int]) -> Trees:
        return Trees.grow(_by_language(counts.where(before.isin(own)).toPandas()), single)

    if len(parts) == 1:
        scored = _bits_of(docs, trees(parts[0]), None, text, "__bits")
        return scored.withColumn(out, _verdict(F.col("__bits"), langs)).drop("__bits")
    rows = docs.withColumn("__row", row_key("doc_id", text))
    each = [materialise(_bits_of(rows.select("__row", text), trees(own), own, text, "__bits").select("__row", "__bits").dropDuplicates(["__row"])) for own in parts]
    bits = each[0]
    for more in each[1:]:
        more = more.withColumnRenamed("__bits", "__more")
        bits = bits.join(more, "__row").select("__row", F.zip_with("__bits", "__more", lambda a, b: a + b).alias("__bits"))
    return rows.join(bits, "__row", "left").withColumn(out, _verdict(F.col("__bits"), langs)).drop("__row", "__bits")


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing could be
    learned. Equal code lengths go to the first language by code point. A null id is in no fold: never held out,
    never learned from. Repeated rows each come back and count each; other columns are not read.
    """
    found = with_learned_language(docs.select("doc_id", "text"), materialise(counted(docs)))
    held = F.coalesce(crc_bucket("doc_id", FOLDS) == HELD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
