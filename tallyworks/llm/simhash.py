"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A ball is a fingerprint with all its variants within half the radius, rounded down to HALF = 1 bit. Fingerprints are
cut into three blocks of 21, 21 and 22 bits. Of at most RADIUS = 3 different bits, some two blocks hold at most two
(at worst each block holds one), so on the 42 or 43 bits of those two blocks the balls of two linked fingerprints
meet in the middle. Every distinct fingerprint emits the balls of its three pairs of blocks, 131 rows; the rows are
shuffled on (pair, variant), and fingerprints that meet are verified on all 64 bits. Copies share a fingerprint and
are one node, so they cost nothing here.

``links(..., whole=True)`` takes balls around all 64 bits instead. There distances of 1 and 3 only join fingerprints
of opposite parity, so odd ones emit the ball of two bits (2,081 rows) and even ones that of one bit (65), and the
links are the same; the README has its figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.llm.blocks import block_pairs, roots
from tallyworks.llm.common import connected_components, join_skewed, materialise

RADIUS = 3
#: Bits of the two lower blocks; the third has the rest.
BITS = 21
SHINGLE = 3
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """SimHash of a text's 3-word shingles as an unsigned 64-bit integer; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both on ASCII alone
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(at, upto)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprint_of(text: str | Column) -> Column:
    """The fingerprint as a signed long; ``hex_of`` prints it."""
    return _fingerprints(F.col(text) if isinstance(text, str) else text)


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _verify(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in groups:
        u, v = [], []
        for members in batch["members"]:
            x = np.asarray(members, np.int64)
            bits = x.view(np.uint64)
            root = roots(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS)
            away = root != np.arange(len(x))
            u.append(x[away])
            v.append(x[root[away]])
        yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})


def _flips(bits: int) -> Column:
    """All masks of at most one of ``bits`` bits."""
    one = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.concat(F.array(F.lit(0).cast("long")), one)


def block_balls(fp: str = "fp") -> Column:
    """The variants of the three pairs of blocks, the pair's number above the variant's bits."""
    low = (1 << BITS) - 1
    x, high = F.col(fp), F.shiftrightunsigned(fp, 2 * BITS)
    pairs = (
        (x.bitwiseAND(F.lit((1 << 2 * BITS) - 1)), 2 * BITS),
        (F.shiftrightunsigned(fp, BITS), 64 - BITS),
        (x.bitwiseAND(F.lit(low)).bitwiseOR(F.shiftleft(high, BITS)), 64 - BITS),
    )

    def ball(no: int, part: Column, bits: int) -> Column:
        return F.transform(_flips(bits), lambda m: part.bitwiseXOR(m).bitwiseOR(F.lit(no << 60)))

    return F.concat(*[ball(no, *pair) for no, pair in enumerate(pairs)])


def whole_balls(fp: str = "fp") -> Column:
    """The variants of a whole fingerprint: within two bits if it has an odd number of ones, else within one."""
    one = F.transform(_flips(64), lambda m: F.col(fp).bitwiseXOR(m))
    two = F.array_distinct(F.flatten(F.transform(_flips(64), lambda m: F.transform(_flips(64), lambda k: F.col(fp).bitwiseXOR(m).bitwiseXOR(k)))))
    return F.when(F.bit_count(fp) % 2 == 1, two).otherwise(one)


def links(fps: DataFrame, whole: bool = False) -> DataFrame:
    """Links (u, v) that span the near-duplicate components of the distinct fingerprints in column ``fp``."""
    balls = whole_balls() if whole else block_balls()
    # the table of fingerprints is small beside what it becomes
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = block_pairs(spread.select("fp", F.explode(balls).alias("bucket")), ["bucket"], "fp")
    groups = met.groupBy("bucket", "left", "right").agg(F.collect_list("fp").alias("members"))
    return groups.where("size(members) > 1").select("members").mapInPandas(_verify, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of (doc_id, text).

    ``component_id`` is the least doc_id that links of at most RADIUS bits reach, the row's own included. Null and
    empty texts, and texts of white space alone, have fingerprint zero and link with each other like any others;
    texts of fewer than three words are one shingle. Repeated rows each come back. Rows with a null id link like
    others but lend no id: their component is null only if no row of it has an id. Other columns are not read.
    """
    rows = materialise(docs.select("doc_id", fingerprint_of(text).alias("fp")))
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    total = rows.count()
    parts = connected_components(materialise(links(distinct.select("fp"))))
    grouped = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = materialise(grouped.select("fp", "first_id", "copies", F.coalesce("component", "fp").alias("part")))
    least = materialise(grouped.groupBy("part").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    named = materialise(join_skewed(grouped, least, ["part"], "n", total).select("fp", "component_id", "copies"))
    return join_skewed(rows, named, ["fp"], "copies", total).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the least doc_id. All columns stay.

    Of rows that share an id one stays. Rows with a null id can't be named and all stay.
    """
    found = near_duplicates(docs.select("doc_id", F.col(text).alias("text")))
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.where("doc_id is not null").join(others, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
