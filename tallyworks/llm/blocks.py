"""Pairwise work inside buckets, in pieces of bounded size.

The size of large buckets is estimated from every SAMPLE-th member by hash, with sums combined before the shuffle. A
bucket of an estimate over BLOCK is cut into blocks by a hash of its members before they are brought together, and
every pair of blocks becomes one row of about twice BLOCK members. So no hot bucket meets in one task, no pair becomes
a row, and every pair of the bucket is still looked at; the estimate only decides how a bucket is cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import materialise, small

BLOCK = 512
SAMPLE = 16


def block_pairs(members: DataFrame, bucket: list[str], node: str, block: int = BLOCK) -> DataFrame:
    """(bucket, ..., node) rows with ``left``, ``right`` and ``side``: each member once for every pair of blocks it is in.

    A member's own block is ``left`` or ``right``; ``side`` says which (0 both, 1 left, 2 right). All columns stay.
    """
    drawn = members.where(F.pmod(F.xxhash64(node, F.lit(11)), F.lit(SAMPLE)) == 0)
    parts = F.ceil(F.count("*") * SAMPLE / block).cast("int")
    hot = materialise(drawn.groupBy(*bucket).agg(parts.alias("__parts")).where("__parts > 1"))
    kept = members.join(small(hot), bucket, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    kept = kept.withColumn("__own", F.pmod(F.xxhash64(node, F.lit(7)), F.col("__parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__other")
    return kept.select(*members.columns, "__own", other).select(
        *members.columns,
        F.least("__own", "__other").alias("left"), F.greatest("__own", "__other").alias("right"),
        F.when(F.col("__own") == F.col("__other"), 0).when(F.col("__own") < F.col("__other"), 1).otherwise(2).alias("side"),
    )


def roots(linked: np.ndarray) -> np.ndarray:
    """Index of the first member of each member's component, from a symmetric boolean matrix."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        low = np.where(linked, label, len(label)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low
