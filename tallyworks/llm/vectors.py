"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its permutation: the KEPT reference points closest to it, nearest first. Vectors whose cosine
reaches the threshold nearly agree on that order. The inverted lists are those of two pivots at once, a vector standing
in the lists of all pairs of its FIRST nearest pivots; lists hold numbers and permutations alone. Within a list the
pivots that two permutations share are counted, and only vectors with a partner that shares at least SHARED of the KEPT
are sent there, to be verified by their cosine in double precision.

Pivots grow with the cube root of the largest group, so that lists, of which there are as many as pairs of pivots,
grow more slowly than the table. Long lists are worked through in blocks of bounded size; exact copies are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.blocks import block_pairs, roots
from tallyworks.llm.common import connected_components, join_skewed, materialise

THRESHOLD = 0.98
#: Pivots come from a bounded sample: the first SAMPLE distinct vectors by hash, of which those that lie apart stay,
#: GROWTH times the cube root of the largest group's rows, within the bounds of PIVOTS.
SAMPLE = 8192
PIVOTS = (64, 4096)
GROWTH = 16
APART = 0.8
FIRST, KEPT, SHARED = 5, 10, 5


def usable(vector: str) -> str:
    """SQL condition: a vector that has only finite components, not all zero."""
    return (
        f"{vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        f" and exists({vector}, x -> x <> 0)"
    )


def pivots_for(rows: int) -> int:
    """How many pivots a table has whose largest group has so many rows."""
    return int(min(PIVOTS[1], max(PIVOTS[0], round(GROWTH * rows ** (1 / 3)))))


def choose_pivots(sample: np.ndarray, pivots: int, apart: float = APART) -> np.ndarray:
    """Unit vectors of the sample, in order, that have a cosine under ``apart`` with all chosen before."""
    x = units(sample)
    chosen = np.empty((pivots, x.shape[1]))
    n = 0
    for v in x:
        if n == pivots:
            break
        if not n or (chosen[:n] @ v).max() < apart:
            chosen[n] = v
            n += 1
    return chosen[:n]


def units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of large components overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def permutations(nodes: DataFrame, pivots: dict[int, np.ndarray], kept: int = KEPT) -> DataFrame:
    """Add ``near``: the ids of each (dim, vector)'s nearest pivots, nearest first."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS[1] vectors a length

    @F.pandas_udf("array<int>")
    def near(dim: pd.Series, vector: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(dim), index=dim.index, dtype=object)
        for d, at in dim.groupby(dim).groups.items():
            score = units(vector[at]) @ shared.value[int(d)].T
            most = min(kept, score.shape[1])
            some = np.argpartition(-score, most - 1, axis=1)[:, :most]
            order = np.lexsort((some, -np.take_along_axis(score, some, 1)), axis=1)
            out[at] = list(np.take_along_axis(some, order, 1).astype(np.int32))
        return out

    return nodes.withColumn("near", near("dim", "vector"))


def candidates(near: list, side: list, cell: tuple[int, int], first: int, shared: int) -> np.ndarray:
    """Which pairs of a list are its own candidates, as a symmetric matrix.

    A pair shares at least ``shared`` pivots, meets across the list's two blocks, and belongs to the list of the two
    lowest of the pivots that are among the first of both, so that it is looked at in one list only.
    """
    n = len(near)
    row = np.repeat(np.arange(n), [len(x) for x in near])
    ids, column = np.unique(np.concatenate(near), return_inverse=True)
    every = np.zeros((n, len(ids)), np.float32)
    every[row, column] = 1
    early = np.concatenate([np.arange(len(x)) < first for x in near])
    low = early & (ids[column] < max(cell))
    heads = np.zeros((n, len(ids)), np.float32)
    heads[row[low], column[low]] = 1
    side = np.asarray(side)
    most = np.minimum.outer(every.sum(axis=1), every.sum(axis=1))
    found = (every @ every.T >= np.minimum(shared, most)) & (heads @ heads.T == (cell[0] < cell[1]))
    found &= (side[:, None] == 0) | (side[:, None] != side[None, :])
    np.fill_diagonal(found, False)
    return found


def _finder(first: int, shared: int):
    def find(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in groups:
            out = []
            for label, dim, p, q, left, right, members in batch.itertuples(index=False):
                own = candidates([m["near"] for m in members], [m["side"] for m in members], (p, q), first, shared).any(axis=1)
                for i in np.flatnonzero(own):
                    m = members[i]
                    out.append((label, dim, p, q, left, right, m["node"], m["side"], m["near"]))
            yield pd.DataFrame(out, columns=["label", "dim", "p", "q", "left", "right", "node", "side", "near"])

    return find


def _verifier(threshold: float, first: int, shared: int):
    def verify(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in groups:
            out = [pd.DataFrame({"node": [], "n": [], "root": []}, dtype=np.int64)]
            for p, q, members in batch.itertuples(index=False):
                node = np.array([m["node"] for m in members], np.int64)
                copies = np.array([m["copies"] for m in members], np.int64)
                x = units([m["vector"] for m in members])
                linked = candidates([m["near"] for m in members], [m["side"] for m in members], (p, q), first, shared)
                linked &= x @ x.T >= threshold
                linked &= linked.T
                root = roots(linked)
                n = linked @ copies
                keep = n > 0
                out.append(pd.DataFrame({"node": node[keep], "n": n[keep], "root": node[root][keep]}))
            yield pd.concat(out)

    return verify


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label",
    threshold: float = THRESHOLD, pivots: int | None = None, first: int = FIRST, kept: int = KEPT, shared: int = SHARED,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link if their groups are equal and not null, their vectors equally long and usable, and their cosine is at
    least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components, and rows of a null
    group, link with nothing: 0 links, their own component, kept. Copies link with each other and each counts; a copy
    is told by its length and two hashes, 128 bits. A component's id is its least vec_id; of rows that share that id
    each is kept. Other columns are not read.
    """
    base = rows.select(F.col(vec_id).alias("vec_id"), F.col(group).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    base = base.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), F.size("vector"), "vector")})
    fit = base.where(f"label is not null and {usable('vector')}")
    copy = ["label", "h1", "h2"]
    nodes = fit.groupBy(*copy).agg(F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), *copy, F.size("vector").alias("dim"), "vector", "first_id", "copies"))

    largest = nodes.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n"))
    points: dict[int, np.ndarray] = {}
    for dim, n in largest.collect():  # one row for each length of vectors, which is a property of the model that made them
        sample = nodes.where(F.col("dim") == dim).orderBy("h1", "h2", "node").limit(SAMPLE).select("vector").toPandas()
        points[dim] = choose_pivots(sample["vector"], pivots or pivots_for(n))
    described = materialise(permutations(nodes.select("node", "label", "dim", "vector"), points, kept).select("node", "label", "dim", "near"))

    # the lists of pairs of first pivots; a table with a single pivot has one list
    at = lambda i: F.get("near", F.lit(i))
    pairs = F.array(*[F.struct(F.least(at(i), at(j)).alias("p"), F.greatest(at(i), at(j)).alias("q")) for i, j in combinations(range(first), 2)])
    lists = described.select("node", "label", "dim", "near", F.explode(F.filter(pairs, lambda x: x["p"] < x["q"])).alias("c"))
    alone = described.where("size(near) < 2").select("node", "label", "dim", "near", F.lit(0).alias("p"), F.lit(0).alias("q"))
    lists = lists.select("node", "label", "dim", "near", "c.p", "c.q").union(alone)
    cell = ["label", "dim", "p", "q"]
    block = [*cell, "left", "right"]
    met = block_pairs(lists, cell, "node").groupBy(*block).agg(F.collect_list(F.struct("node", "side", "near")).alias("members"))
    shape = ", ".join(f"{c} {t}" for c, t in met.drop("members").dtypes) + ", node long, side int, near array<int>"
    wanted = materialise(met.where("size(members) > 1").select(*block, "members").mapInPandas(_finder(first, shared), shape))
    held = wanted.join(nodes.select("node", "copies", "vector"), "node")
    groups = held.groupBy(*block).agg(F.collect_list(F.struct("node", "copies", "side", "near", "vector")).alias("members"))
    found = materialise(groups.select("p", "q", "members").mapInPandas(_verifier(threshold, first, shared), "node long, n long, root long"))

    parts = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.drop("vector", "dim").join(counts, "node", "left").join(parts, "node", "left")
    named = materialise(named.withColumn("part", F.coalesce("component", "node")).drop("component"))
    total = rows.count()
    least = materialise(named.groupBy("part").agg(F.min("first_id").alias("least_id"), F.count("*").alias("size")))
    links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")
    named = materialise(join_skewed(named, least, ["part"], "size", total).select(*copy, "least_id", "copies", links))
    out = join_skewed(base.drop("vector"), named, copy, "copies", total, "left")
    component = F.coalesce("least_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
