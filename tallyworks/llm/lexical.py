"""Ranked lexical search with block-max WAND over postings in blocks of variable length.

The documents that a task reads make shards of at most DOCS documents. A shard has one list of postings a term, in
ascending doc_id, and dynamic programming cuts every list where the blocks' maxima bound its scores most tightly. All
lists of a shard take a step of the programme together. The index is a table, one row a list. A search meets a shard
with the terms of a block of items and goes through its documents in ascending doc_id: whole blocks are skipped
where the maxima of all blocks over a document can't beat the worst of the best K so far, what remains is scored exactly.
Ties go to the smaller doc_id, which is also the one seen first, so nothing is lost by skipping equal bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.llm.common import materialise, small

#: A term: a run of anything but ASCII characters that are no letters or digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same as bytes: A-Z in lower case, other characters of no term a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Documents and bytes of text of a shard; one document may have more.
DOCS, BYTES = 4096, 1 << 25
#: A block costs as much as this error of a bound, so longer blocks stand where scores are even; at most LONGEST postings.
PER_BLOCK, LONGEST = 250_000, 32
#: Documents of the first run of a search; every next run is twice as long.
RUN = 128
#: Terms of a block of items, about.
ITEM_TERMS = 50_000
#: Hits of an item.
K = 20


def terms_of(text: str | Column) -> Column:
    """The terms of a text, A-Z in lower case, in order."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), letters, letters.lower()), F.lit(TERM), F.lit(0))


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all documents have together."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TERM)).cast("long")
    row = docs.select(n.alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return row["docs"], row["terms"]


def cut_lists(values: np.ndarray, starts: np.ndarray, per_block: int = PER_BLOCK, longest: int = LONGEST) -> np.ndarray:
    """Ends of the blocks of many lists, as positions in ``values``, which holds the lists one after another.

    Of all ways to cut a list into blocks of at most ``longest``, the one with the least sum of (block's maximum -
    value) over its values and ``per_block`` over its blocks. ``starts`` has the first position of each list and,
    last, the end. One step of the programme takes the next value of every list that has one.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")  # the lists that still go on are always the first ones
    begin, sizes = starts[:-1][order], sizes[order]
    if not len(sizes) or not sizes[0]:
        return np.zeros(0, np.int64)
    width = min(longest, int(sizes[0]))
    best = np.full((len(sizes), width), np.iinfo(np.int64).max >> 1)  # column j: cheapest cost of all values but the last j
    best[:, 0] = 0
    highest = np.zeros((len(sizes), width), np.int64)  # column j: maximum of the last j + 1 values
    lengths = np.arange(1, width + 1)
    back = np.zeros(len(values), np.int64)
    for i in range(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -i, "left"))  # sizes over i
        x = values[begin[:live] + i]
        best, highest = best[:live], highest[:live]
        highest[:, 1:] = np.maximum(highest[:, :-1], x[:, None])
        highest[:, 0] = x
        cost = best + highest * lengths
        cost = cost + per_block
        choice = cost.argmin(axis=1)
        back[begin[:live] + i] = choice + 1
        best[:, 1:] = best[:, :-1]
        best[:, 0] = cost[np.arange(live), choice]
    # walk back from the last value of every list at once
    at, low = (begin + sizes - 1)[sizes > 0], begin[sizes > 0]
    ends = []
    while len(at):
        ends.append(at + 1)
        at = at - back[at]
        low, at = low[at >= low], at[at >= low]
    return np.sort(np.concatenate(ends))


def _shard(ids: list, texts: list[bytes], wanted: set[bytes] | None, docs: int, terms: int) -> tuple[list, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents in ascending id, terms, ends of their lists, documents' places, impacts and block ends of all lists."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    number: dict[bytes, int] = {}
    term_no, place, times, norms = [], [], [], np.zeros(len(ids), np.int64)
    for at, i in enumerate(order):
        words = texts[i].translate(FOLD).split()
        norms[at] = 75 + 25 * len(words) * docs // terms if terms else 0
        counts: dict[bytes, int] = {}
        for w in words if wanted is None else filter(wanted.__contains__, words):
            counts[w] = counts.get(w, 0) + 1
        for w, tf in counts.items():
            term_no.append(number.setdefault(w, len(number)))
            times.append(tf)
        place.append(len(counts))
    place = np.repeat(np.arange(len(order)), place)
    by_term = np.argsort(np.array(term_no, np.int64), kind="stable")  # places stay in ascending order
    tf = np.array(times, np.int64)[by_term]
    place = place[by_term]
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * norms[place])
    list_ends = np.bincount(np.array(term_no, np.int64), minlength=len(number)).cumsum()
    blocks = cut_lists(impact, np.concatenate([[0], list_ends]).astype(np.int64))
    return [ids[i] for i in order], list(number), list_ends, place, impact, blocks


def index(docs: DataFrame, wanted: DataFrame | None = None, text: str = "text", id: str = "doc_id", docs_a_shard: int = DOCS) -> tuple[DataFrame, int]:
    """An index of all documents, written to the shared folder, and the number of documents with a term.

    Rows: shard, term (null in the one row of a shard that holds ``ids``), ``places`` of the documents in ids,
    ``impacts`` (what a weight of 1 scores there) and ``ends`` of the blocks. ``wanted`` (term) are all terms that will
    be searched, as long as there are few of them; without it every term is indexed. Null and empty texts have no
    terms. Rows of the same id are documents of their own, null ids come after all others.
    """
    n, terms = statistics(docs, text)
    known = None
    if wanted is not None and len(rows := wanted.distinct().limit(ITEM_TERMS + 1).collect()) <= ITEM_TERMS:  # bounded
        known = {r["term"].encode() for r in rows}
    kind = docs.schema[id].dataType
    shape = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("impacts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(kind)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, made = [], [], 0, 0
        part = TaskContext.get().partitionId()
        arrow = None

        def written() -> Iterator[pa.RecordBatch]:
            ordered, names, list_ends, place, impact, blocks = _shard(ids, texts, known, n, terms)
            offsets = np.concatenate([[0], list_ends]).astype(np.int32)
            cuts = np.searchsorted(blocks, offsets, "right").astype(np.int32)
            first = offsets[np.searchsorted(offsets, blocks, "left") - 1]  # where the list of a block begins
            lists = lambda at, of: pa.ListArray.from_arrays(pa.array(at), pa.array(of.astype(np.int32)))
            shard = (part << 32) + made
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([None], pa.string()), *[pa.array([None], pa.list_(pa.int32()))] * 3, pa.array([ordered], pa.list_(arrow))], shape.names
            )
            if names:
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(names)), pa.array(names, pa.binary()).cast(pa.string()), lists(offsets, place), lists(offsets, impact),
                    lists(cuts, blocks - first), pa.array([None] * len(names), pa.list_(arrow)),
                ], shape.names)

        for batch in batches:
            arrow = batch.schema.field(0).type
            for doc, given in zip(batch.column(0), batch.column(1), strict=True):
                given = given.as_py() or b""
                if ids and (len(ids) == docs_a_shard or size + len(given) > BYTES):
                    yield from written()
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(doc.as_py())
                texts.append(given)
                size += len(given)
        if ids:
            yield from written()

    return materialise(docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, shape)), n


def best_of(postings: tuple[np.ndarray, ...], weights: np.ndarray, size: int, k: int = K, run: int = RUN) -> list[tuple[int, int]]:
    """(place, score) of the ``k`` best of ``size`` documents with a score above 0, best first.

    ``postings``: lists' ends, block ends, block maxima, places and impacts of the item's terms, one list after the
    other; ``weights``: one a list. Runs of documents, from the first, twice as long each time: those whose bound
    doesn't beat the worst of k so far are left out, and of the lists only blocks over the others are read.
    """
    list_ends, ends, highest, places, impacts = postings
    begins = np.concatenate([[0], ends[:-1]])
    own = np.searchsorted(list_ends, begins, "right")
    weight = weights[own]
    last = places[ends - 1]
    first = np.where(np.isin(begins, np.concatenate([[0], list_ends[:-1]])), 0, np.concatenate([[0], last[:-1] + 1]))
    # the bound of a document: over its terms, the weighted maximum of the block that the document is in or before
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, first, weight * highest)
    np.subtract.at(change, last + 1, weight * highest)
    bound = change.cumsum()[:size]
    bar, found, scores = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = 0
    while lo < size:
        hi = min(size, lo + run)
        alive = np.zeros(hi - lo + 1, np.int64)
        alive[1:] = (bound[lo:hi] > bar).cumsum()
        if alive[-1]:
            over = np.flatnonzero((first < hi) & (last >= lo))
            over = over[alive[np.minimum(last[over] + 1, hi) - lo] > alive[np.maximum(first[over], lo) - lo]]
            sizes = ends[over] - begins[over]
            which = np.repeat(over, sizes)
            at = np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes) + begins[which]
            inside = (places[at] >= lo) & (places[at] < hi)
            at, which = at[inside], which[inside]
            total = np.zeros(hi - lo, np.int64)
            np.add.at(total, places[at] - lo, weight[which] * impacts[at])
            new = np.flatnonzero((total > bar) & (bound[lo:hi] > bar))  # documents that aren't live may lack some blocks
            found, scores = np.concatenate([found, new + lo]), np.concatenate([scores, total[new]])
            keep = np.lexsort((found, -scores))[:k]
            found, scores = found[keep], scores[keep]
            bar = int(scores[-1]) if len(scores) == k else 0
        lo, run = hi, run * 2
    return list(zip(found.tolist(), scores.tolist(), strict=True))


def _searched(lists: pa.Table, asked: pa.Table, k: int) -> tuple[list, list, list]:
    """Item, id and score of each hit of one shard: ``asked`` has the items' terms, ``lists`` the shard's rows of the index."""
    named = lists.column("term").to_pylist()
    ids = next(x for x in lists.column("ids") if x.is_valid)
    flat = lambda name: lists.column(name).combine_chunks()
    bounds = {c: (flat(c).offsets.to_numpy(), flat(c).values.to_numpy().astype(np.int64)) for c in ("places", "impacts", "ends")}
    of = lambda name, row: bounds[name][1][bounds[name][0][row] : bounds[name][0][row + 1]]
    rows = {t: r for r, t in enumerate(named) if t is not None}
    highest = {t: np.maximum.reduceat(of("impacts", r), np.concatenate([[0], of("ends", r)[:-1]])) for t, r in rows.items()}
    items, terms, weights = (asked.column(f"asked_{c}").to_pylist() for c in ("item", "term", "weight"))
    by_item: dict = {}
    for item, term, weight in zip(items, terms, weights, strict=True):
        if weight > 0 and term in rows:
            by_item.setdefault(item, []).append((term, weight))
    out: tuple[list, list, list] = ([], [], [])
    for item, pairs in by_item.items():
        own = [rows[t] for t, _ in pairs]
        counts = np.array([len(of("places", r)) for r in own])
        blocks = np.array([len(of("ends", r)) for r in own])
        list_ends = counts.cumsum()
        ends = np.concatenate([of("ends", r) for r in own]) + np.repeat(list_ends - counts, blocks)
        postings = (list_ends, ends, np.concatenate([highest[t] for t, _ in pairs]), np.concatenate([of("places", r) for r in own]), np.concatenate([of("impacts", r) for r in own]))
        hits = best_of(postings, np.array([w for _, w in pairs], np.int64), len(ids), k)
        out[0].extend([item] * len(hits))
        out[1].extend(ids[p].as_py() for p, _ in hits)
        out[2].extend(s for _, s in hits)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", docs_a_shard: int = DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each row of ``items`` (item_id, text), best first.

    Documents of equal score are ranked by ascending doc_id, null last. Documents without a term of the item are in no
    list, nor are those whose terms all weigh 0. Items without terms (null or empty texts) have no rows, and rows of
    the same item_id are one item with the terms of all. Repeated documents are hits of their own. An empty table on
    either side gives none. Other columns don't matter.
    """
    asked = items.select(F.col("item_id").alias("item"), F.explode(terms_of(text)).alias("term"))
    asked = materialise(asked.groupBy("item", "term").agg(F.count("*").alias("times")))
    lists, n = index(docs, asked.select("term"), text, docs_a_shard=docs_a_shard)
    df = lists.where("term is not null").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    # items in blocks of about ITEM_TERMS terms: a block meets each shard once
    blocks = max(1, -(-asked.count() // ITEM_TERMS))
    part = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("part")
    weighted = materialise(asked.join(df, "term").select("item", part, "term", (weight * F.col("times")).alias("weight")))
    needed = small(weighted.select("term", "part").distinct())
    mine = lists.where("term is not null").join(needed, "term").select("shard", "part", "term", "places", "impacts", "ends", F.lit(None).cast(lists.schema["ids"].dataType).alias("ids"))
    heads = lists.where("term is null").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*mine.columns)
    wanted = lists.where("term is not null").select("shard", "term").join(small(weighted), "term")
    # names of their own: both sides of the group come from the same tables
    wanted = wanted.select(*[F.col(c).alias(f"asked_{c}") for c in ("shard", "part", "item", "term", "weight")])
    shape = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])

    def hits(shard: pa.Table, terms: pa.Table) -> pa.Table:
        kinds = [terms.schema.field("asked_item").type, shard.schema.field("ids").type.value_type, pa.int64()]
        found = _searched(shard, terms, k) if shard.num_rows and terms.num_rows else ([], [], [])
        return pa.table([pa.array(v, t) for v, t in zip(found, kinds, strict=True)], names=shape.names)

    per_shard = mine.unionByName(heads).groupBy("shard", "part").cogroup(wanted.groupBy("asked_shard", "asked_part")).applyInArrow(hits, shape)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return per_shard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
