"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Golden-ratio points fall evenly over the sources' cumulative target shares, so every prefix of the schedule is
mixed in proportion. A source's documents, in a hashed order, form one stream of words that is cut into blocks of
equal size; the r-th slot of the source takes the r-th block, starting over up to MOST times. Only DataFrame
functions are used. Every running sum is taken in two levels (hash buckets within a source, rows within a bucket;
chunks of slots, slots within a chunk), so that one hot source is spread over many tasks. Each step's rows, which
hold ids and numbers but no texts, are written and read again, so no plan grows with the steps before it: planning
takes the driver's memory, whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import WORD, materialise, row_key

WEIGHTS = (5, 2, 1)
MOST = 3
SLOTS = 1 << 16
BLOCK_WORDS = 2048
PER_BUCKET = 4096
CELLS = 1 << 12
CHUNK = 1 << 12
#: The golden ratio's fractional part in units of 2**-40, odd, so that its multiples visit every unit.
GOLDEN = int((5**0.5 - 1) / 2 * (1 << 40)) | 1


def size_of(text: str | Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source of (source, size): docs, source_size, weight, target.

    Sources in code-point order, null last, take the weights in turn and share all words; no target exceeds
    ``most`` times its source's size, the excess going to the others by weight. The fill level is found in one pass
    over the sources in order of their limit per weight. There is one row per source here, never per document.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double"))
    per = per.withColumn("limit", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # levels sink as long as sources are capped: the first source in this order that stays below its limit has the final one
    per = per.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    per = per.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("limit") / F.col("weight"))).over(whole))
    return per.select(
        "source", "docs", "source_size", "weight",
        F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def _running(df: DataFrame, keys: list[str], value: str, order: list, part: str, out: str) -> DataFrame:
    """Sum of ``value`` over earlier rows of the same ``keys``, in two levels: whole ``part`` groups, then rows."""
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in (*keys, part)], F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__base"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, part)]
    inner = Window.partitionBy(*keys, part).orderBy(*order)
    on = same[0]
    for s in same[1:]:
        on = on & s
    return (
        df.join(sums, on)
        .withColumn(out, F.col("__base") + F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
        .withColumn("__row", F.row_number().over(inner))
        .drop("__base", *[f"__{k}" for k in (*keys, part)])
    )


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str, DataFrame]:
    """Mix all documents of (doc_id, source, text) to the targets of ``source_targets``.

    Returns ``documents`` (doc_id, row_key: 128 bits of id, source and text, source, size, source_size, target, taken:
    words the mix takes, repeats counted),
    ``schedule`` (slot, source_no, block, epoch, words: what the slot takes of the block) and ``pieces`` (source_no,
    block, doc_id, lo, words: which part of which document a block holds). Every source's taken words are its target
    to the nearest word, and no document is taken more than ``most`` times.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own. Repeated rows are
    documents of their own, in an order fixed by a hash of the id and the size, so reruns agree. An empty table
    gives empty tables.
    """
    rows = materialise(docs.select("doc_id", row_key("doc_id", "source", text).alias("row_key"), "source", size_of(text).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash")))
    targets = materialise(source_targets(rows, weights, most))
    total = F.sum("source_size").over(Window.partitionBy())
    step = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.ceil(total / SLOTS))).cast("long")
    share = F.sum("target").over(Window.orderBy(F.col("source").asc_nulls_last()))
    targets = targets.select(
        "*",
        F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("source_no"),
        F.round(F.least("target", F.lit(float(most)) * F.col("source_size"))).cast("long").alias("quota"),
        step.alias("step"), total.alias("total"),
        (share / F.sum("target").over(Window.partitionBy())).alias("hi"),
    )
    targets = materialise(targets.withColumns({
        "lo": F.coalesce(F.lag("hi").over(Window.orderBy("source_no")), F.lit(0.0)),
        "blocks": F.ceil(F.col("source_size") / F.col("step")).cast("long"),
        # the fewest slots that hold the quota: whole rounds of all blocks, then blocks of the last round
        "need": F.when(F.col("source_size") > 0, F.expr("(quota div source_size) * ceil(source_size / step) + ceil((quota % source_size) / step)")).otherwise(F.lit(0)).cast("long"),
        "depth": F.least(F.lit(8), F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("docs") / PER_BUCKET)))).cast("int"),
    }))

    # documents as intervals of their source's stream
    known = targets.select(F.col("source").alias("__s"), "source_no", "source_size", "target", "step", "depth")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    placed = placed.withColumn("part", F.expr("substring(hash, 1, depth)"))
    placed = materialise(_running(placed, ["source_no"], "size", ["hash", "size"], "part", "start"))
    cut = placed.where("size > 0").select(
        "source_no", "part", "__row", "doc_id", "start", "size", "step",
        F.explode(F.sequence(F.floor(F.col("start") / F.col("step")), F.floor((F.col("start") + F.col("size") - 1) / F.col("step")))).alias("block"),
    )
    pieces = cut.select(
        "source_no", "block", "doc_id", "part", "__row",
        F.greatest("start", F.col("block") * F.col("step")).alias("lo"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("step")) - F.greatest("start", F.col("block") * F.col("step"))).alias("words"),
    )

    # golden-ratio points through the cumulative shares: each source's interval is cut at a fixed grid of cells
    bounds = targets.where("need > 0").select(
        "source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS)))).alias("cell")
    )
    n = targets.agg(F.max(F.ceil(F.col("total") / F.col("step"))).alias("n")).where("n > 0")  # one row
    chunks = n.select("n", F.explode(F.expr(f"sequence(0, (n - 1) div {CHUNK})")).alias("chunk")).repartition("chunk")
    slots = chunks.select("chunk", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(n, (chunk + 1) * {CHUNK}) - 1)")).alias("slot"))
    point = (F.expr(f"(slot % {1 << 20}) * {GOLDEN} + (slot div {1 << 20}) * {(GOLDEN << 20) % (1 << 40)}") % (1 << 40)) / float(1 << 40)
    slots = slots.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    drawn = materialise(slots.join(bounds, "cell").where("point >= lo and point < hi").select("slot", "chunk", "source_no", F.lit(1).cast("long").alias("one")))
    ranked = materialise(_running(drawn, ["source_no"], "one", ["slot"], "chunk", "rank").select("slot", "source_no", "rank"))
    counts = ranked.groupBy("source_no").agg(F.count("*").alias("have"))
    # closing slots, where rounding has left a source short
    short = targets.where("need > 0").join(counts, "source_no", "left").where("coalesce(have, 0) < need")
    closing = short.select(F.lit(None).cast("long").alias("slot"), "source_no", F.explode(F.expr("sequence(coalesce(have, 0), need - 1)")).alias("rank"))
    plan = targets.where("need > 0").select("source_no", "need", "blocks", "quota", "source_size", "step")
    schedule = materialise(
        ranked.unionByName(closing)
        .join(plan, "source_no")
        .where("rank < need")
        .select("slot", "source_no", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("epoch"), "quota", "source_size", "step")
        .withColumn("at", F.expr("epoch * source_size + block * step"))
        .withColumn("words", F.least("step", F.expr("source_size - block * step"), F.expr("quota - at")))
        .select("slot", "source_no", "block", "epoch", "words", "step")
    )

    # a block is taken once for every slot that it fills; only a source's last slot may take less than the block
    uses = schedule.groupBy("source_no", "block", "words").agg(F.count("*").alias("times"), F.first("step").alias("step"))
    got = (
        pieces.join(uses.withColumnRenamed("words", "used"), ["source_no", "block"])
        .withColumn("part_words", F.least("words", F.greatest(F.lit(0), F.expr("used - (lo - block * step)"))) * F.col("times"))
        .groupBy("source_no", "part", "__row")
        .agg(F.sum("part_words").cast("long").alias("taken"))
    )
    out = placed.join(got, ["source_no", "part", "__row"], "left").select(
        "doc_id", "row_key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )
    return {"documents": out, "schedule": schedule.drop("step"), "pieces": pieces.select("source_no", "block", "doc_id", "lo", "words"), "sources": targets}


def mixed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix as rows of ``docs``: each row as often as its words are taken, to the nearest whole copy.

    Rows that are never taken are left out, and so are those without words. All columns stay.
    """
    taken = mix(docs, text)["documents"].where("taken > 0").groupBy("row_key")
    copies = materialise(taken.agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("__copies")).where("__copies > 0"))
    rows = docs.withColumn("__mix_key", row_key("doc_id", "source", text)).join(copies.withColumnRenamed("row_key", "__mix_key"), "__mix_key")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
