"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.store import materialise

__all__ = ["connected_components", "crc_bucket", "forget", "join_skewed", "labelled_sample", "materialise", "may_have", "row_key", "small", "table", "with_arrow_column"]

#: A word, for every operator that counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the map of keys that ``may_have`` sends to all tasks, and of one of its rows.
MAP_BITS, ROW_BITS = 1 << 26, 1 << 15
#: Most keys that a join sends to all tasks for their number of rows, and the most rows of a key that is never sent.
HEAVY, LIGHT = 20_000, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(df: DataFrame) -> None:
    """Delete the files behind a ``materialise`` result that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def with_arrow_column(
    df: DataFrame, column: str, out: str, kind: T.DataType, work: Callable[[], Callable[[list | pa.Array], pa.Array]],
    weight: int = 1 << 21, rows: int = 1000, as_list: bool = True,
) -> DataFrame:
    """Add ``out``, computed in Python from ``column`` in small batches; all other columns pass through untouched.

    ``work`` is called once a task and gives the function from a list of values (an Arrow array unless ``as_list``)
    to an Arrow array. A batch ends at
    ``rows`` rows or, with at least one row, before ``weight`` characters or elements, so a task's memory is bounded
    whatever the size of Spark's own batches. A column already called ``out`` is replaced.
    """
    kept = [c for c in df.columns if c != out or c == column]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    place, names = kept.index(column), [c for c in kept if c != out] + [out]
    shape = T.StructType([f for f in source.schema.fields if f.name != out] + [T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in batches:
            values = batch.column(place)
            at = 0
            while at < batch.num_rows:
                upto, size = at, 0
                while upto < batch.num_rows and upto - at < rows:
                    v = values[upto]
                    size += len(v) if isinstance(v, pa.ListScalar) and v.is_valid else v.as_buffer().size if v.is_valid else 0
                    if size > weight and upto > at:
                        break
                    upto += 1
                part = batch.slice(at, upto - at)
                old = [part.column(i) for i, c in enumerate(kept) if c != out]
                given = part.column(place)
                yield pa.RecordBatch.from_arrays([*old, compute(given.to_pylist() if as_list else given)], names)
                at = upto

    return source.mapInArrow(run, shape)


def crc_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded, deterministic sample of labelled documents that may be learned from.

    Takes at most ``per_class`` documents of each class in the order of a hash of doc_id, never one whose
    crc32 fold is ``held``. A document with several label rows counts as 1 if any says 1; null labels and null
    ids are ignored. Returns (doc_id, text, y) and how many such documents each class has in all.
    """
    y = (
        labels.where(F.col(label).isNotNull() & (crc_bucket("doc_id", folds) != held))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    totals = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    by_hash = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = [y.where(F.col("y") == c).orderBy(*by_hash).limit(per_class) for c in (0, 1)]
    # at most 2 * per_class ids: a proven bound for the broadcast
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select("doc_id", "text").join(ids, "doc_id"), totals


def row_key(*columns: str | Column) -> Column:
    """128 bits that tell rows apart by the given columns, nulls included."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    # concat_ws leaves nulls out: the part of a null is empty, that of an empty text "0:"
    told = [F.concat_ws(":", F.length(c.cast("string")), c.cast("string")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("|", *told)))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A frame marked for broadcast if it has at most so many rows, else as it is. Counts that far."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def may_have(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``keys``, dropped where they lie, before any shuffle.

    Hashes of the keys set bits in a map of MAP_BITS, 8 MB at most whatever the number of keys, which is broadcast. Of n
    keys, about one in MAP_BITS / n of the other rows stays too; none that has one of the keys is dropped.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1
    bits = keys.select(F.bitmap_bucket_number(bit).alias("__bucket"), F.bitmap_bit_position(bit).alias("__bit"))
    sets = bits.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__set"))  # at most MAP_BITS / ROW_BITS rows
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__set", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(sets), "__bucket")
    is_set = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.where(is_set).select(*[F.col(f"`{c}`") for c in rows.columns])


def join_skewed(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has one row a key and says in column ``n`` how many rows it has.

    Keys with over LIGHT rows and more than one in HEAVY of ``total`` are joined by broadcast, so that their rows stay
    where they are; there are at most HEAVY of them, whatever the size of the input. All other keys are shuffled.
    ``how`` is inner or left. ``per_key`` is read three times and ``rows`` twice.
    """
    bar = max(LIGHT, total // HEAVY)
    hot = F.broadcast(per_key.where(F.col(n) > bar))
    cold = per_key.where(F.col(n) <= bar)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return rows.join(hot, keys).unionByName(rest)


def connected_components(links: DataFrame) -> DataFrame:
    """Components of an undirected graph: (u, v) longs in, (node, component) out, component the least node.

    Alternates large-star and small-star steps (each a grouped minimum and an equi-join) until nothing changes. The
    joins spread a hub's links over all tasks (``join_skewed``). Self-links and repeats are fine, nulls are dropped;
    nodes that appear only in self-links come back as their own component.
    """
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).where("node is not null").distinct()
    edges = materialise(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        n, starts = edges.agg(F.count("*"), F.count_distinct("u")).first()
        chained = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if n == starts and chained.isEmpty():  # every node has one parent, and every parent is a root
            break
        both = edges.union(edges.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        large = join_skewed(both, least, ["u"], "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct())
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_skewed(large, low, ["u"], "n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = materialise(small.union(low.select("u", "m")).distinct())
        for done in (edges, least, large, low):
            forget(done)
        edges = step
    return nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
