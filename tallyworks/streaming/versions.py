"""Versioned appends from a stream: a key's values in order of their time, each a new version if it differs from the last.

Rows are held by key until the watermark has passed them, so that files which overlap in time give one order. A batch
writes a folder of its own number: run again after a loss, it writes the same rows over its own folder and no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyworks.streaming.events import each_batch

SHAPE = "key string, ts timestamp, value string"
VERSIONS = "key string, version long, ts timestamp, value string"


def in_order(events: DataFrame, late: str) -> DataFrame:
    """(key, ts, value) of a stream, each key's rows in order of ts and value, once the watermark has passed them.

    A key's rows that the watermark hasn't passed are its state; rows later than ``late`` are left out by the engine,
    which counts them.
    """

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = (list(x) for x in state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for batch in rows:
                times += [t.value // 1000 for t in batch["ts"]]
                values += batch["value"].tolist()
        done = state.getCurrentWatermarkMs() * 1000
        held = sorted(zip(times, values, strict=True), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        out = [h for h in held if h[0] <= done]
        rest = held[len(out) :]
        if rest:
            state.update(([t for t, _ in rest], [v for _, v in rest]))
            state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"key": k[0], "ts": pd.to_datetime([t for t, _ in out], unit="us", utc=True), "value": [v for _, v in out]})

    keyed = events.select("key", "ts", "value").withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(step, SHAPE, "times array<long>, values array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def next_versions(latest: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, version, ts, value) of the rows that differ from the one before them, by ts and value, or from the latest version.

    ``latest``: key, version, value, one row a key at most. Nulls are values.
    """
    w = Window.partitionBy("key").orderBy("ts", F.col("value").asc_nulls_first())
    mine = rows.withColumns({"__before": F.lag("value").over(w), "__first": F.row_number().over(w) == 1})
    met = mine.join(latest.select("key", F.col("version").alias("__version"), F.col("value").alias("__value")), "key", "left")
    same = F.when(F.col("__first"), F.col("__version").isNotNull() & F.col("value").eqNullSafe(F.col("__value"))).otherwise(F.col("value").eqNullSafe(F.col("__before")))
    fresh = met.where(~same)
    return fresh.select("key", (F.coalesce("__version", F.lit(0)) + F.row_number().over(w)).cast("long").alias("version"), "ts", "value")


def read_versions(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """All versions, or those of batches before one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    some = [str(p) for p in folders if p.getName().startswith("batch-") and (before is None or int(p.getName()[6:]) < before)]
    return spark.read.schema(VERSIONS).parquet(*some) if some else spark.createDataFrame([], VERSIONS)


def append_versions(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append the ordered rows of a stream (``in_order``) to a folder of versions, batch by batch, until nothing is left.

    A batch sees the versions of the batches before it alone, so one that is run again gives the same rows.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = read_versions(spark, table, number)
        latest = stored.join(batch.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max_by(F.struct("version", "value"), "version").alias("v")).select("key", "v.*")
        next_versions(latest, batch).write.mode("overwrite").parquet(f"{table}/batch-{number}")

    each_batch(stream, work, checkpoint)
