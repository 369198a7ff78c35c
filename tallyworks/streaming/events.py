"""Streams over an event log: windows with watermarks, duplicates, rate limits and versioned appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Events of one key that are handed on at once.
SLICE = 10_000


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files: int | None = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch; with None all that are there in one.

    The watermark moves between batches, so that in one batch no row is late, however the files overlap in time.
    """
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums in tumbling or sliding windows, rows later than ``late`` left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    sums = events.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("amount"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "amount")


def sessions(events: DataFrame, gap: str, late: str = "1 day", key: str = "user_id") -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key's first delivery; repeats within ``late`` are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def limit_step(start: float | None, used: int, times: list[float], length: float, most: int) -> tuple[float | None, int, list[bool]]:
    """Fixed windows that begin with a key's first event: (window start, used in it, whether each event is let through)."""
    out = []
    for t in times:
        if start is None or t - start >= length:
            start, used = t, 0
        used += 1
        out.append(used <= most)
    return start, used, out


def rate_limited(events: DataFrame, key: str, seconds: float, most: int, late: str = "1 day") -> DataFrame:
    """(key, event_id, ts, allowed): at most so many events in a window that starts with the key's first event.

    The state of a key is its window's start and count, kept until the watermark passes the window. Events of one
    batch are taken in the order of their time and id: a key's times and ids of a batch are held, 16 bytes an event.
    """

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        start = None if start is None or start < 0 else start
        # a hot key's rows come in several Arrow batches, in no order
        parts = [batch[["ts", "event_id"]] for batch in rows]
        whole = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        del parts
        order = np.lexsort((whole["event_id"].to_numpy(), whole["ts"].to_numpy("datetime64[ns]")))
        for at in range(0, len(order), SLICE):
            batch = whole.iloc[order[at : at + SLICE]]
            times = ((batch["ts"] - pd.Timestamp(0, tz=batch["ts"].dt.tz)) / pd.Timedelta(seconds=1)).tolist()
            start, used, allowed = limit_step(start, used, times, seconds, most)
            yield pd.DataFrame({key: k[0], "event_id": batch["event_id"], "ts": batch["ts"], "allowed": allowed})
        state.update((-1.0 if start is None else start, used))
        over = int(((start or 0.0) + seconds) * 1000)
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)[key]
    shape = f"{key} {kind}, event_id long, ts timestamp, allowed boolean"
    keyed = events.withWatermark("ts", late).groupBy(key)
    return keyed.applyInPandasWithState(step, shape, "start double, used int", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Work through everything there is and stop, into a Parquet folder. Returns how many rows came too late.

    The engine counts late rows after its own sums of a batch, and keeps the counts of its last hundred batches.
    """
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every batch to ``work`` once, with its number, and stop when there is nothing left."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
