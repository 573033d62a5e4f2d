"""Running gap profiles in the engine's keyed state, one entry for each open (shard of the keys, time bucket).

An entry holds the instants of its keys while the watermark may still let rows into its bucket; an event-time timer at the
bucket's end drops it. What a bucket says about a key's gaps goes out whenever a batch changes it, into a table of newest rows,
from which the profile of a key is merged. Entries, not keys, are what the engine calls the function for, so many small keys
cost one call together, in Arrow batches; a hot key is as many entries as it has open buckets, in as many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from clickloom.functions.scalars import HOUR_MS, floor_div
from clickloom.operators.profiles import merge_states
from clickloom.streaming.versioned import VersionedTable

#: The key as text that is never null; names with a leading underscore do not survive the way to the Python worker.
KEY = "key_text"
#: Shards of the keys if the caller does not say how many.
SHARDS = 64
#: Added to a row's time for the watermark, which starts at 0 and would take all rows up to there for late ones.
SHIFT_MS = 4_000_000_000_000
#: The entry's (key, ts, n) rows in that order, as an Arrow stream.
STATE = "points binary"
COLUMNS = (
    "bucket bigint, n bigint, first bigint, last bigint, gap_low double, gap_high double, gap_sq double, mean double, m2 double"
)


class BucketGaps(StatefulProcessor):
    """Distinct instants of one (shard, bucket) with their numbers of rows; each key's counts, moments and gaps in the bucket."""

    def __init__(self, bucket_ms: int):
        self.bucket_ms = bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.points = handle, handle.getValueState("points", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf[[KEY, "ts"]] for pdf in rows]).assign(n=1)
        changed = new[KEY].unique()
        if self.points.exists():
            new = pd.concat([pa.ipc.open_stream(bytes(self.points.get()[0])).read_pandas(), new])
        else:
            self.handle.registerTimer(int((key[1] + 1) * self.bucket_ms - 1 + SHIFT_MS))
        points = new.groupby([KEY, "ts"], as_index=False)["n"].sum()
        self.points.update((self._stored(points),))
        yield self._states(key[1], points[points[KEY].isin(changed)])

    @staticmethod
    def _stored(points: pd.DataFrame) -> bytes:
        table, sink = pa.Table.from_pandas(points, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def _states(self, bucket: int, points: pd.DataFrame) -> pd.DataFrame:
        """One row for each key of ``points``, which come in the order (key, ts)."""
        keys, ts, n = points[KEY].to_numpy(), points["ts"].to_numpy(np.int64), points["n"].to_numpy(np.int64)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(at, len(keys)))
        total = np.add.reduceat(n, at)
        off = (ts - bucket * self.bucket_ms).astype(float)
        mean = np.add.reduceat(n * off, at) / total
        gap = np.concatenate([[np.nan], np.diff(ts).astype(float)])
        gap[at] = np.nan  # the first instant of a key ends no gap in the bucket
        some = size > 1
        low = np.where(np.maximum.reduceat(n, at) > 1, 0.0, np.fmin.reduceat(gap, at))
        return pd.DataFrame({
            KEY: keys[at], "bucket": np.full(len(at), bucket), "n": total, "first": ts[at], "last": ts[at + size - 1],
            "gap_low": _or_null(low), "gap_high": _or_null(np.fmax.reduceat(gap, at)),
            "gap_sq": _or_null(np.where(some, np.add.reduceat(np.nan_to_num(gap) ** 2, at), np.nan)),
            "mean": float(bucket * self.bucket_ms) + mean, "m2": np.add.reduceat(n * (off - np.repeat(mean, size)) ** 2, at),
        })

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.points.clear()
        return iter(())

    def close(self) -> None:
        pass


def _or_null(x: np.ndarray) -> pd.Series:
    return pd.Series(x).astype("Float64")


def gap_table(spark: SparkSession, out: str, key: str) -> VersionedTable:
    return VersionedTable(spark, out, [key, "bucket"])


def keyed_gaps(
    views: DataFrame, key: str, out: str, checkpoint: str, delay: str, bucket_ms: int = HOUR_MS,
    after_write: Callable[[int], None] | None = None, shards: int = SHARDS,
):
    """Run the stream to its end and return the query (its progress tells the size of the state).

    Rows must come less than ``delay`` behind the newest row; later ones are left out, and the state holds the buckets of
    that span alone. ``after_write`` is called between a batch's write and its commit. The keys are dealt to ``shards`` by a
    hash; more shards make smaller entries.
    """
    kind = views.schema[key].dataType.simpleString()
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = views.select(
        text.alias(KEY), "ts", F.pmod(F.xxhash64(text), F.lit(shards)).alias("shard"), floor_div("ts", bucket_ms).alias("bucket"),
        F.timestamp_millis(F.col("ts") + SHIFT_MS).alias("at"),
    ).withWatermark("at", delay)
    states = rows.groupBy("shard", "bucket").transformWithStateInPandas(
        BucketGaps(bucket_ms), f"{KEY} string, {COLUMNS}", "Update", "EventTime"
    ).withColumn(KEY, F.when(F.col(KEY) != "", F.substr(KEY, F.lit(2))).cast(kind)).withColumnRenamed(KEY, key)

    def write(batch: DataFrame, batch_id: int) -> None:
        gap_table(batch.sparkSession, out, key).put(batch, batch_id)
        if after_write:
            after_write(batch_id)

    query = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def gap_profile(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Count, time and gap statistics per key from the newest states of its buckets."""
    return merge_states(gap_table(spark, out, key).read(), [key], [])
