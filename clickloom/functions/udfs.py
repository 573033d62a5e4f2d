"""User functions over gaps and rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions.scalars import HOUR_MS, floor_div


def gap_apply(
    df: DataFrame, by: Sequence[str], ts: str, partial: Callable[[np.ndarray, np.ndarray], Sequence[float]], width: int,
    bucket_ms: int = HOUR_MS,
) -> DataFrame:
    """(key, part, state): a user function of the gaps between consecutive events of a key.

    ``partial(gaps, counts)`` gets distinct gaps with how often each occurs, as arrays, and returns ``width``
    numbers, which the caller merges with ordinary aggregates. Gaps are counted first and then cut by
    size into parts of at most ``bucket_ms`` distinct values, so a hot key is several bounded groups
    and an ordinary key is one or two. Groups come sorted in Arrow batches, many small ones in each; the engine
    marks where a group begins, so a task holds a batch and the group that runs over its end.
    """
    by = list(by)
    points = df.groupBy(*by, ts).agg(F.count("*").alias("n")).withColumn("bucket", floor_div(ts, bucket_ms))
    inner = F.lag(ts).over(W.partitionBy(*by, "bucket").orderBy(ts))
    links = points.groupBy(*by, "bucket").agg(F.max(ts).alias("_last")).withColumn(
        "_bridge", F.lag("_last").over(W.partitionBy(*by).orderBy("bucket"))
    ).drop("_last")
    points = points.withColumn("_inner", inner).join(links, [*by, "bucket"])
    # The first instant of a key ends no gap; further rows of one instant end a gap of 0.
    moved = F.struct((F.col(ts) - F.coalesce("_inner", "_bridge")).alias("gap"), F.lit(1).cast("bigint").alias("count"))
    still = F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("n") - 1).alias("count"))
    gaps = points.select(*by, F.explode(F.array(moved, still)).alias("g")).select(*by, "g.*")
    gaps = gaps.where("gap IS NOT NULL AND count > 0").groupBy(*by, "gap").agg(F.sum("count").alias("count"))
    gaps = gaps.withColumn("part", floor_div("gap", bucket_ms))
    starts = (F.row_number().over(W.partitionBy(*by, "part").orderBy("gap")) == 1).alias("_starts")

    def states(t: pa.Table) -> pa.RecordBatch:
        """A state for each group of ``t``, which begins with the first row of one."""
        gap, count = t.column("gap").to_numpy(), t.column("count").to_numpy()
        at = np.flatnonzero(t.column("_starts").to_numpy())
        found = []
        for a, z in zip(at, [*at[1:], len(gap)], strict=True):
            state = [float(x) for x in partial(gap[a:z], count[a:z])]
            if len(state) != width:
                raise ValueError("the function returned another number of values")
            found.append(state)
        keys = t.select([*by, "part"]).take(pa.array(at)).combine_chunks()
        columns = [keys.column(c).combine_chunks() for c in (*by, "part")]
        return pa.record_batch([*columns, pa.array(found, pa.list_(pa.float64()))], [*by, "part", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that may go on in the next batch
        for batch in batches:
            at = np.flatnonzero(batch.column("_starts").to_numpy(zero_copy_only=False))
            if len(at) and held + [x for x in (batch.slice(0, at[-1]),) if len(x)]:
                yield states(pa.Table.from_batches([*held, batch.slice(0, at[-1])]))
                held = []
            held.append(batch.slice(at[-1]) if len(at) else batch)
        if held and sum(map(len, held)):
            yield states(pa.Table.from_batches(held))

    kinds = dict(gaps.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in by], "part bigint", "state array<double>"])
    return gaps.select(*by, "part", "gap", "count", starts).mapInArrow(run, schema)


def map_rows(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user function over whole Arrow batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield function(pdf)

    return df.mapInPandas(run, schema)
