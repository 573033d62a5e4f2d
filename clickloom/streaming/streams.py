"""The page-view log as a stream: filtered append, running per-key profiles and restart.

Every query runs with ``availableNow`` over a file source with a bounded number of files per batch.
Per-key state is kept in mergeable tables; each micro-batch writes its own part, so a batch that is run again after a
failure gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from clickloom.functions.scalars import HOUR_MS
from clickloom.operators.profiles import bucket_states, merge_states
from clickloom.session import children, is_complete
from clickloom.sources.readers import PAGE_VIEW_SCHEMA
from clickloom.streaming.versioned import VERSION, VersionedTable


def page_view_stream(spark: SparkSession, path: str, files_per_batch: int = 2) -> DataFrame:
    return spark.readStream.schema(PAGE_VIEW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def filtered_append(views: DataFrame, users: DataFrame, country_id: Column, out: str, checkpoint: str) -> None:
    """Keep known users, project and append to a Parquet table (exactly once through the sink's log)."""
    kept = views.join(users.select("uuid").distinct(), "uuid", "left_semi").select(
        "uuid", "document_id", "platform", "traffic_source", country_id.alias("country_id"), "ts"
    )
    query = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def running_counts(
    views: DataFrame, key: str, out: str, checkpoint: str, after_write: Callable[[int], None] | None = None
) -> None:
    """Running count, platform counts and time range per key, from the engine's own keyed state.

    Only keys touched by a batch are written, as a run of a table of newest rows (safe to repeat). ``after_write`` is
    called between a batch's write and its commit.
    """
    state = views.groupBy(key).agg(
        F.count("*").alias("tot"), *[F.count_if(F.col("platform") == i).alias(f"platform{i}") for i in (1, 2, 3)],
        F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.avg("ts").alias("ts_avg"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        VersionedTable(batch.sparkSession, out, [key]).put(batch, batch_id)
        if after_write:
            after_write(batch_id)

    query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Newest row per key of ``running_counts`` output."""
    return VersionedTable(spark, out, [key]).read().drop(VERSION)


def gap_points(batch: DataFrame, key: str) -> DataFrame:
    """What a batch adds to the state: its rows per (key, instant), map-side combined."""
    return batch.groupBy(key, "ts").agg(F.count("*").alias("n"))


def running_gaps(
    views: DataFrame, key: str, out: str, checkpoint: str, compact_every: int = 16,
    after_write: Callable[[int], None] | None = None,
) -> None:
    """Running time and gap profile per key, exact for rows that arrive in any order.

    A late row falls between instants that are already known, so the state keeps the distinct instants. Each batch
    writes only its own, in its own directory (a repeated batch writes the same again); every ``compact_every`` batches
    they are merged into one table. ``after_write`` is called between a batch's write and its commit.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        gap_points(batch, key).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            merged = gap_points_so_far(batch.sparkSession, out, key, batch_id)
            merged.write.mode("overwrite").parquet(f"{out}/merged={batch_id}")
        if after_write:
            after_write(batch_id)

    query = views.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def gap_points_so_far(spark: SparkSession, out: str, key: str, last_batch: int | None = None) -> DataFrame:
    """All instants of the complete batches (up to ``last_batch``): the newest merged table and the batches after it."""
    found = {}
    for name in children(spark, out):
        kind, _, number = name.partition("=")
        if number.isdigit() and (last_batch is None or int(number) <= last_batch) and is_complete(spark, f"{out}/{name}"):
            found.setdefault(kind, []).append(int(number))
    merged = max((m for m in found.get("merged", []) if m != last_batch), default=None)
    paths = [f"{out}/batch={b}" for b in found.get("batch", []) if merged is None or b > merged]
    if merged is not None:
        paths.append(f"{out}/merged={merged}")
    return spark.read.parquet(*paths).groupBy(key, "ts").agg(F.sum("n").alias("n"))


def gap_profile(points: DataFrame, key: str, bucket_ms: int = HOUR_MS) -> DataFrame:
    """Count, time and gap statistics per key from instants, by the skew-safe (key, time bucket) states."""
    return merge_states(bucket_states(points, [key], "ts", {}, bucket_ms, rows=F.col("n")), [key], [])


def fail_once(at_batch: int) -> Callable[[int], None]:
    """A hook that breaks off the first run of one batch after its write and before its commit."""
    left = [at_batch]

    def hook(batch_id: int) -> None:
        if left and batch_id == left[0]:
            left.clear()
            raise RuntimeError(f"batch {batch_id} broken off")

    return hook


def with_restart(start: Callable[[], None], add_files: Callable[[], None]) -> None:
    """Run until a batch breaks off or the files end, let new files arrive, and go on from the checkpoint."""
    try:
        start()
    except StreamingQueryException as e:
        if "broken off" not in str(e):
            raise
    add_files()
    start()
