"""Per-key profiles: counts, click rates, time statistics and gaps between consecutive events.

Gaps need each key's events in time order. A key may hold a third of the log, so its time line is
cut into buckets: events are first reduced to distinct instants, gaps inside a (key, bucket) come
from a window over at most ``bucket_ms`` instants, and bucket states are merged with the bridge gaps
between neighbouring buckets. Most keys hold few events; where a sample tells the large keys, only these
are cut, and any other key's instants move once and become one state. The result is exact either way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import scalars as S

TIME_STATS = ("ts_min", "ts_max", "ts_avg", "ts_var")
GAP_STATS = ("gap_min", "gap_max", "gap_avg", "gap_var")
CLICK_STATS = ("tot", "clicks", "prob", *TIME_STATS, *GAP_STATS)
VIEW_COUNTERS = (
    "countryUS", "countryCA", "countryGB", "countryRest", "platform1", "platform2", "platform3",
    "trafsrc1", "trafsrc2", "trafsrc3",
)
VIEW_CLOCK = ("hour_min", "day_min", "hour_max", "day_max", "hour_avg", "day_avg")
VIEW_STATS = ("tot", *TIME_STATS, *GAP_STATS, *VIEW_COUNTERS, *VIEW_CLOCK)


STACK = ("key_num", "key_str", "key_id")

#: Keys of fewer rows are summed up in one piece; one in so many values of a column is looked at to find the others.
WHOLE_ROWS, SAMPLED = 1_000_000, 64
#: A bucket that holds all times from 0 on, and another those before.
ALL_TIME = 1 << 62


def stack_keys(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long form with one row per key column: one shuffle serves every key.

    A key is (key_num, key_str, key_id): integer keys stay integers, which hash and sort much faster
    than text; keys of all other types are kept as their text, which loses nothing; ``key_id`` is the place in ``keys``.
    """
    whole = {name for name, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}

    def cell(i: int, k: str) -> Column:
        num = F.col(k) if k in whole else F.lit(None)
        label = F.lit(None) if k in whole else F.col(k)
        return F.struct(num.cast("bigint").alias("key_num"), label.cast("string").alias("key_str"), F.lit(i).alias("key_id"))

    pairs = F.array(*[cell(i, k) for i, k in enumerate(keys)])
    return df.select(*values, F.explode(pairs).alias("_p")).select("_p.*", *values)


def name_keys(stacked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``STACK`` columns turned into (key_name, key_value)."""
    name = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("key_id") + 1)
    value = F.coalesce(F.col("key_num").cast("string"), F.col("key_str"))
    rest = [c for c in stacked.columns if c not in STACK]
    return stacked.select(name.alias("key_name"), value.alias("key_value"), *rest)


def large_keys(df: DataFrame, by: Sequence[str], sample_by: str, rows: int) -> DataFrame:
    """The keys that have about ``rows`` rows or more, by the rows of one in ``SAMPLED`` values of ``sample_by``.

    There are at most as many as ``df`` has multiples of ``rows`` rows. Which keys are found decides how they are worked on,
    never what comes out.
    """
    some = df.where(F.pmod(F.xxhash64(sample_by), F.lit(SAMPLED)) == 0)
    return some.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") * SAMPLED >= rows).select(
        *[F.col(c).alias(f"_l_{c}") for c in by], F.lit(True).alias("_large")
    )


def bucket_states(
    df: DataFrame, by: Sequence[str], ts: str, counters: Mapping[str, Column], bucket_ms: int, rows: Column | None = None,
    large: DataFrame | None = None,
) -> DataFrame:
    """Partial state per (key, time bucket): counts, moments, first and last instant, inner gaps.

    ``rows`` tells how many events a row of ``df`` stands for, if not one. With ``large`` (of ``large_keys``), only those
    keys are cut into buckets; each other key has one for all its time (and, as ever, one for rows without a time).
    """
    points = df.groupBy(*by, ts).agg(
        (F.count("*") if rows is None else F.sum(rows)).alias("_n"), *[F.sum(e).alias(name) for name, e in counters.items()]
    )
    bucket = S.floor_div(ts, bucket_ms)
    if large is not None:
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in by])
        points = points.join(F.broadcast(large), same, "left")
        bucket = F.when(F.col("_large"), bucket).otherwise(S.floor_div(ts, ALL_TIME))
    points = points.withColumn("bucket", bucket)
    w = W.partitionBy(*by, "bucket").orderBy(ts)
    # Times are told from the bucket's first instant, so that their squares stay small.
    points = points.withColumns({
        "_gap": (F.col(ts) - F.lag(ts).over(w)).cast("double"), "_off": (F.col(ts) - F.first(ts).over(w)).cast("double"),
    })
    return points.groupBy(*by, "bucket").agg(
        F.sum("_n").alias("n"),
        *[F.sum(name).alias(name) for name in counters],
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        F.sum(F.col("_n") * F.col("_off")).alias("s1"),
        F.sum(F.col("_n") * F.col("_off") * F.col("_off")).alias("s2"),
        F.min(F.when(F.col("_n") > 1, 0.0).otherwise(F.col("_gap"))).alias("gap_low"),
        F.max("_gap").alias("gap_high"),
        F.sum(F.col("_gap") * F.col("_gap")).alias("gap_sq"),
    ).select(
        "*",
        (F.col("first") + F.col("s1") / F.col("n")).alias("mean"),
        F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0)).alias("m2"),
    )


def merge_states(states: DataFrame, by: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Final statistics from bucket states; a key has at most as many rows here as time has buckets."""
    key = W.partitionBy(*by)
    bridge = (F.col("first") - F.lag("last").over(key.orderBy("bucket"))).cast("double")
    total_mean = F.sum(F.col("n") * F.col("mean")).over(key) / F.sum("n").over(key)
    s = states.withColumns({"_bridge": bridge, "_mean": total_mean})
    delta = F.col("mean") - F.col("_mean")
    merged = s.groupBy(*by).agg(
        F.sum("n").alias("tot"),
        *[F.sum(c).alias(c) for c in counters],
        F.min("first").alias("ts_min"),
        F.max("last").alias("ts_max"),
        F.max("_mean").alias("ts_avg"),
        F.sum(F.col("m2") + F.col("n") * delta * delta).alias("_m2"),
        F.min(F.least("gap_low", "_bridge")).alias("_low"),
        F.max(F.greatest("gap_high", "_bridge")).alias("_high"),
        F.sum(F.coalesce("gap_sq", F.lit(0.0)) + F.coalesce(F.col("_bridge") * F.col("_bridge"), F.lit(0.0))).alias("_sq"),
    )
    gaps = F.col("tot") - 1
    spread = (F.col("ts_max") - F.col("ts_min")).cast("double")  # the gaps telescope
    gap_m2 = F.greatest(F.col("_sq") - spread * F.try_divide(spread, gaps), F.lit(0.0))
    return merged.select(
        *by, "tot", *counters, "ts_min", "ts_max", "ts_avg",
        F.when(gaps > 0, F.try_divide(F.col("_m2"), gaps)).alias("ts_var"),
        F.coalesce("_low", F.lit(0.0)).cast("bigint").alias("gap_min"),
        F.coalesce("_high", F.lit(0.0)).cast("bigint").alias("gap_max"),
        F.when(gaps > 0, F.try_divide(spread, gaps)).otherwise(0.0).alias("gap_avg"),
        F.when(gaps == 0, 0.0).when(gaps > 1, F.try_divide(gap_m2, gaps - 1)).alias("gap_var"),
    )


def time_profile(
    df: DataFrame, by: Sequence[str], ts: str, counters: Mapping[str, Column], bucket_ms: int = S.HOUR_MS,
    sample_by: str | None = None, whole: int = WHOLE_ROWS,
) -> DataFrame:
    """Counters, time and gap statistics per key.

    With ``sample_by``, a column that the rows of any key have many values of, a share of its values tells which keys have
    ``whole`` rows or more; the others are summed up in one piece instead of a state for each time bucket. The filter on that
    column reaches the tables ``df`` is joined from, if they have it.
    """
    large = None if sample_by is None else large_keys(df, by, sample_by, whole)
    return merge_states(bucket_states(df, by, ts, counters, bucket_ms, large=large), by, list(counters))


def click_profile(
    df: DataFrame, by: Sequence[str], ts: str = "ts", label: str = "clicked", sample_by: str | None = None
) -> DataFrame:
    """tot, clicks, prob, time and gap statistics per key (null is a key)."""
    out = time_profile(df, by, ts, {"clicks": F.col(label)}, sample_by=sample_by)
    return out.select(*by, "tot", "clicks", F.try_divide("clicks", "tot").alias("prob"), *TIME_STATS, *GAP_STATS)


def click_profiles(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", label: str = "clicked", sample_by: str | None = None
) -> DataFrame:
    """``click_profile`` of every key column in long form."""
    values = [ts, label] if sample_by in (None, ts, label) else [ts, label, sample_by]
    return name_keys(click_profile(stack_keys(df, keys, values), STACK, ts, label, sample_by), keys)


def train_test_profiles(
    train: DataFrame, test: DataFrame | None, keys: Sequence[str], ts: str = "ts", label: str = "clicked",
    sample_by: str | None = None, is_train: Column | None = None,
) -> DataFrame:
    """``click_profiles`` where test rows count for tot, time and gaps, and the rate comes from the training rows alone.

    ``train_tot`` are the training rows with a label; a key without any has rate 0. The label of ``test`` is not read.
    Rows of one table come as ``train`` with a mark ``is_train`` that is true or false, and no ``test``: they are read once.
    """
    values = [c for c in [sample_by] if c not in (None, ts)]
    clicks, seen = F.coalesce(label, F.lit(0)), F.col(label).isNotNull().cast("int")
    if is_train is not None:
        clicks, seen = F.when(is_train, clicks).otherwise(0), F.when(is_train, seen).otherwise(0)
    rows = train.select(*keys, ts, *values, clicks.alias("_clicks"), seen.alias("_seen"))
    if test is not None:
        rows = rows.unionByName(test.select(*keys, ts, *values, F.lit(0).alias("_clicks"), F.lit(0).alias("_seen")))
    stacked = stack_keys(rows, keys, [ts, *values, "_clicks", "_seen"])
    out = time_profile(stacked, STACK, ts, {"clicks": F.col("_clicks"), "train_tot": F.col("_seen")}, sample_by=sample_by)
    rate = F.coalesce(F.try_divide("clicks", "train_tot"), F.lit(0.0))
    return name_keys(out.select(*STACK, "tot", "train_tot", "clicks", rate.alias("prob"), *TIME_STATS, *GAP_STATS), keys)


def view_counters() -> dict[str, Column]:
    country = F.col("country_id")
    tests = [country == i for i in (1, 2, 3, 4)]
    tests += [F.col("platform") == i for i in (1, 2, 3)] + [F.col("traffic_source") == i for i in (1, 2, 3)]
    return {name: F.coalesce(t.cast("int"), F.lit(0)) for name, t in zip(VIEW_COUNTERS, tests, strict=True)}


def view_profile(views: DataFrame, by: Sequence[str], ts: str = "ts", sample_by: str | None = None) -> DataFrame:
    """The 25 page-view statistics per key. ``views`` needs country_id, platform and traffic_source."""
    out = time_profile(views, by, ts, view_counters(), sample_by=sample_by)
    clock = []
    for stat in ("min", "max", "avg"):
        at = F.floor(F.col(f"ts_{stat}"))
        clock += [S.hour_of_day(at).alias(f"hour_{stat}"), S.day_of_log(at).alias(f"day_{stat}")]
    return out.select(*by, "tot", *TIME_STATS, *GAP_STATS, *VIEW_COUNTERS, *clock)


def view_profiles(views: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """``view_profile`` of every key column in long form; the null key is left out."""
    values = [ts, "country_id", "platform", "traffic_source"]
    stacked = stack_keys(views, keys, values).where("key_num IS NOT NULL OR key_str IS NOT NULL")
    return name_keys(view_profile(stacked, STACK, ts, sample_by=ts), keys)


def with_document_keys(views: DataFrame, meta: DataFrame) -> DataFrame:
    """Page views with country id and the source, publisher and publish time of their document."""
    return views.join(meta, "document_id", "left").withColumn(
        "country_id", S.country_group_id(S.geo_part("geo_location", 1))
    )


def gap_to_previous(
    df: DataFrame, by: Sequence[str], ts: str, row_id: str, bucket_ms: int = S.HOUR_MS, name: str = "gap"
) -> DataFrame:
    """Time since the previous row of the key in (ts, id) order; null for the first row.

    Works on distinct instants: only the first row of an instant has a gap above 0. Neighbouring
    buckets are linked by a small (key, bucket) table.
    """
    points = df.groupBy(*by, ts).agg(F.min(row_id).alias("_first_id")).withColumn("_b", S.floor_div(ts, bucket_ms))
    inner = F.lag(ts).over(W.partitionBy(*by, "_b").orderBy(ts))
    links = points.groupBy(*by, "_b").agg(F.max(ts).alias("_last")).select(
        *[F.col(c).alias(f"_l_{c}") for c in by],
        F.col("_b").alias("_l_b"),
        F.lag("_last").over(W.partitionBy(*by).orderBy("_b")).alias("_bridge"),
    )
    same = F.col("_b") == F.col("_l_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    points = points.withColumn("_inner", inner).join(links, same).select(
        *[F.col(c).alias(f"_p_{c}") for c in by], F.col(ts).alias("_p_ts"), "_first_id",
        F.coalesce("_inner", "_bridge").alias("_previous"),
    )
    same = F.col(ts) == F.col("_p_ts")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    gap = F.when(F.col(row_id) == F.col("_first_id"), F.col(ts) - F.col("_previous")).otherwise(F.lit(0).cast("bigint"))
    return df.join(points, same).select(*df.columns, gap.alias(name))


# --- moments of batches that overlap in time ------------------------------------------------


def batch_moments(df: DataFrame, by: Sequence[str], batch: str, ts: str, label: str) -> DataFrame:
    """Partial state (n, clicks, mean, M2, min, max) per key and batch."""
    x = F.col(ts).cast("double")
    return df.groupBy(*by, batch).agg(
        F.count("*").alias("n"), F.sum(label).alias("clicks"), F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count("*")).alias("m2"), F.min(ts).alias("low"), F.max(ts).alias("high"),
    )


def merge_moments(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact totals from batch states in any order: M2 = sum(M2_b + n_b (mean_b - mean)^2).

    The window holds one row per batch of a key.
    """
    key = W.partitionBy(*by)
    mean = F.sum(F.col("n") * F.col("mean")).over(key) / F.sum("n").over(key)
    s = states.withColumn("_mean", mean)
    delta = F.col("mean") - F.col("_mean")
    return s.groupBy(*by).agg(
        F.sum("n").alias("tot"), F.sum("clicks").alias("clicks"), F.min("low").alias("ts_min"),
        F.max("high").alias("ts_max"), F.max("_mean").alias("ts_avg"),
        F.sum(F.col("m2") + F.col("n") * delta * delta).alias("_m2"),
    ).select(
        *by, "tot", "clicks", "ts_min", "ts_max", "ts_avg",
        F.when(F.col("tot") > 1, F.try_divide(F.col("_m2"), F.col("tot") - 1)).alias("ts_var"),
    )
