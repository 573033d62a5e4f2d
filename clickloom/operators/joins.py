"""Keyed joins of the click-log pipeline.

No operator forces a broadcast on data that grows: adaptive execution broadcasts a side after
measuring it and splits hot keys of a sort-merge join otherwise.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def join_left_fill(df: DataFrame, right: DataFrame, on: Sequence[str] | str, fill: Sequence[str]) -> DataFrame:
    """Left join, then 0 in the listed columns where nothing matched."""
    return df.join(right, on, "left").fillna(0, subset=list(fill))


def join_null_safe(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other, keeping the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = df.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def keep_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``known``. The key side is reduced to distinct ids first."""
    return df.join(known.select(key).distinct(), key, "left_semi")


def keep_unknown(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_anti")


def integrity_report(relations: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(relation, orphans): child keys missing in the parent, one row per (name, child, key, parent, key)."""
    rows = []
    for name, child, key, parent, parent_key in relations:
        missing = (
            child.select(F.col(key).alias("k")).distinct()
            .join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
        )
        rows.append(missing.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relation"), "orphans"))
    return reduce(DataFrame.unionByName, rows)


def key_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of each side found and not found in the other, from one full outer join."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )
    share = lambda only: F.try_divide(F.col("common"), F.col("common") + F.col(only))
    return both.select("common", "only_a", "only_b", share("only_a").alias("a_in_b"), share("only_b").alias("b_in_a"))


def accumulate(state: DataFrame, batch: DataFrame, key: str, sums: Sequence[str], lows=(), highs=()) -> DataFrame:
    """Merge two per-key states (full outer): counters add up, extremes are kept."""
    renamed = batch.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in (*sums, *lows, *highs)])
    joined = state.join(renamed, F.col(key).eqNullSafe(F.col("_k")), "full")
    # A row without a state side takes its key from the batch.
    return joined.select(
        F.coalesce(F.col(key), F.col("_k")).alias(key),
        *[(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums],
        *[F.least(F.col(c), F.col(f"_{c}")).alias(c) for c in lows],
        *[F.greatest(F.col(c), F.col(f"_{c}")).alias(c) for c in highs],
    )


def with_default_rate(df: DataFrame, rates: DataFrame, on: str, rate: str, default: Column) -> DataFrame:
    """Left join a rate table; keys without a rate get the default."""
    return df.join(rates.select(on, rate), on, "left").withColumn(rate, F.coalesce(F.col(rate), default))


def time_bucket_coverage(
    events: DataFrame, views: DataFrame, group: str, keys: Sequence[str], ts: str, unit_ms: int, widths: Sequence[int]
) -> DataFrame:
    """Share of groups with a page view of the same keys in the same time bucket, per bucket width.

    Events meet distinct (keys, width, bucket) rows in a semi-join, so no event x view pairs arise.
    """
    width = F.explode(F.array(*[F.lit(w) for w in widths])).alias("width")
    bucket = F.expr(f"`{ts}` - pmod(`{ts}`, width * {unit_ms}L)")
    # Both sides are first reduced to keys the other side has.
    seen = keep_pairs(views, events, keys).select(*keys, ts).distinct().select(*keys, ts, width)
    seen = seen.select(*keys, "width", bucket.alias("bucket")).distinct()
    possible = keep_pairs(events, views, keys).select(group, *keys, ts, width)
    hit = possible.select(group, *keys, "width", bucket.alias("bucket")).join(
        seen, [*keys, "width", "bucket"], "left_semi"
    )
    hits = hit.groupBy("width").agg(F.count_distinct(group).alias("hits"))
    spine = events.sparkSession.createDataFrame([(int(w),) for w in widths], "width int")
    total = events.agg(F.count_distinct(group).alias("n"))
    counted = spine.join(hits, "width", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return counted.select(
        "width", "hits", F.try_divide(F.col("hits"), total.scalar()).alias("coverage")
    )


def keep_pairs(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


