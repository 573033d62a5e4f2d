"""Row positions that no single task has to hold.

``global_position`` numbers a whole table; ``rank_in_group`` numbers rows inside groups and
handles groups too large for one task through the same range-partitioned path.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.session import materialise

HOT_GROUP_ROWS = 5_000_000
FEW_MARKS = 32
_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def global_position(df: DataFrame, order_by: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based position of every row in the given total order.

    Range partitioning by the full order (ending in a unique id) keeps partitions even when one
    value fills a third of the table. The sorted rows are checkpointed, so the sampled range
    bounds are the same for the partition sizes and for the rows.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered = materialise(ordered.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the sorted table: small by construction.
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local + 1)
        .drop("_mid", "_part", "_before")
    )


def rank_in_group(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[Column],
    name: str = "position",
    hot_rows: int = HOT_GROUP_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """1-based position inside each group (``order_by`` must end in a unique id).

    The group sizes are looked at first (a column-pruned, map-side combined count over ``sizes_from``,
    a cheaper table with at least as many rows per group, or over the rows themselves). Groups above
    ``hot_rows`` are numbered by range partitions instead of by one window task; there are at most
    rows / hot_rows of them, and the engine chooses the join by their measured size.
    """
    by = list(by)
    counted = df if sizes_from is None else sizes_from
    hot = counted.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows).select(*by)
    window = F.row_number().over(W.partitionBy(*by).orderBy(*order_by)).cast("bigint")
    if hot.isEmpty():
        return df.withColumn(name, window)
    hot = materialise(hot.select(*[F.col(c).alias(f"_h_{c}") for c in by]))
    same = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in by])
    cold_rows = df.join(hot, same, "left_anti").withColumn(name, window)
    placed = global_position(df.join(hot, same, "left_semi"), [*[F.col(c) for c in by], *order_by], "_pos")
    first = placed.groupBy(*[F.col(c).alias(f"_h_{c}") for c in by]).agg((F.min("_pos") - 1).alias("_start"))
    hot_ranked = (
        placed.join(first, same)
        .withColumn(name, F.col("_pos") - F.col("_start"))
        .select(*df.columns, name)
    )
    return cold_rows.unionByName(hot_ranked)


def rows_ahead(
    df: DataFrame,
    marked: Column,
    group: Sequence[str],
    item: str,
    scores: Sequence[str],
    keep: Sequence[str] = (),
    few_marks: int | None = FEW_MARKS,
) -> DataFrame:
    """Position of each marked row in its group by (score desc, item asc); null scores come last, null items first.

    Where a group has few marked rows they meet their group in an equi-join and the rows ahead are
    counted: nothing is ranked, a hot group is split by the skew join and combined map-side. Groups
    with more than ``few_marks`` marked rows are ranked instead, since a join would pair every mark
    with every row; None skips that look when the data allow one mark per group only. Several score
    columns share the work and give ``position_<score>`` each, a single one gives ``position``.
    """
    group, scores = list(group), list(scores)
    names = {s: "position" if len(scores) == 1 else f"position_{s}" for s in scores}
    if few_marks is not None:
        marks = df.where(marked).groupBy(*group).agg(F.count("*").alias("_marks"))
        crowded = marks.where(F.col("_marks") > few_marks).select(*group)
        if not crowded.isEmpty():
            crowded = materialise(crowded)
            ranked = materialise(df.withColumn("_mark", marked).join(crowded, group, "left_semi"))
            sizes = ranked.groupBy(*group).agg(F.count("*").alias("group_size"))
            for s in scores:
                ranked = rank_in_group(ranked, group, [F.desc(s), F.asc(item)], names[s])
            ranked = ranked.where("_mark").join(sizes, group).select(*group, item, *keep, *names.values(), "group_size")
            rest = rows_ahead(df.join(crowded, group, "left_anti"), marked, group, item, scores, keep, None)
            return rest.unionByName(ranked)
    target = df.where(marked).select(
        *group, F.col(item).alias("_item"), *[F.col(s).alias(f"_s_{s}") for s in scores], *[F.col(c).alias(f"_k_{c}") for c in keep]
    )

    def ahead(s: str) -> Column:
        own, first = F.col(f"_s_{s}"), F.coalesce(F.col(item) <= F.col("_item"), F.col(item).isNull())
        higher = F.when(own.isNull(), F.col(s).isNotNull()).otherwise(F.coalesce(F.col(s) > own, F.lit(False)))
        return higher | (F.col(s).eqNullSafe(own) & first)

    return (
        df.select(*group, item, *scores)
        .join(target, group)
        .groupBy(*group, F.col("_item").alias(item), *[F.col(f"_k_{c}").alias(c) for c in keep])
        .agg(*[F.count_if(ahead(s)).alias(names[s]) for s in scores], F.count("*").alias("group_size"))
    )


def top_k(df: DataFrame, by: Sequence[str], order_by: Sequence[Column], k: int, name: str = "position") -> DataFrame:
    """The first k rows of each group with their position.

    Spark turns the filter on ``row_number`` into a group limit inside every map task, so at most
    k rows per group and task are shuffled.
    """
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order_by))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def group_totals(df: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Group aggregates on every row, as aggregate + join instead of a partition-wide window.

    The aggregate combines map-side and the join splits hot keys; null keys match each other.
    """
    by = list(by)
    right = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(*[e.alias(n) for n, e in totals.items()])
    same = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])
    return df.join(right, same).drop(*[f"_g_{c}" for c in by])


def cumulative_before(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Sums over the rows with a smaller value in the same group, as ``<sum>_before``.

    Rows must be distinct in (by, value). They are range-partitioned, so a group may span any number
    of tasks; per-partition subtotals link the pieces.
    """
    by = list(by)
    order = [*[F.col(c) for c in by], F.col(value)]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumn("_part", F.spark_partition_id()))
    inner = W.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    pieces = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    across = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = pieces.select(*by, "_part", *[F.coalesce(F.sum(f"_{c}").over(across), zero).alias(f"_o_{c}") for c in sums])
    local = placed.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(inner), zero) for c in sums})
    joined = local.join(offsets, [*by, "_part"])
    return joined.select(*df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums])
