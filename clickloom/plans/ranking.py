"""Ranking evaluation: average precision, MAP@k, losses and ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.ranks import global_position, rows_ahead, top_k

GROUP, ITEM, LABEL, SCORE = "display_id", "ad_id", "clicked", "prob"


def click_positions(
    df: DataFrame, group: Sequence[str] = (GROUP,), item: str = ITEM, label: str = LABEL,
    score: str | Sequence[str] = SCORE, keep=(), one_click: bool = False,
) -> DataFrame:
    """Position of every clicked item in its own group, and the group size.

    ``one_click`` says that the data allow one click per group, which saves a look at the click counts.
    """
    scores = [score] if isinstance(score, str) else score
    few = {"few_marks": None} if one_click else {}
    return rows_ahead(df, F.col(label) == 1, group, item, scores, keep, **few)


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def map_single(df: DataFrame, **names) -> DataFrame:
    """Mean of 1 / position over the clicks; 0 without any."""
    return click_positions(df, **names).agg(
        mean_or_zero(1 / F.col("position")).alias("map"), F.count("*").alias("clicks")
    )


def average_precision_at_k(
    df: DataFrame, k: int, group: str = GROUP, item: str = ITEM, label: str = LABEL, score: str = SCORE
) -> DataFrame:
    """(group, ap) for groups with at least one relevant item.

    ap = sum over hits among the first k of (hits so far / position), divided by min(#relevant, k).
    """
    relevant = df.groupBy(group).agg(F.sum(label).alias("relevant")).where("relevant > 0")
    first = top_k(df.select(group, item, label, score), [group], [F.desc(score), F.asc(item)], k)
    hits = top_k(first.where(F.col(label) == 1), [group], [F.asc("position")], k, "hits")
    gained = hits.groupBy(group).agg(F.sum(F.col("hits") / F.col("position")).alias("gain"))
    ap = F.coalesce("gain", F.lit(0.0)) / F.least("relevant", F.lit(k))
    return relevant.join(gained, group, "left").select(group, ap.alias("ap"))


def map_at_k(df: DataFrame, k: int, **names) -> DataFrame:
    return average_precision_at_k(df, k, **names).agg(mean_or_zero(F.col("ap")).alias("map"), F.count("*").alias("groups"))


def average_precision_with_repeats(
    predicted: DataFrame, relevant: DataFrame, k: int, group: str, item: str, order_by: Sequence[Column]
) -> DataFrame:
    """(group, ap) for predicted lists that may repeat an item.

    A repeat keeps its position but is no hit; groups without a relevant item get 0.
    ``relevant`` holds distinct (group, item) rows.
    """
    listed = top_k(predicted, [group], order_by, k).groupBy(group, item).agg(F.min("position").alias("position"))
    hits = top_k(listed.join(relevant, [group, item], "left_semi"), [group], [F.asc("position")], k, "hits")
    gained = hits.groupBy(group).agg(F.sum(F.col("hits") / F.col("position")).alias("gain"))
    sizes = relevant.groupBy(group).agg(F.count("*").alias("relevant"))
    groups = predicted.select(group).distinct().join(sizes, group, "left").join(gained, group, "left")
    ap = F.coalesce(F.col("gain") / F.least("relevant", F.lit(k)), F.lit(0.0))
    return groups.select(group, ap.alias("ap"))


def map_by_ranges(
    df: DataFrame, ranges: Sequence[tuple[int, int]], day: str = "day", scores: Sequence[str] = (SCORE,), **names
) -> DataFrame:
    """(day_from, day_to, map12) for overlapping day ranges, 0 for an empty range.

    With several score columns there is one row per score and range, all from one pass over the positions.
    """
    scores = list(scores)
    positions = click_positions(df, keep=[day], score=scores, **names)
    one = len(scores) == 1
    cells = [
        F.struct(
            *([] if one else [F.lit(s).alias("score")]),
            F.lit(lo).alias("day_from"), F.lit(hi).alias("day_to"),
            mean_or_zero(F.when(F.col(day).between(lo, hi), 1 / F.col("position" if one else f"position_{s}"))).alias("map12"),
        )
        for s in scores
        for lo, hi in ranges
    ]
    return positions.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def improvement_by_size(df: DataFrame, **names) -> DataFrame:
    """MAP by group size against the chance rate 1 / size, in two forms."""
    m = click_positions(df, **names).groupBy("group_size").agg(F.avg(1 / F.col("position")).alias("map12"))
    p = 1 / F.col("group_size")
    return m.select(
        F.col("group_size").alias("num_ads"), "map12", p.alias("chance"),
        (100 * (F.col("map12") - p) * (1 - p)).alias("gain"),
        F.try_divide(100 * (F.col("map12") - p), 1 - p).alias("gain_norm"),
    )


def log_loss(df: DataFrame, label: str = LABEL, score: str = SCORE, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    loss = F.avg(-(F.col(label) * F.ln(p) + (1 - F.col(label)) * F.ln(1 - p)))
    return df.agg(loss.alias("log_loss")).withColumn("score", 1 - F.col("log_loss"))


def sequence_positions(df: DataFrame, labels: str, scores: str) -> Column:
    """Position of the first largest label in the scores sorted descending, ties by higher index first."""
    best = F.array_position(F.col(labels), F.array_max(labels)).cast("int") - 1
    target = F.element_at(F.col(scores), best + 1)
    ahead = F.filter(F.col(scores), lambda x, i: (x > target) | ((x == target) & (i >= best)))
    return F.size(ahead)


def confusion(df: DataFrame, threshold: float, label: str = LABEL, score: str = SCORE) -> DataFrame:
    return df.groupBy(label, (F.col(score) > threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, threshold: float, label: str = LABEL, score: str = SCORE) -> DataFrame:
    return df.agg(F.avg(((F.col(score) > threshold).cast("int") == F.col(label)).cast("int")).alias("accuracy"))


def global_average_precision(
    df: DataFrame, label: str = LABEL, score: str = SCORE, tie_break: Sequence[str] = (GROUP, ITEM)
) -> DataFrame:
    """AP over one list of all rows: mean over positives of (positives so far / rows so far)."""
    order = [F.desc(score), *[F.asc(c) for c in tie_break]]
    placed = global_position(df.select(label, score, *tie_break), order, "row")
    positives = global_position(placed.where(F.col(label) == 1).select("row"), [F.asc("row")], "hit")
    return positives.agg(mean_or_zero(F.col("hit") / F.col("row")).alias("ap"), F.count("*").alias("positives"))


def ranked_lists(df: DataFrame, group: str = GROUP, item: str = ITEM, score: str = SCORE) -> DataFrame:
    """Items of each group by score descending, joined by blanks. The result row is the whole list."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))))
    text = F.array_join(F.transform(ranked, lambda r: r["i"].cast("string")), " ")
    return df.groupBy(group).agg(text.alias(item))
