"""The smoothed-rate baseline: score ads by their click rate, unseen ads by a default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.aggregates import overall_rate, smoothed_rate
from clickloom.operators.joins import keep_known, keep_unknown, with_default_rate
from clickloom.plans.ranking import map_by_ranges

DEFAULT_DAY_RANGES = ((1, 11), (12, 13), (1, 13))
TRAINING_DAY_RANGES = ((1, 3), (3, 5), (5, 7), (7, 9), (9, 11), (11, 13), *DEFAULT_DAY_RANGES)


def default_rate(train: DataFrame, valid: DataFrame, k: int, reg: float, label: str = "clicked") -> DataFrame:
    """Click rate for unseen ads: 1 = train rows whose ad is in valid, 2 = is not, 3 = all rows."""
    rows = {1: lambda: keep_known(train, valid, "ad_id"), 2: lambda: keep_unknown(train, valid, "ad_id"), 3: lambda: train}[k]()
    return overall_rate(rows, label, reg)


def baseline_scores(train: DataFrame, valid: DataFrame, k: int = 2, reg: float = 4, label: str = "clicked") -> DataFrame:
    """``valid`` with ``prob``: the ad's smoothed train rate, else the default."""
    rates = smoothed_rate(train, "ad_id", label, reg)
    return with_default_rate(valid, rates, "ad_id", "prob", default_rate(train, valid, k, reg, label).scalar())


def grid_column(k: int, reg: int) -> str:
    return f"k{k}_reg{reg}"


def baseline_grid(train: DataFrame, valid: DataFrame, ks=(1, 2, 3), regs=(0, 3, 4, 5, 6), label: str = "clicked") -> DataFrame:
    """``valid`` with one score column ``k<k>_reg<reg>`` per parameter pair, from one join.

    The train sums per ad are computed once; the grid adds columns, not rows.
    """
    in_valid = valid.select("ad_id").distinct().withColumn("_in", F.lit(1))
    ads = train.groupBy("ad_id").agg(F.sum(label).alias("c"), F.count("*").alias("n"))
    marked = ads.join(in_valid, "ad_id", "left")
    sums = marked.agg(
        F.sum(F.when(F.col("_in") == 1, F.col("c"))).alias("c1"), F.sum(F.when(F.col("_in") == 1, F.col("n"))).alias("n1"),
        F.sum(F.when(F.col("_in").isNull(), F.col("c"))).alias("c2"), F.sum(F.when(F.col("_in").isNull(), F.col("n"))).alias("n2"),
        F.sum("c").alias("c3"), F.sum("n").alias("n3"),
    ).first()  # six numbers
    columns = []
    for k in ks:
        c, n = sums[f"c{k}"], sums[f"n{k}"]
        for reg in regs:
            default = None if c is None or n + reg == 0 else c / (n + reg)
            rate = F.try_divide(F.col("c").cast("double"), F.col("n") + F.lit(float(reg)))
            columns.append(F.coalesce(rate, F.lit(default).cast("double")).alias(grid_column(k, reg)))
    return valid.join(ads, "ad_id", "left").select(*valid.columns, *columns)


def baseline_grid_map(
    train: DataFrame, valid: DataFrame, ks=(1, 2, 3), regs=(0, 3, 4, 5, 6), ranges=DEFAULT_DAY_RANGES, one_click: bool = False
) -> DataFrame:
    """(k, reg, day_from, day_to, map12) of the whole grid."""
    grid = baseline_grid(train, valid, ks, regs)
    out = map_by_ranges(grid, ranges, scores=[grid_column(k, r) for k in ks for r in regs], one_click=one_click)
    number = [F.regexp_extract("score", f"{p}([0-9]+)", 1).cast("int").alias(n) for p, n in (("^k", "k"), ("_reg", "reg"))]
    return out.select(*number, "day_from", "day_to", "map12")
