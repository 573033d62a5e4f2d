"""Naive Bayes with kernel densities, as aggregates over binned values and one scoring join.

A numeric feature is cut into equal bins of its range. A class's density at a bin is the Gaussian kernel sum over the
bins' counts, made to add up to one; the bandwidth is ``adjust`` times 0.9 sd n^(-1/5) of the class. Features of whole
codes have (count + laplace) / (n + laplace levels). A cross-validation needs one histogram of all rows by fold: what a
fold's model has seen is the total without the fold's own counts. A fold's models are one row of log ratios by
feature and bin, bounded by bins and levels, and all cells of the grid are judged in the same pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.splits import kfold
from clickloom.session import materialise


@dataclass(frozen=True)
class Ranges:
    """Lowest and highest value of the numeric features, in their order; none where a feature has no value."""

    features: tuple[str, ...]
    bounds: tuple[tuple[float, float] | None, ...]
    bins: int


def value_ranges(df: DataFrame, numeric: Sequence[str], bins: int) -> Ranges:
    aggs = [f(F.col(c).cast("double")) for c in numeric for f in (F.min, F.max)]
    row = df.agg(*aggs).first() if aggs else ()
    pairs = [(row[2 * i], row[2 * i + 1]) for i in range(len(numeric))]
    return Ranges(tuple(numeric), tuple(p if p[0] is not None else None for p in pairs), bins)


def bin_of(name: str, bounds: tuple[float, float] | None, bins: int) -> Column:
    """0 to ``bins`` - 1; null stays null. A constant feature has one bin."""
    if bounds is None or bounds[0] == bounds[1]:
        return F.when(F.col(name).isNotNull(), 0)
    low, high = bounds
    at = F.floor((F.col(name).cast("double") - F.lit(low)) / F.lit(high - low) * bins)
    return F.when(F.col(name).isNotNull(), F.least(at, F.lit(bins - 1)).cast("int"))


def _seen(hist: DataFrame, folds: int) -> DataFrame:
    """(fold, feature, bin, n0, n1): what the training rows of each fold hold, for every bin that occurs at all."""
    total = hist.groupBy("feature", "bin").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    each = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    own = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    return each.join(hist, ["fold", "feature", "bin"], "left").select(
        "fold", "feature", "bin", (F.col("t0") - own[0]).alias("n0"), (F.col("t1") - own[1]).alias("n1")
    )


def _kernel_ratios(seen: DataFrame, adjust: Sequence[float], threshold: float) -> DataFrame:
    """(fold, feature, bin, ratio by adjust) of the binned numeric features; distances are in bins."""
    x = F.col("bin").cast("double")
    long = seen.select("fold", "feature", "bin", F.explode(F.array(
        F.struct(F.lit(0).alias("c"), F.col("n0").alias("n")), F.struct(F.lit(1).alias("c"), F.col("n1").alias("n"))
    )).alias("x")).select("fold", "feature", "bin", "x.c", "x.n")
    by = ["fold", "feature", "c"]
    moments = long.groupBy(*by).agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * x).alias("s"), F.sum(F.col("n") * x * x).alias("q")
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("m"), F.col("m") - 1)))
    # A class without spread has all its weight in one bin at any bandwidth.
    width = F.greatest(0.9 * F.coalesce(spread, F.lit(0.0)) * F.pow("m", F.lit(-0.2)), F.lit(1e-6))
    moments = moments.where("m > 0").select(*by, width.alias("width"))
    others = long.select(*by, F.col("bin").alias("other"), F.col("n").alias("weight")).where("weight > 0")
    sums = long.join(others, by).join(moments, by).groupBy(*by, "bin").agg(*[
        F.sum(F.col("weight") * F.exp(-0.5 * F.pow((F.col("bin") - F.col("other")) / (F.lit(a) * F.col("width")), F.lit(2)))).alias(f"k{i}")
        for i, a in enumerate(adjust)
    ])
    whole = sums.groupBy(*by).agg(*[F.sum(f"k{i}").alias(f"w{i}") for i in range(len(adjust))])
    dens = sums.join(whole, by).select(*by, "bin", F.array(*[
        F.greatest(F.col(f"k{i}") / F.col(f"w{i}"), F.lit(threshold)) for i in range(len(adjust))
    ]).alias("p"))
    pair = dens.groupBy("fold", "feature", "bin").agg(
        F.max(F.when(F.col("c") == 0, F.col("p"))).alias("p0"), F.max(F.when(F.col("c") == 1, F.col("p"))).alias("p1")
    ).where("p0 IS NOT NULL AND p1 IS NOT NULL")
    return pair.select("fold", "feature", "bin", F.zip_with("p1", "p0", lambda a, b: F.log(a / b)).alias("ratio"))


def _code_ratios(seen: DataFrame, laplace: Sequence[float], threshold: float) -> DataFrame:
    by = ["fold", "feature"]
    sums = seen.groupBy(*by).agg(F.sum("n0").alias("m0"), F.sum("n1").alias("m1"), F.count("*").alias("levels"))

    def ratio(a: float) -> Column:
        p = [F.greatest((F.col(f"n{c}") + F.lit(a)) / (F.col(f"m{c}") + F.lit(a) * F.col("levels")), F.lit(threshold)) for c in (0, 1)]
        return F.log(p[1] / p[0])

    usable = seen.join(sums, by).where("m0 > 0 AND m1 > 0")
    return usable.select(*by, "bin", F.array(*[ratio(a) for a in laplace]).alias("ratio"))


def kernel_bayes_grid(
    df: DataFrame, numeric: Sequence[str], codes: Sequence[str], group: str, label: str = "clicked",
    laplace: Sequence[float] = (1.0, 100.0), adjust: Sequence[float] = (0.001, 0.1), folds: int = 5, bins: int = 64,
    seed: int = 1, threshold: float = 0.001,
) -> DataFrame:
    """(laplace, adjust, accuracy, best): accuracy over the folds' held-out rows, averaged, for each cell of the grid.

    Folds go by ``group``. ``codes`` are columns of whole numbers with few values. A null value says nothing about its
    row; rows without a label are left out; a probability below ``threshold`` counts as that. A fold without rows of a
    class predicts the other one. The best cell is the first with the highest accuracy. An empty table has no accuracy.
    """
    # The rows are computed once, and once more written with their folds: seven passes look at them.
    rows = materialise(df.where(F.col(label).isNotNull()).select(group, label, *numeric, *codes))
    ranges = value_ranges(rows, numeric, bins)
    binned = [bin_of(c, b, bins) for c, b in zip(ranges.features, ranges.bounds, strict=True)] + [F.col(c).cast("int") for c in codes]
    keyed = kfold(rows.select(group, F.col(label).cast("int").alias("_y"), F.array(*binned).alias("_bins")), group, folds, seed)
    keyed = materialise(keyed.select("fold", "_y", "_bins"))
    hist = (
        keyed.select("fold", "_y", F.posexplode("_bins").alias("feature", "bin")).where("bin IS NOT NULL")
        .groupBy("fold", "feature", "bin").agg(F.sum(1 - F.col("_y")).alias("n0"), F.sum("_y").alias("n1"))
    )
    seen = _seen(hist, folds)
    kernels = _kernel_ratios(seen.where(F.col("feature") < len(numeric)), adjust, threshold)
    levels = _code_ratios(seen.where(F.col("feature") >= len(numeric)), laplace, threshold)

    def models(ratios: DataFrame, name: str) -> DataFrame:
        one = ratios.groupBy("fold", "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "ratio"))).alias("by_bin"))
        return one.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", "by_bin"))).alias(name))

    counts = keyed.groupBy("fold").agg(F.sum(1 - F.col("_y")).alias("o0"), F.sum("_y").alias("o1"))
    whole = counts.agg(F.sum("o0").alias("t0"), F.sum("o1").alias("t1"))
    t0, t1 = whole.first()
    seen0, seen1 = F.lit(t0 or 0) - F.col("o0"), F.lit(t1 or 0) - F.col("o1")
    prior = counts.select("fold", F.when(seen0 == 0, float("inf")).when(seen1 == 0, float("-inf")).otherwise(F.log(seen1 / seen0)).alias("prior"))
    # folds x features x bins entries: bounded by the parameters and the codes' few values.
    model = prior.join(models(kernels, "kernels"), "fold", "left").join(models(levels, "levels"), "fold", "left")
    scored = keyed.join(F.broadcast(model), "fold")

    def evidence(name: str, features: range, cell: int) -> Column:
        parts = [F.coalesce(F.col(name)[F.lit(f)][F.get("_bins", F.lit(f))][cell], F.lit(0.0)) for f in features]
        return sum(parts, F.lit(0.0))

    n, m = len(numeric), len(numeric) + len(codes)
    grid = [(i, j) for i in range(len(laplace)) for j in range(len(adjust))]
    right = [
        F.avg(((F.col("prior") + evidence("kernels", range(n), j) + evidence("levels", range(n, m), i) > 0).cast("int") == F.col("_y")).cast("double"))
        .alias(f"a{i}_{j}") for i, j in grid
    ]
    per_fold = scored.groupBy("fold").agg(*right)
    means = per_fold.agg(*[F.avg(f"a{i}_{j}").alias(f"a{i}_{j}") for i, j in grid]).first()  # a number for each cell
    found = [means[f"a{i}_{j}"] for i, j in grid]
    shown = [-1.0 if x is None else round(x, 9) for x in found]  # sums in another order must not change the choice
    best = shown.index(max(shown)) if max(shown) >= 0 else -1
    data = [(float(laplace[i]), float(adjust[j]), found[k], k == best) for k, (i, j) in enumerate(grid)]
    return df.sparkSession.createDataFrame(data, "laplace double, adjust double, accuracy double, best boolean")
