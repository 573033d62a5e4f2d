"""Rates, tables and summaries over the click log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.ranks import cumulative_before
from clickloom.session import materialise

CHI2_95 = 3.841459  # 95 % point of chi-square with one degree of freedom


def smoothed_rate(df: DataFrame, key: str, label: str, reg: float = 0, name: str = "prob", rows: str | None = None) -> DataFrame:
    """clicks, tot and clicks / (tot + reg) per key.

    ``rows`` names the number of rows that a row of ``df`` stands for, whose clicks are ``label``.
    """
    out = df.groupBy(key).agg(F.sum(label).alias("clicks"), (F.sum(rows) if rows else F.count("*")).alias("tot"))
    return out.withColumn(name, F.try_divide(F.col("clicks").cast("double"), F.col("tot") + F.lit(float(reg))))


def train_rate_all_tot(train: DataFrame, test: DataFrame, key: str, label: str = "clicked") -> DataFrame:
    """Rate from the train rows (0 for keys only in test), tot from train and test together."""
    both = train.select(key, F.col(label).alias("_y"), F.lit(1).alias("_t")).unionByName(
        test.select(key, F.lit(None).cast("int").alias("_y"), F.lit(0).alias("_t"))
    )
    out = both.groupBy(key).agg(
        F.coalesce(F.sum("_y"), F.lit(0)).alias("clicks"), F.sum("_t").alias("_train"), F.count("*").alias("tot")
    )
    prob = F.coalesce(F.try_divide(F.col("clicks"), F.col("_train")), F.lit(0.0))
    return out.select(key, "clicks", "tot", prob.alias("prob"))


def leave_one_out_rate(df: DataFrame, key: str, label: str = "clicked", reg: float = 0) -> DataFrame:
    """Per row, the key's rate without the row itself: no leak of the row's own label."""
    totals = df.groupBy(key).agg(F.sum(label).alias("_c"), F.count("*").alias("_n")).withColumnRenamed(key, "_key")
    joined = df.join(totals, F.col(key).eqNullSafe(F.col("_key")))
    rate = F.try_divide((F.col("_c") - F.col(label)).cast("double"), F.col("_n") - 1 + F.lit(float(reg)))
    return joined.select(*df.columns, F.coalesce(rate, F.lit(0.0)).alias("prob"))


def overall_rate(df: DataFrame, label: str, reg: float = 0, name: str = "rate") -> DataFrame:
    """One row; null over no rows."""
    return df.agg(F.try_divide(F.sum(label).cast("double"), F.count("*") + F.lit(float(reg))).alias(name))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.sum(label).cast("bigint").alias("positives"), F.sum(1 - F.col(label)).cast("bigint").alias("negatives")
    ).withColumn("ratio", F.try_divide("negatives", "positives"))


def distinct_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*by).agg(*[count(F.col(c)).alias(c) for c in columns])


def numeric_summary(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float] | None = None) -> DataFrame:
    """Exact min, quartiles, mean, max and null count per column.

    Values are counted first, then placed by range partitions; the order statistics are read off the
    cumulative counts, so no task ever holds a column.
    """
    probs = probs or {"q1": 0.25, "median": 0.5, "q3": 0.75}
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    counts = materialise(counts)
    known = counts.where("value IS NOT NULL")
    totals = known.groupBy("column").agg(F.sum("n").alias("total"))  # one row per column
    ranked = cumulative_before(known, ["column"], "value", ["n"]).withColumn("upto", F.col("n_before") + F.col("n"))
    ranked = ranked.join(F.broadcast(totals), "column")
    stats = [
        F.min("value").alias("min"), F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
    ]
    for name, p in probs.items():
        at = 1 + (F.col("total") - 1) * p
        low = F.min(F.when(F.col("upto") >= F.floor(at), F.col("value")))
        high = F.min(F.when(F.col("upto") >= F.ceil(at), F.col("value")))
        share = F.max(at - F.floor(at))
        stats.append((low + (high - low) * share).alias(name))
    nulls = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls")
    )
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column") + 1)
    return ranked.groupBy("column").agg(*stats).join(nulls, "column", "right").select(
        name.alias("column"), "min", *probs, "mean", "max", "nulls"
    )


def frequency_table(df: DataFrame, value: str, split: str) -> DataFrame:
    return df.groupBy(split, value).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Two-way counts with the column values given, so no extra pass looks for them."""
    return df.groupBy(row).agg(
        *[F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(f"{column}_{v}") for v in values]
    )


def label_correlations(df: DataFrame, label: str, columns: Sequence[str], floor: float | None = None) -> DataFrame:
    """Pearson correlation of each column with the label in one pass; null for a constant column."""
    y = F.col(label).cast("double")
    exprs = []
    for c in columns:
        x = F.col(c).cast("double")
        exprs.append(
            F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))).alias(c)
        )
    one = df.agg(*exprs)
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("corr")) for c in columns])).alias("s"))
    long = long.select("s.column", "s.corr")
    return long if floor is None else long.where(F.abs("corr") > floor)


def _level_counts(df: DataFrame, level: str, label: str) -> DataFrame:
    return df.groupBy(F.col(level).alias("level")).agg(
        F.sum(label).cast("bigint").alias("good"), F.sum(1 - F.col(label)).cast("bigint").alias("bad")
    )


def woe_iv(df: DataFrame, level: str, label: str, smoothing: float = 0.0) -> DataFrame:
    """Weight of evidence and information value per level; null for an empty cell without smoothing.

    The level counts are written once; the totals come from them, not from another scan.
    """
    counts = materialise(_level_counts(df, level, label))
    levels = smoothing * counts.agg(F.count("*")).scalar()
    good = (F.col("good") + smoothing) / (counts.agg(F.sum("good")).scalar() + levels)
    bad = (F.col("bad") + smoothing) / (counts.agg(F.sum("bad")).scalar() + levels)
    woe = F.when((F.col("good_share") > 0) & (F.col("bad_share") > 0), F.ln(F.col("good_share") / F.col("bad_share")))
    return (
        counts.withColumns({"good_share": good, "bad_share": bad})
        .withColumn("woe", woe)
        .withColumn("iv", (F.col("good_share") - F.col("bad_share")) * F.col("woe"))
    )


def chi2_levels(df: DataFrame, level: str, label: str) -> DataFrame:
    """Per level, the continuity-corrected 2 x 2 chi-square of (label, is the level) and the click rate."""
    counts = materialise(_level_counts(df, level, label))
    good_all = counts.agg(F.sum("good")).scalar().cast("double")
    bad_all = counts.agg(F.sum("bad")).scalar().cast("double")
    c = counts.withColumns({"g": good_all, "b": bad_all})
    n, size = F.col("g") + F.col("b"), F.col("good") + F.col("bad")
    cells = {
        "e1": ("o1", F.col("good").cast("double"), size * F.col("g") / n),
        "e2": ("o2", F.col("bad").cast("double"), size * F.col("b") / n),
        "e3": ("o3", F.col("g") - F.col("good"), (n - size) * F.col("g") / n),
        "e4": ("o4", F.col("b") - F.col("bad"), (n - size) * F.col("b") / n),
    }
    c = c.withColumns({k: v for e, (o, obs, exp) in cells.items() for k, v in ((e, exp), (o, obs))})
    dev = [F.abs(F.col(o) - F.col(e)) for e, (o, _, _) in cells.items()]
    correction = F.least(F.lit(0.5), *dev)
    chi2 = sum((F.try_divide(F.pow(d - correction, F.lit(2)), F.col(e)) for d, e in zip(dev, cells, strict=True)), F.lit(0.0))
    return c.withColumn("chi2", chi2).select(
        "level", "good", "bad", "chi2",
        (F.col("chi2") > CHI2_95).alias("significant"),
        F.try_divide(100.0 * F.col("good"), size).alias("rate"),
    )


def density_2d(df: DataFrame, x: str, y: str, y_low: int, y_high: int, bins: int) -> DataFrame:
    """Counts per value of x and equal-width bin 1..bins of y."""
    b = F.floor((F.col(y) - y_low) * bins / F.lit(y_high - y_low + 1)) + 1
    return df.groupBy(x, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def rank_statistics(df: DataFrame, feature: str, rank: str) -> DataFrame:
    """Worst, best, mean and spread of a feature's rank over models."""
    return df.groupBy(feature).agg(
        F.max(rank).alias("mx"), F.min(rank).alias("mn"), F.avg(rank).alias("av"),
        F.stddev_samp(rank).alias("sd"), F.count("*").alias("cnt"),
    )


def row_mean(columns: Sequence[str]) -> Column:
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    words = F.explode(F.filter(F.split(F.col(text), " "), lambda w: w != ""))
    return df.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def group_size_histogram(df: DataFrame, group: str) -> DataFrame:
    """Groups and rows by group size."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"), F.sum("size").alias("rows"))


def ranking_auc(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """ROC area per group: the chance that a positive outscores a negative, ties counting half."""
    by = list(by)
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(label).cast("bigint").alias("pos"), F.sum(1 - F.col(label)).cast("bigint").alias("neg")
    )
    placed = cumulative_before(counts, by, score, ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    area = F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg"))
    return placed.groupBy(*by).agg(area.alias("auc"))


def filter_importance(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """ROC area of each feature alone (either direction), scaled so that the best is 100."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(label, F.explode(cells).alias("c")).select(label, "c.*")
    areas = ranking_auc(long, ["feature"], "v", label).select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"))
    areas = materialise(areas)  # one row per feature, used twice
    return areas.withColumn("importance", F.try_divide(100 * F.col("auc"), areas.agg(F.max("auc")).scalar()))
