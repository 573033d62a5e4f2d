"""Models per group size on a bounded number of rows, and the bounded sets themselves."""

import hashlib

from pyspark.sql import functions as F

from clickloom.operators.splits import first_groups
from clickloom.plans import models as M
from clickloom.plans.ranking import improvement_by_size


def brute_first(rows, limit, seed):
    """Whole groups in hash order while a stratum's rows stay within the limit."""
    def key(g):
        return hashlib.md5((f"{seed}" if g is None else f"{seed}:{g}").encode()).hexdigest()

    out = set()
    for s in {r[1] for r in rows}:
        groups = sorted({r[0] for r in rows if r[1] == s}, key=key)
        taken = 0
        for g in groups:
            taken += sum(r[0] == g and r[1] == s for r in rows)
            if taken > limit:
                break
            out |= {r for r in rows if r[0] == g and r[1] == s}
    return out


def test_first_groups_are_whole_and_bounded(spark):
    rows = [(g, g % 4 + 2, i) for g in range(300) for i in range(g % 4 + 2)]
    rows += [(None, 2, 0), (None, 2, 1), (None, None, 0), (7, None, 5)] + [(1000, 3, i) for i in range(40)]  # nulls, a large group
    df = spark.createDataFrame(rows, "g bigint, s int, i int").repartition(5)
    for limit in (0, 1, 37, 100, 10_000):
        got = {tuple(r) for r in first_groups(df, "g", "s", limit, seed=9).collect()}
        assert got == brute_first(rows, limit, 9), limit
    assert first_groups(df.limit(0), "g", "s", 10).count() == 0


def test_only_the_bound_is_fitted_and_all_is_scored(spark):
    ids = spark.range(600).select(
        F.col("id").alias("display_id"), (F.col("id") % 2 + 2).cast("int").alias("num_ads"),
        F.explode(F.sequence(F.lit(0), F.col("id") % 2 + 1)).alias("ad_id"),
    )
    signal = (F.hash("display_id", "ad_id") % 100).cast("double")
    rows = ids.withColumns({"x": signal, "clicked": (F.col("ad_id") == 0).cast("int")})
    rows = rows.withColumn("x", F.col("x") + 60 * F.col("clicked"))
    models, fit_set = M.fit_bounded_cohorts(
        rows, "num_ads", "display_id", lambda **limits: M.boosting(["x"], maxIter=30, maxDepth=3, **limits), rows=300, tolerance=0.01
    )
    sizes = {r["num_ads"]: r["count"] for r in fit_set.groupBy("num_ads").count().collect()}
    assert set(models) == {2, 3} and sizes == {2: 300, 3: 300}
    assert all(1 <= m.stages[-1].getNumTrees < 30 for m in models.values()), "fits end by the held-out loss"
    scored = M.route(rows, "num_ads", models, 3, ["display_id", "ad_id", "clicked", "num_ads"])
    assert scored.count() == rows.count()
    assert all(r["map12"] > r["chance"] for r in improvement_by_size(scored).collect())


def test_cohort_limits_follow_size_and_rows():
    small, large = M.cohort_limits(2, 1000), M.cohort_limits(12, 1000)
    assert small == {"minWeightFractionPerNode": 0.001, "minInfoGain": 0.0001}
    assert large["minWeightFractionPerNode"] == 4 * 5.25 / 1000
    assert M.cohort_limits(12, 0)["minWeightFractionPerNode"] < 0.5
