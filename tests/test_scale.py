"""Skew paths and order cuts against brute force: the split forms must equal the plain ones."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.functions.udfs import gap_apply
from clickloom.operators import aggregates as A
from clickloom.operators import profiles as P
from clickloom.operators import ranks as R
from clickloom.operators import splits as L
from clickloom.plans import features as X


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, one instant a third of that, and there is a null key."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = None if i % 50 == 0 else 1 if i % 3 == 0 else rng.randrange(2, 60)
        ts = 5000 if i % 9 == 0 else rng.randrange(0, 40_000)
        data.append((key, i, ts, rng.randrange(8) / 8, int(rng.random() < 0.2)))
    pdf = pd.DataFrame(data, columns=["k", "id", "ts", "score", "y"])
    df = spark.createDataFrame(data, "k int, id bigint, ts bigint, score double, y int").repartition(7)
    return df, pdf.assign(k=pdf.k.fillna(-1))


def test_hot_groups_get_the_same_ranks(skewed):
    df, pdf = skewed
    order = [F.desc("score"), F.asc("id")]
    got = R.rank_in_group(df, ["k"], order, hot_rows=55)
    assert got.count() == 3000
    want = pdf.sort_values(["score", "id"], ascending=[False, True]).assign(p=lambda d: d.groupby("k").cumcount() + 1)
    want = dict(zip(want.id, want.p, strict=True))
    assert all(want[r["id"]] == r["position"] for r in got.collect())


def test_global_position(skewed):
    df, pdf = skewed
    want = {i: n for n, i in enumerate(pdf.sort_values(["score", "id"], ascending=[False, True]).id, start=1)}
    got = R.global_position(df, [F.desc("score"), F.asc("id")]).collect()
    assert len(got) == 3000 and all(want[r["id"]] == r["position"] for r in got)


@pytest.mark.parametrize("few", [None, 10])  # 10: the hot group has more marks than that and is ranked
def test_rows_ahead_for_several_scores(skewed, few):
    df, pdf = skewed
    df = df.where("k IS NOT NULL").withColumn("other", -F.col("score"))
    got = R.rows_ahead(df, F.col("y") == 1, ["k"], "id", ["score", "other"], ["ts"], few).collect()
    pdf = pdf[pdf.k >= 0]
    for sign, name in ((-1, "position_score"), (1, "position_other")):
        ranked = pdf.assign(s=pdf.score * sign).sort_values(["s", "id"]).assign(p=lambda d: d.groupby("k").cumcount() + 1)
        want = {r.id: r.p for r in ranked[ranked.y == 1].itertuples()}
        assert {r["id"]: r[name] for r in got} == want
    sizes = pdf.groupby("k").id.count()
    assert all(r["group_size"] == sizes[r["k"]] for r in got)


@pytest.mark.parametrize("bucket", [1, 97, 5000, 10**9])
def test_profiles_do_not_depend_on_the_bucket_width(skewed, bucket):
    df, pdf = skewed
    got = {(-1 if r["k"] is None else r["k"]): r for r in P.time_profile(df, ["k"], "ts", {"y": F.col("y")}, bucket).collect()}
    for k, g in pdf.groupby("k"):
        ts = np.sort(g.ts.to_numpy()).astype(float)
        d = np.diff(ts)
        r = got[int(k)]
        assert (r["tot"], r["y"], r["ts_min"], r["ts_max"]) == (len(g), g.y.sum(), ts[0], ts[-1])
        assert r["ts_avg"] == pytest.approx(ts.mean()) and r["ts_var"] == pytest.approx(ts.var(ddof=1))
        assert (r["gap_min"], r["gap_max"]) == (d.min(), d.max())
        assert r["gap_avg"] == pytest.approx(d.mean()) and r["gap_var"] == pytest.approx(d.var(ddof=1))


@pytest.mark.parametrize("bucket", [97, 10**9])
def test_gap_to_previous(skewed, bucket):
    df, pdf = skewed
    got = {r["id"]: r["gap"] for r in P.gap_to_previous(df, ["k"], "ts", "id", bucket).collect()}
    ordered = pdf.sort_values(["k", "ts", "id"])
    gap = ordered.groupby("k").ts.diff()
    assert len(got) == 3000
    for i, g in zip(ordered.id, gap, strict=True):
        assert (got[i] is None) == math.isnan(g) and (got[i] is None or got[i] == g)


def test_user_function_of_gaps(skewed):
    df, pdf = skewed

    def partial(gaps, counts):
        return [float((np.log1p(gaps) * counts).sum())]

    states = gap_apply(df.where("k IS NOT NULL"), ["k"], "ts", partial, 1, bucket_ms=500)
    got = {r["k"]: r["s"] for r in states.groupBy("k").agg(F.sum(F.element_at("state", 1)).alias("s")).collect()}
    for k, g in pdf[pdf.k >= 0].groupby("k"):
        assert got[int(k)] == pytest.approx(np.log1p(np.diff(np.sort(g.ts.to_numpy()))).sum())


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_user_function_groups_over_batch_borders(spark, skewed, rows):
    """Small groups share a batch and large ones span many; the function is called once a group, and no worker call is a group."""
    df, pdf = skewed

    def partial(gaps, counts):
        assert isinstance(gaps, np.ndarray) and (np.diff(gaps) > 0).all()
        return [float((gaps * counts).sum()), float(counts.sum()), 1.0]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        states = gap_apply(df.where("k IS NOT NULL"), ["k"], "ts", partial, 3, bucket_ms=50)
        assert "FlatMapGroups" not in states._jdf.queryExecution().toString()
        found = states.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len({(r["k"], r["part"]) for r in found})
    for k, g in pdf[pdf.k >= 0].groupby("k"):
        d = np.diff(np.sort(g.ts.to_numpy()))
        mine = [r for r in found if r["k"] == k]
        assert {r["part"] for r in mine} == set(d // 50) and sum(r["state"][0] for r in mine) == d.sum()
        assert sum(r["state"][1] for r in mine) == len(d)


def test_moments_merge_for_any_split(skewed):
    df, pdf = skewed
    for batches in (1, 2, 7):
        states = P.batch_moments(df.withColumn("b", F.col("id") % batches), ["k"], "b", "ts", "y")
        for r in P.merge_moments(states, ["k"]).collect():
            g = pdf[pdf.k == (-1 if r["k"] is None else r["k"])].ts
            assert r["tot"] == len(g) and r["ts_var"] == pytest.approx(g.var())


def hash_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n,blocks", [(10, 16), (1000, 7), (5000, 32)])
def test_blocks_against_the_sorted_list(spark, n, blocks):
    df = spark.range(n).select((F.col("id") * 3).alias("g")).crossJoin(spark.range(2))
    order = {g: r for r, g in enumerate(hash_order([3 * i for i in range(n)], 5), start=1)}
    got = L.random_blocks(df, "g", blocks, seed=5).collect()
    assert len(got) == 2 * n and all(r["block"] == (order[r["g"]] - 1) * blocks // n + 1 for r in got)
    ranks = {r["g"]: r["rank"] for r in L.hash_ranks(df, "g", 5).collect()}
    assert ranks == order
    ordered = L.ordered_blocks(df, "g", blocks).collect()
    assert all(r["block"] == (r["g"] // 3) * blocks // n + 1 for r in ordered)


def test_ordered_cuts_in_uneven_ranges(spark):
    ids = [i for i in range(500)] + [10**15 + i * 7 for i in range(300)] + [-(10**12)]
    df = spark.createDataFrame([(i,) for i in ids], "g bigint")
    ranks = [1, 2, 250, 501, 502, 777, 801]
    assert L.ordered_cuts(df, "g", lambda n: ranks) == [sorted(ids)[r - 1] for r in ranks]


def test_samples_cut_no_display(spark):
    df = spark.range(400).select((F.col("id") % 130).alias("g"), "id")
    order = hash_order(range(130), 1)
    for p in (0.0, 0.1, 0.8, 1.0):
        kept = {r["g"] for r in L.sample_groups(df, "g", p).collect()}
        assert kept == set(order[: math.trunc(p * 130)])
    both = L.train_valid(df, "g", 0.8)
    assert both.count() == 400 and both.groupBy("g").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    folds = L.kfold(df, "g", 4)
    sizes = [r["n"] for r in folds.groupBy("fold").agg(F.count_distinct("g").alias("n")).collect()]
    assert folds.count() == 400 and max(sizes) - min(sizes) <= 1


def test_day_balance(spark):
    df = spark.range(900).select((F.col("id") % 300).alias("g"), ((F.col("id") % 300) % 13 + 1).cast("int").alias("day"))
    out = L.day_balanced(df, "g", "day").select("g", "day", "part").distinct().toPandas()
    late, early = out[out.day >= 12], out[out.day < 12]
    assert len(late) == len(early) == 46 and (out.part == "train").sum() == math.trunc(0.8 * 92)


def test_summary_and_auc(skewed):
    df, pdf = skewed
    got = {r["column"]: r for r in A.numeric_summary(df, ["ts", "score"]).collect()}
    for c in ("ts", "score"):
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert got[c][name] == pytest.approx(pdf[c].quantile(q))
        assert got[c]["mean"] == pytest.approx(pdf[c].mean()) and got[c]["nulls"] == 0
    auc = A.ranking_auc(df.withColumn("g", F.lit(1)), ["g"], "score", "y").first()["auc"]
    pos, neg = pdf[pdf.y == 1].score.to_numpy(), pdf[pdf.y == 0].score.to_numpy()
    d = pos[:, None] - neg[None, :]
    assert auc == pytest.approx(((d > 0) + (d == 0) / 2).mean())


def test_leader_columns(skewed):
    df, pdf = skewed
    df = df.where("k IS NOT NULL")
    got = X.leader_columns(df, "k", "score", "id", ["ts"])
    best = pdf[pdf.k >= 0].sort_values(["score", "id"], ascending=[False, True]).groupby("k").ts.first()
    assert got.count() == df.count() and all(best[r["k"]] == r["clk1_ts"] for r in got.collect())


def test_category_codes_with_nulls(spark):
    df = spark.createDataFrame([(1, "b", 10), (2, None, 9), (3, "a", None), (4, "b", 100)], "i int, s string, n bigint")
    got = {r["i"]: (r["s"], r["n"]) for r in X.category_codes(df, ["s", "n"], ["i"]).collect()}
    assert got == {1: (2, 2), 2: (3, 1), 3: (1, 4), 4: (2, 3)}
