"""Streams equal batches for any cut of the log; models beat chance and keep their keys."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.operators import profiles as P
from clickloom.plans import models as M
from clickloom.plans import ranking as K
from clickloom.streaming import streams as T

VIEWS = "uuid bigint, document_id bigint, ts bigint, platform int, geo_location string, traffic_source int"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    data = [(1 if i % 3 == 0 else rng.randrange(2, 9), rng.randrange(5), i * 1000 + rng.randrange(1000), rng.randrange(1, 4), "US>CA", 1) for i in range(400)]
    return spark.createDataFrame(data, VIEWS)


@pytest.mark.parametrize("order", ["ts", "-ts", "hash(uuid, ts)"])
def test_running_gaps_equal_the_batch_profile(spark, log, tmp_path, order):
    """In time order, in reverse (all rows late) and mixed; one batch breaks off before its commit and is repeated."""
    root, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    line = log.withColumn("part", F.ntile(6).over(W.orderBy(F.expr(order))))
    for p in range(1, 7):
        line.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(root)
    broken = T.fail_once(3)
    T.with_restart(
        lambda: T.running_gaps(T.page_view_stream(spark, root, 1), "uuid", out, ckpt, 2, broken), lambda: None
    )
    got = {r["uuid"]: r for r in T.gap_profile(T.gap_points_so_far(spark, out, "uuid"), "uuid", 5000).collect()}
    want = {r["uuid"]: r for r in P.time_profile(log, ["uuid"], "ts", {}).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("tot", "ts_min", "ts_max", "gap_min", "gap_max"):
            assert got[k][c] == w[c], (k, c)
        for c in ("ts_avg", "ts_var", "gap_avg", "gap_var"):
            assert got[k][c] == pytest.approx(w[c]), (k, c)


def test_a_late_row_between_two_others(spark):
    rows = [(1, t) for t in (100, 300, 200, 400)]
    got = T.gap_profile(T.gap_points(spark.createDataFrame(rows, "uuid bigint, ts bigint"), "uuid"), "uuid").first()
    assert [got[c] for c in ("gap_min", "gap_max", "gap_avg", "gap_var")] == [100, 100, 100, 0]


def test_elimination_sizes():
    assert M.elimination_sizes(16, 0.25) == [16, 4, 1] and M.elimination_sizes(5, 0.9, 2) == [5, 4, 3, 2]


@pytest.fixture(scope="module")
def clicks(spark):
    rng = random.Random(11)
    data = []
    for d in range(300):
        size = 2 + d % 3
        good = rng.randrange(size)
        data += [(d, d * 10 + a, int(a == good), size, (a == good) * 0.3 + rng.random(), rng.random()) for a in range(size)]
    return spark.createDataFrame(data, "display_id int, ad_id int, clicked int, num_ads int, a double, b double")


def small():
    return M.boosting(["a", "b"], maxIter=3, maxDepth=3, stepSize=0.3)


def test_cohort_models_beat_chance_and_score_every_row(clicks):
    models = M.fit_cohorts(clicks.where("num_ads < 4"), "num_ads", small)
    assert set(models) == {2, 3}
    scored = M.route(clicks, "num_ads", models, fallback=3)
    assert scored.count() == clicks.count() == scored.select("display_id", "ad_id").distinct().count()
    assert scored.where("prob IS NULL OR prob < 0 OR prob > 1").count() == 0
    joined = clicks.join(scored, ["display_id", "ad_id"])
    for r in K.improvement_by_size(joined).collect():
        assert r["map12"] > r["chance"]


def test_staged_scores_end_at_the_model(clicks):
    model = small().fit(clicks)
    staged = M.staged_scores(model, clicks, ["ad_id"])
    assert staged.count() == 3 * clicks.count()
    last = staged.where("round = 3").join(M.score(model, clicks, ["ad_id"], "p"), "ad_id")
    assert last.where(F.abs(F.col("prob") - F.col("p")) > 1e-9).count() == 0


def test_fits_stop_before_their_last_round(clicks):
    """A fit stops by the held-out loss without learning from those rows, and rounds go on to the longest fold's."""
    make = lambda: M.boosting(["a", "b"], maxIter=30, maxDepth=3, stepSize=0.3)
    held = clicks.withColumn(M.HELD_OUT, F.col("display_id") % 4 == 0)
    model = M.stopping(make(), 0.05).fit(held)
    trees = model.stages[-1].getNumTrees
    assert 1 <= trees < 30
    full = M.boosting(["a", "b"], maxIter=trees, maxDepth=3, stepSize=0.3).fit(held.where(~F.col(M.HELD_OUT)))
    both = M.score(model, held, ["ad_id"]).join(M.score(full, held, ["ad_id"], "p"), "ad_id")
    assert both.where(F.abs(F.col("prob") - F.col("p")) > 1e-9).count() == 0
    rounds = M.rounds_by_cv(clicks, "display_id", "ad_id", make, folds=2, tolerance=0.05).orderBy("round").collect()
    assert [r["round"] for r in rounds] == list(range(1, len(rounds) + 1)) and len(rounds) < 30
    assert [sum(r[c] for r in rounds) for c in ("best_map", "best_auc", "best_error")] == [1, 1, 1]
    top = max(rounds, key=lambda r: r["map12"])
    assert top["best_map"] and all(0 <= r[c] <= 1 for r in rounds for c in ("map12", "auc", "error"))


def test_importance_shares_add_up(spark, clicks, tmp_path):
    imp = M.importance(spark, small().fit(clicks), str(tmp_path / "m"), ["a", "b"])
    total = imp.agg(*[F.sum(c).alias(c) for c in ("gain", "cover", "frequency")]).first()
    assert all(total[c] == pytest.approx(1) for c in ("gain", "cover", "frequency"))
    assert imp.orderBy(F.desc("gain")).first()["feature"] == "a"


def test_registry_picks_complete_versions(spark):
    data = [(f"XGB_v501_a.{c:03d}", 501, c) for c in range(1, 12)] + [("XGB_v501_0.001", 501, 1), ("XGB_v502_a.001", 502, 1)]
    models = spark.createDataFrame(data, "name string, version int, cohort int")
    none = spark.createDataFrame([], "version int")
    got = M.ready_versions(models, none).collect()
    assert len(got) == 11 and min(r["name"] for r in got if r["cohort"] == 1) == "XGB_v501_0.001"
    assert M.ready_versions(models, spark.createDataFrame([(501,)], "version int")).count() == 0


def test_sequences_are_scored_by_the_function_of_their_size(spark, clicks):
    """Functions see whole groups in item order; sizes without a function go to the fallback; keys come back."""
    functions = {2: lambda x: x[:, ::-1, 0], 3: lambda x: x[:, :, 0] + x[:, :, 1].sum(axis=1, keepdims=True)}
    scored = M.score_sequences(clicks, "display_id", "ad_id", ["a", "b"], functions, lambda x: -x[:, :, 0])
    got = {(r["display_id"], r["ad_id"]): r["prob"] for r in scored.collect()}
    groups = {}
    for r in clicks.orderBy("display_id", "ad_id").collect():
        groups.setdefault(r["display_id"], []).append(r)
    want = {}
    for rows in groups.values():
        a, b = [r["a"] for r in rows], sum(r["b"] for r in rows)
        p = a[::-1] if len(rows) == 2 else [x + b for x in a] if len(rows) == 3 else [-x for x in a]
        want |= {(r["display_id"], r["ad_id"]): x for r, x in zip(rows, p, strict=True)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert M.score_sequences(clicks.limit(0), "display_id", "ad_id", ["a"], {}, lambda x: x[:, :, 0]).collect() == []
