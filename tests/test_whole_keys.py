"""Profiles where only large keys are cut into time buckets."""

import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import profiles as P
from tests.test_training_rows import counted


@pytest.fixture(scope="module")
def log(spark):
    """A key with a third of the rows, null keys, null and early times, instants that repeat."""
    rng = random.Random(7)
    rows = []
    for i in range(4000):
        k = rng.choice([1, None, rng.randrange(300)])
        ts = None if rng.random() < 0.02 else rng.randrange(-20, 900) * 1_800_000
        rows.append((i, k, rng.choice(["a", "b", None]), ts, rng.choice([0, 1, None]), rng.random() < 0.8))
    return spark.createDataFrame(rows, "display_id long, k long, s string, ts long, clicked int, train boolean").cache()


def near(got, want):
    got, want = (sorted((tuple(r) for r in df.collect()), key=lambda r: repr(r[:3])) for df in (got, want))
    assert len(got) == len(want) > 200
    for g, w in zip(got, want, strict=True):
        assert [x is None for x in g] == [x is None for x in w]
        for x, y in zip(g, w, strict=True):
            assert x == (pytest.approx(y, rel=1e-9) if isinstance(y, float) else y)


@pytest.mark.parametrize("whole", [1, 500, 10**6])
def test_results_do_not_depend_on_which_keys_are_cut(log, whole):
    stacked = P.stack_keys(log, ["k", "s"], ["ts", "clicked", "display_id"])
    counters = {"clicks": F.col("clicked")}
    plain = P.time_profile(stacked, P.STACK, "ts", counters)
    near(P.time_profile(stacked, P.STACK, "ts", counters, sample_by="display_id", whole=whole), plain)


def test_small_keys_have_one_state(log):
    """A state for each hour of each key was shuffled before; now large keys alone have more than one."""
    times = log.where("ts >= 0")
    large = P.large_keys(times, ["k"], "display_id", 600)
    assert {r[0] for r in large.collect()} <= {1, None}
    states = P.bucket_states(times, ["k"], "ts", {}, 3_600_000, large=large)
    small = states.where("k <> 1").groupBy("k").count()
    assert small.count() > 250 and small.where("count > 1").count() == 0
    assert states.where("k = 1").count() > 300
    few = P.bucket_states(times, ["k"], "ts", {}, 3_600_000, large=P.large_keys(times, ["k"], "display_id", 10**6))
    assert few.count() == times.select("k").distinct().count()


def test_marked_rows_are_read_once(spark, log):
    two = P.train_test_profiles(log.where("train"), log.where("NOT train"), ["k", "s"])
    near(P.train_test_profiles(log, None, ["k", "s"], sample_by="display_id", is_train=F.col("train")), two)
    once, seen = counted(log.drop("_"))
    P.train_test_profiles(once, None, ["k", "s"], is_train=F.col("train")).collect()
    assert seen.value == 4000
