import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from clickloom.llm import mixing as mx
from clickloom.llm.common import prepare

SCHEMA = "doc_id long, text string, source string"


def run(spark, rows, **options):
    df = prepare(spark).createDataFrame(rows, SCHEMA)
    return [r.asDict() for r in mx.mix(df, **options).collect()]


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling by rounds: share by weight, cut, and share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if most * sizes[s] < level * weight[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def check(rows, got):
    size, source = collections.Counter(), {}
    for i, text, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        source[i] = s
    want, taken, largest = targets(size), collections.Counter(), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["copies"] <= 2
        taken[s] += r["copies"] * r["size"]
        largest[s] = max(largest[s], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s


@pytest.mark.parametrize("hot", [0.35, 0.9])
def test_targets_are_met_and_reruns_agree(spark, hot):
    rng = random.Random(5)
    rows = [
        (i, "w " * int(rng.paretovariate(1.2)), "hot" if rng.random() < hot else rng.choice(["a", "Z", "é", None, "b", "c"]))
        for i in range(1500)
    ]
    got = run(spark, rows)
    check(rows, got)
    again = run(spark, rows[::-1])
    pick = lambda x: sorted((r["doc_id"], r["copies"]) for r in x)
    assert pick(got) == pick(again)
    assert pick(run(spark, rows, seed=8)) != pick(got)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (4, "x y", "b"), (4, "x y", "b"), (None, "z " * 20_000, "b"), (5, "q", "")]
    got = run(spark, rows)
    assert len(got) == len(rows) and {r["source_size"] for r in got} == {0, 20_004, 1}
    assert all(r["copies"] <= 2 for r in got)


def test_empty_table_and_one_source(spark):
    assert run(spark, []) == []
    check(rows := [(i, "w " * (1 + i % 7), "s") for i in range(200)], run(spark, rows))


def test_chances_stay_fair(spark):
    """Over many seeds, documents are taken up about as often as their chance says."""
    df = prepare(spark).range(40_000).select(
        (F.col("id") % 400).alias("stratum"), F.col("id").alias("key"), F.xxhash64("id").alias("spread"),
        F.lit(10.0).alias("size"), F.lit(3.0).alias("mass"), F.lit(100).alias("members"),
    )
    up = mx.pivotal_rounding(df, mx.Scratch(spark, "test"))
    per = up.groupBy((F.col("key") % 400).alias("s")).count().collect()
    assert len(per) == 400 and {r["count"] for r in per} == {30}
    first = up.where("key < 4000").count()
    assert abs(first - 1200) < 150
