import math
import random

import pytest
from pyspark.sql import functions as F

from clickloom.llm import vectors as v
from clickloom.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int"


def run(spark, rows, k=10, step=100):
    df = prepare(spark).createDataFrame(rows, SCHEMA)
    df = df.select("vec_id", v.scaled(F.col("embedding")).alias("v"))
    queries = df.where(f"vec_id % {step} = 0").select(F.col("vec_id").alias("query_id"), "v")
    return sorted(tuple(r) for r in v.top_k(df, queries, k).collect())


def brute(rows, k=10, step=100):
    ok = [
        (i, [math.floor(1024 * x) for x in e]) for i, e, _ in rows
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for q, a in {(i, tuple(e)) for i, e in ok if i % step == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, e, strict=True)), i) for i, e in ok if i != q and len(e) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "leaf"), [(64, 8), (5000, 16)])
def test_matches_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(v, "SHARD_ROWS", shard)
    monkeypatch.setattr(v, "LEAF_ROWS", leaf)
    rng = random.Random(1)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(700):
        c = centre[i % 5]
        rows.append((i, [float(int((x + rng.gauss(0, 0.3)) * 256) / 256) for x in c], 0))
    assert run(spark, rows, step=50) == brute(rows, step=50)


def test_ties_nulls_repeats_and_lengths(spark):
    one = [1.0, 0.0]
    rows = [(0, one, 1), (100, [0.5, 0.5], 1), (7, one, 1), (5, one, 1), (5, one, 1), (9, None, 1), (None, one, 1)]
    rows += [(11, [1.0, None], 1), (12, [1.0, float("nan")], 1), (13, [float("inf"), 1.0], 1), (200, [1.0], 1), (0, one, 1), (14, [], 1)]
    assert run(spark, rows) == brute(rows)


def test_components_beyond_doubles(spark):
    rows = [(0, [3e4, 1.0], 0), (1, [2.0**27, 1.0], 0), (2, [2.0**27, 2.0], 0), (3, [-3e4, 0.1], 0)]
    assert run(spark, rows) == brute(rows)


def test_all_equal_vectors(spark):
    rows = [(i, [0.25, -0.5], 0) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
