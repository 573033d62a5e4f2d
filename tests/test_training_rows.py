"""Rates of training rows from counts by ad and display; operators that compute their input once."""

import random

import pytest
from pyspark.sql import functions as F

from clickloom.catalog.models import FEATURES, ROW_COLUMNS, add_rates
from clickloom.operators.splits import day_balanced
from clickloom.plans import models as M
from clickloom.plans.bayes import kernel_bayes_grid


def counted(df):
    """``df`` and a counter of the rows that are computed for it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_rates_by_ad_and_display(spark):
    """Repeated and null keys, displays of two users, keys of held-out rows alone: as counted row by row."""
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        d, ad = rng.randrange(60), rng.randrange(40)
        part = "train" if d % 4 else "valid"
        doc = None if ad == 5 else ad % 7 + (100 if part == "valid" and ad == 9 else 0)
        adv = rng.choice([None, "x"]) if ad % 5 == 0 else f"b{ad % 3}"
        rows.append((d if d else None, rng.choice([None, d % 9]), ad, doc, adv, int(rng.random() < 0.3), part, d % 24, 1, 2))
    kinds = "bigint bigint bigint bigint string int string int int int".split()
    df = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(ROW_COLUMNS, kinds, strict=True)))
    got = sorted(add_rates(df).collect(), key=repr)
    train = [r for r in rows if r[6] == "train"]
    mean = sum(r[5] for r in train) / len(train)

    def rate(i, key):
        of = [r[5] for r in train if r[i] == key]
        return (sum(of) / (len(of) + 4), float(len(of))) if of else (mean, 0.0)

    want = []
    for r in rows:
        (ap, at), (dp, _), (_, ut), (vp, _) = rate(2, r[2]), rate(3, r[3]), rate(1, r[1]), rate(4, r[4])
        want.append((r[0], r[2], r[5], sum(x[0] == r[0] for x in rows), r[6], ap, at, dp, ut, vp, r[7], r[8], r[9]))
    assert FEATURES[:5] == ("ad_prob", "ad_tot", "doc_prob", "user_tot", "adv_prob") and len(got) == len(rows)
    for g, w in zip(got, sorted(want, key=lambda w: repr(got[0].__class__(*w))), strict=True):
        assert tuple(g) == pytest.approx(w, abs=1e-12, nan_ok=True) if None not in w else [*g][1:] == pytest.approx([*w][1:])


def test_day_balance_computes_its_rows_once(spark):
    df = spark.range(3000).select((F.col("id") % 500).alias("g"), (F.col("id") % 500 % 14).cast("int").alias("day"))
    once, seen = counted(df)
    got = day_balanced(once, "g", "day").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, day_balanced(df, "g", "day").collect())) and got
    assert seen.value == 3000


def test_bayes_grid_computes_its_rows_once(spark):
    df = spark.range(2000).select(
        (F.col("id") % 300).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("clicked"), (F.col("id") % 17).alias("x"), (F.col("id") % 4).alias("c")
    )
    once, seen = counted(df)
    got = kernel_bayes_grid(once, ["x"], ["c"], "g").collect()
    assert got == kernel_bayes_grid(df, ["x"], ["c"], "g").collect() and sum(r["best"] for r in got) == 1
    assert seen.value == 2000


def test_fits_get_bounded_partitions(spark):
    df = spark.range(10_000, numPartitions=2)
    sizes = M.spread(df, 500).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 600
    assert M.spread(df, 5000).rdd.getNumPartitions() == 2
