"""Kernel naive Bayes against plain loops, and its odd rows."""

import math
import random

import pytest

from clickloom.operators.splits import kfold
from clickloom.plans.bayes import kernel_bayes_grid

SCHEMA = "g int, x double, c int, clicked int"


def brute(rows, laplace, adjust, folds, bins, threshold=0.001):
    """rows: (fold, x, c, y)"""
    xs = [r[1] for r in rows if r[1] is not None]
    low, high = min(xs), max(xs)
    at = lambda x: None if x is None else 0 if low == high else min(bins - 1, math.floor((x - low) / (high - low) * bins))
    out = []
    for a in laplace:
        for h in adjust:
            shares = []
            for f in range(folds):
                train, held = [r for r in rows if r[0] != f], [r for r in rows if r[0] == f]
                n = [sum(r[3] == c for r in train) for c in (0, 1)]
                levels = {r[2] for r in rows if r[2] is not None}
                dens, code = [], []
                for c in (0, 1):
                    own = [at(r[1]) for r in train if r[3] == c and r[1] is not None]
                    mean = sum(own) / len(own)
                    sd = math.sqrt(sum((b - mean) ** 2 for b in own) / (len(own) - 1)) if len(own) > 1 else 0.0
                    w = max(0.9 * sd * len(own) ** -0.2, 1e-6)
                    known = {at(x) for x in xs}
                    k = {b: sum(math.exp(-0.5 * ((b - o) / (h * w)) ** 2) for o in own) for b in known}
                    dens.append({b: max(v / sum(k.values()), threshold) for b, v in k.items()})
                    codes = [r[2] for r in train if r[3] == c and r[2] is not None]
                    code.append({v: max((codes.count(v) + a) / (len(codes) + a * len(levels)), threshold) for v in levels})
                right = 0
                for _, x, c, y in held:
                    s = math.log(n[1] / n[0])
                    if x is not None:
                        s += math.log(dens[1][at(x)] / dens[0][at(x)])
                    if c is not None:
                        s += math.log(code[1][c] / code[0][c])
                    right += (s > 0) == (y == 1)
                shares.append(right / len(held))
            out.append((a, h, sum(shares) / folds))
    return out


def test_matches_plain_loops(spark):
    rng = random.Random(8)
    data = []
    for g in range(150):
        y = int(rng.random() < 0.4)
        data.append((g, None if g % 17 == 0 else rng.gauss(2.0 * y, 1.3), None if g % 13 == 0 else rng.choice([1, 2, 3 + y]), y))
    df = spark.createDataFrame(data, SCHEMA)
    folds = {r["g"]: r["fold"] for r in kfold(df, "g", 3).collect()}
    want = brute([(folds[g], x, c, y) for g, x, c, y in data], (1.0, 100.0), (0.1, 1.0), 3, 16)
    got = kernel_bayes_grid(df, ["x"], ["c"], "g", adjust=(0.1, 1.0), folds=3, bins=16).collect()
    assert [(r["laplace"], r["adjust"]) for r in got] == [w[:2] for w in want]
    assert [r["accuracy"] for r in got] == pytest.approx([w[2] for w in want])
    assert [r["best"] for r in got] == [w[2] == max(x[2] for x in want) and w == max(want, key=lambda x: x[2]) for w in want]
    assert max(r["accuracy"] for r in got) > 0.7


def test_odd_rows(spark):
    constant = spark.createDataFrame([(g, 5.0, 1, g % 2) for g in range(20)] + [(99, 5.0, 1, None)], SCHEMA)
    assert all(0 <= r["accuracy"] <= 1 for r in kernel_bayes_grid(constant, ["x"], ["c"], "g", folds=2).collect())
    one_class = spark.createDataFrame([(g, float(g), 1, 1) for g in range(10)], SCHEMA)
    assert {r["accuracy"] for r in kernel_bayes_grid(one_class, ["x"], ["c"], "g", folds=2).collect()} == {1.0}
    nulls = spark.createDataFrame([(g, None, None, int(g < 3)) for g in range(10)], SCHEMA)
    assert all(r["accuracy"] is not None for r in kernel_bayes_grid(nulls, ["x"], ["c"], "g", folds=2).collect())
    empty = kernel_bayes_grid(constant.limit(0), ["x"], ["c"], "g").collect()
    assert len(empty) == 4 and all(r["accuracy"] is None and not r["best"] for r in empty)
