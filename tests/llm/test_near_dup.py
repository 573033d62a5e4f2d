import random
import re
from itertools import combinations

import numpy as np
import pytest

from clickloom.llm import near_dup as nd
from clickloom.llm.common import prepare

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for (i, a), (j, b) in combinations(sets, 2):
        if i == j or (a and b and 100 * len(a & b) >= 85 * len(a | b)):
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets)


def found(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in nd.near_duplicates(prepare(spark).createDataFrame(rows, schema)).collect())


def test_small_and_odd_texts(spark):
    rows = [
        (5, "One two three four five six"), (3, "ONE TWO three four five SIX"), (7, "one two"), (2, "one  two\t"),
        (8, "one"), (9, ""), (10, None), (11, " \n\t"), (12, "é É"), (13, "É é"), (14, "a b"), (15, "a b"),
        (3, "ONE TWO three four five SIX"), (20, "word " * 3000), (21, "word " * 5),
    ]
    assert found(spark, rows) == brute(rows)


def test_null_id_is_kept_and_extra_columns_are_ignored(spark):
    rows = [(None, "a b c d e f", 1, b"x"), (1, "a b c d e f", 2, b"y"), (4, "a b c d e f", 3, None)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, n long, registers binary")
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df).collect()}
    assert out == {(None, None, True), (1, 1, True), (4, 1, False)}


def test_empty_table(spark):
    assert found(spark, []) == []


def test_groups_of_near_copies_match_brute_force(spark):
    """Copies of one base at all distances from it: more than a bucket for pairs holds, so clusters are compared."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(150)]
    rows = []
    for i in range(170):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))) for i in range(30)]
    want = brute(rows)
    assert 2 < len({r[2] for r in want}) < 190
    assert found(spark, rows) == want


def test_trunk_and_rest_in_many_blocks_match_brute_force(spark, monkeypatch):
    """Drifting copies: a trunk around the leader, others linked only through further copies, and some with no link."""
    monkeypatch.setattr(nd, "PAIR_BUCKET", 5)
    monkeypatch.setattr(nd, "BLOCK_DOCS", 9)
    rng = random.Random(8)
    rows = []
    for chain in range(3):
        w = [f"w{rng.randrange(9999)}" for _ in range(120)]
        for i in range(70):
            v = list(w)
            for _ in range(rng.choice([0, 1, 2, 5])):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**9), " ".join(v)))
            if i % 10 == 9:  # the base moves on
                for k in range(2):
                    w[rng.randrange(len(w))] = f"z{chain}{i}{k}"
    want = brute(rows)
    assert 3 < len({r[2] for r in want}) < len(rows)
    assert found(spark, rows) == want


def test_rows_of_one_id_are_one_node(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, a), (2, a), (2, b), (3, b)]
    assert {r[2] for r in found(spark, rows)} == {1}


@pytest.mark.parametrize(("n_a", "n_b"), [(1, 1), (30, 40), (3000, 2500)])
def test_chance_collisions(n_a, n_b):
    rng = np.random.default_rng(1)
    hits = total = 0
    for _ in range(400):
        a, b = (nd.compress(rng.integers(0, 2**64, (n, 40), np.uint64).min(axis=0)) for n in (n_a, n_b))
        hits, total = hits + (a == b).sum(), total + len(a)
    rate = nd.collision_rate(np.array([n_a]), np.array([n_b]))[0]
    assert abs(hits / total - rate) < 5 * (rate / total) ** 0.5 + 1e-4


def test_registers_keep_zeros_and_mantissa():
    x = np.array([1 << 63, (1 << 63) | (1 << 62), 1 << 40, 1, 2**64 - 1], np.uint64)
    got = nd.compress(x)
    assert list(got >> 10) == [0, 0, 23, 63, 0]
    assert list(got & 1023) == [0, 512, 0, 0, 1023]


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64, 2000, np.uint64)
    a, b = pool[:1800], pool[200:]
    got = nd.estimate(nd.registers(a)[None], nd.registers(b)[None], np.array([1800]), np.array([1800]))[0]
    assert abs(got - 0.8) < 0.13
