import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from clickloom.llm import lexical as x
from clickloom.llm.common import prepare

DOCS, ITEMS = "doc_id long, text string, n long, term string", "item_id long, text string, score int"


def run(spark, docs, items, k=20):
    docs = prepare(spark).createDataFrame([(*r, 7, "w") for r in docs], DOCS)
    items = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    out = x.search(docs, items, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def terms(text):
    return [t.translate(str.maketrans(x.UPPER, x.LOWER)) for t in re.findall(x.TERM, text or "")]


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * n_docs) // max(1, n_terms)
            s = 0
            for t in terms(text):
                if b[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if null else i, -s))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "block", "k"), [(8, 2, 3), (50, 3, 5), (4096, 256, 20)])
def test_matches_brute_force(spark, monkeypatch, shard, block, k):
    monkeypatch.setattr(x, "SHARD_DOCS", shard)
    monkeypatch.setattr(x, "BLOCK_QUERIES", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "it's", "日本", "a" * 300]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(0, 40)).upper() if i % 3 else text(rng.randint(1, 400))) for i in range(300)]
    docs += [(i, docs[5][1]) for i in range(300, 340)]  # copies: ties by id
    items = [(i, text(rng.randint(1, 30))) for i in range(9)]
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_accumulators_stop():
    """Terms that cannot lift a new document to the k-th partial score open no accumulators; survivors stay exact."""
    a = lambda *n: np.array(n, np.int64)
    parts = [(a(0, 1, 2), a(900, 800, 700)), (np.arange(500), np.full(500, 10))]
    score, held = x.accumulate(parts, 3, 500)
    assert held.sum() == 3 and list(score[:3]) == [910, 810, 710] and not score[3:].any()
    assert x.accumulate(parts, 4, 500)[1].all()  # the fourth best is not known yet
    tied = [(a(7, 8), a(50, 50)), (np.arange(9), np.full(9, 50))]
    assert x.accumulate(tied, 2, 9)[1].all()  # an equal score may still win by its id


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two"), (None, "ONE"), (4, "-- !"), (5, "two " * 5000), (None, None)]
    items = [(1, "one"), (1, "one"), (None, "two one two"), (2, None), (3, ""), (4, "never seen"), (5, "?!")]
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "one")]), ([(1, "one")], []), ([], []), ([(1, None)], [(1, "one")]), ([(1, "one")], [(1, None)])])
def test_empty(spark, docs, items):
    assert run(spark, docs, items) == []
