import random
from itertools import combinations

import corpus_pipeline
from clickloom.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run_stages(spark, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, None)
        docs = spark.createDataFrame(made.collect(), made.schema)
        out[name] = docs
    return out


def test_stages_on_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and mails joe@ex.com at noon "
    rows = [(i, f"{text} number {'xyz'[i % 3] * (1 + i % 5)} {'q' * i} again and again", "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(50, rows[3][1], "en", None, 1), (51, None, "en", "s1", None), (52, "123", None, "s1", 3), (None, "no id at all here", None, "s2", 1)]
    rows += [(53, "one id and two texts, the first", "en", "s2", 1), (53, "one id and two texts, the second", "en", "s2", 1), (4, rows[4][1], "en", "s1", 1)]
    docs = prepare(spark).createDataFrame([(*r, "x") for r in rows], SCHEMA + ", copies string")
    out = run_stages(spark, docs)
    for name in ("language", "near_dup", "personal_data", "mixing"):
        assert out[name].columns == docs.columns, name
    assert out["language"].count() == len(rows) - 2
    ids = [r["doc_id"] for r in out["near_dup"].collect()]
    assert len(ids) == len(set(ids)) and 50 not in ids and 53 in ids and None in ids
    clean = out["personal_data"].collect()
    assert all("joe@ex.com" not in r["text"] and r["n_chars"] == len(r["text"]) for r in clean)
    assert out["personal_data"].count() == out["near_dup"].count()
    mixed = [r["doc_id"] for r in out["mixing"].collect()]
    assert set(mixed) <= set(ids) and max(map(mixed.count, mixed)) <= 2
    assert sorted(r["doc_id"] or 0 for r in out["packing"].collect()) == sorted(x or 0 for x in mixed)


def test_empty_documents(spark):
    docs = prepare(spark).createDataFrame([], SCHEMA)
    assert [d.count() for d in run_stages(spark, docs).values()] == [0] * 5


def test_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = run_stages(spark, docs)["packing"]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_near_dup_stage_matches_brute_force_at_080(spark):
    """Texts at all distances from their base, also between 0.80 and 0.85; the stage keeps one of each group."""
    rng = random.Random(5)
    rows, sets = [], {}
    for base in range(12):
        words = [f"w{base}x{i}" for i in range(104)]
        for changed in (0, 10, 11, 12, 16, 30):
            text = list(words)
            text[len(text) - changed:] = [f"y{rng.randrange(10**9)}" for _ in range(changed)]
            i = rng.randrange(10**9)
            sets[i] = {tuple(text[k:k + 5]) for k in range(100)}
            rows.append((i, " ".join(text), "en", "s", 1))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    between = 0
    for a, b in combinations(sets, 2):
        same, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        between += 80 * whole <= 100 * same < 85 * whole
        if 100 * same >= 80 * whole:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert between >= 12
    got = corpus_pipeline.near_dup(spark, prepare(spark).createDataFrame(rows, SCHEMA), None)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i in sets if find(i) == i)
