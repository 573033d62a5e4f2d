import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from clickloom.llm import variants as v
from clickloom.llm.common import prepare

LOW = str.maketrans(v.UPPER, v.LOWER)


def brute_words(docs, noise=97):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
            if len(run) >= 5:
                n[run] += 1
    return n


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    near_of = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in near_of.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near_of[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, n):
    words = prepare(spark).createDataFrame(list(n.items()), "word string, n long")
    out = v.variants(words)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def test_variants_match_brute_force(spark):
    rng = random.Random(5)
    n = {}
    while len(n) < 400:
        w = "".join(rng.choices("abé", k=rng.randint(1, 7)))
        n[w] = rng.choice([1, 2, 3, 5, 8, 20, 50, 51, 400])
    assert run(spark, n) == brute(n)


def test_repeated_characters_count_once(spark):
    n = {"aaaa": 3, "aaaaa": 9, "aabaa": 1, "aaba": 1, "b": 7, "ab": 2}
    assert run(spark, n) == brute(n)


def test_long_chain_and_ties(spark):
    n = {"x" * i + "y" * (40 - i): 2**i for i in range(41)}
    n |= {"zzzza": 10, "zzzzb": 10, "zzzzc": 5}
    assert run(spark, n) == brute(n)


def test_nulls_and_empty(spark):
    words = prepare(spark).createDataFrame([(None, 4), ("abcde", None), ("abcdf", 3)], "word string, n long")
    assert [tuple(r) for r in v.variants(words).collect()] == [("abcdf", None, "abcdf", 3, 0, None)]
    assert v.variants(words.limit(0)).collect() == []


def test_words_of_documents(spark):
    rng = random.Random(6)
    docs = [(i, " ".join("".join(rng.choices("abcÀÿ×Z", k=rng.randint(3, 8))) for _ in range(60))) for i in range(30)]
    docs += [(None, "abcde-ABCDE"), (1, None), (2, ""), (3, "q" * 50_000), (3, "q" * 50_000), (4, "ab1cdefg straße naïveté")]
    df = prepare(spark).createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n long")
    for noise in (97, 2):
        assert {r["word"]: r["n"] for r in v.noisy_words(df, noise=noise).collect()} == brute_words(docs, noise)
    assert v.noisy_words(df.where(F.lit(False))).collect() == []
