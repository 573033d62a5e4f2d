import random
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.llm import quality as ql
from clickloom.llm.common import prepare

SCHEMA = "doc_id long, text string"


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def measured(spark, texts):
    df = prepare(spark).createDataFrame(list(enumerate(texts)), SCHEMA)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return [tuple(r)[1:] for r in sorted(ql.measures(df).select("doc_id", *cols).collect())]


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a a a", "a a a a", "a b c a b c", "x\n\nx\n \nx", "é# b\x1cc", "😀 😀 😀 😀", "w " * 20_000, "a b c d " * 5 + "e f g"]
    assert measured(spark, texts) == [brute(t) for t in texts]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("ab \n#", max_size=40), min_size=30, max_size=60))
def test_random_texts(spark, texts):
    assert measured(spark, texts) == [brute(t) for t in texts]


def test_verdict_does_not_depend_on_the_order(spark):
    rng = random.Random(1)
    words = ["house", "GARDEN", "!!", "##", "tree", "x" * 40]
    rows = [(i, "\n".join(" ".join(rng.choices(words, [9, i % 5, i % 3, i % 4, 9, i % 2], k=12)) for _ in range(6))) for i in range(60)]
    docs = prepare(spark).createDataFrame(rows, SCHEMA)
    df = ql.measures(docs)
    rules = ql.default_rules()[:4]
    kept = df.select(*[ql.cascade(p).isNull().alias(f"k{i}") for i, p in enumerate(permutations(rules))]).collect()
    assert all(len(set(r)) == 1 for r in kept) and 0 < sum(r[0] for r in kept) < 60
    assert {r.name for r in ql.order_rules(docs, rules)} == {r.name for r in rules}


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    out = ql.quality_filter(prepare(spark).read.parquet(f"{sf}/documents.parquet")).join(good, "doc_id")
    assert out.where(~F.col("kept") & ~F.col("base_failed")).count() == 0
    bad = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").select("doc_id")
    out = ql.quality_filter(spark.read.parquet(f"{sf}/documents.parquet")).join(bad, "doc_id")
    assert out.where("kept").count() < 0.2 * out.count()


def test_empty_table_repeats_and_other_columns(spark):
    df = prepare(spark).createDataFrame([(1, "a " * 60, 3), (1, "a " * 60, 3), (None, None, 4)], SCHEMA + ", n_lines2 long")
    out = ql.quality_filter(df)
    assert out.count() == 3 and out.where("base_failed").count() == 3
    assert ql.quality_filter(df.limit(0)).count() == 0
