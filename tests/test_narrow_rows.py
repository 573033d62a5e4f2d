"""Rows meet codes, profiles and documents while they are narrow, and what was shuffled goes with the query."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from clickloom.operators import doctypes as D
from clickloom.plans import features as X
from clickloom.session import SQL_SETTINGS, materialise, prepare_session


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def rows(spark):
    data = [(d, a, int(a == 0), d % 3, None if d % 5 == 0 else f"u{d}", d % 4, d % 7) for d in range(40) for a in range(2)]
    return spark.createDataFrame(
        data, "display_id bigint, ad_id bigint, clicked int, platform int, uuid string, document_id bigint, hour int"
    ).withColumn("ts", F.col("display_id") * 10)


def numbers(spark):
    return spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 9.0), (3, 2.0)], "document_id bigint, score double")


def put(spark):
    table = materialise(numbers(spark))
    return lambda df: df.join(F.broadcast(table), "document_id", "left")


@pytest.mark.parametrize("small", [0, 10, 1000])
def test_codes_are_the_same_whatever_is_broadcast(rows, small):
    got = X.category_codes(rows, ["platform", "uuid"], ["display_id", "ad_id", "hour"], ["display_id", "ad_id"], small=small).collect()
    users = sorted({r["uuid"] for r in rows.collect() if r["uuid"]})
    want = [(r["display_id"], r["ad_id"], r["hour"], r["platform"] + 1, users.index(r["uuid"]) + 1 if r["uuid"] else len(users) + 1) for r in rows.collect()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_numerics_do_not_move_with_the_codes(spark, rows):
    """The wide rows were moved by row key, and a value of each category by its own."""
    got = X.bayes_matrix(rows, ["platform", "uuid"], ["hour", "score"], insert=put(spark))
    whole = X.bayes_matrix(put(spark)(rows), ["platform", "uuid"], ["hour", "score"])
    assert got.columns == whole.columns == ["display_id", "ad_id", "clicked", "hour", "score", "platform", "uuid"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert "collect_list" not in plan(got) and not [d for d in plan(got).split("\n\n") if ") Exchange" in d and "score" in d]


def test_numbered_rows_meet_their_numerics_afterwards(spark, rows):
    rows = rows.withColumn("country_group", F.lit("US"))
    got = X.sequence_matrix(rows, ["hour", "score"], insert=put(spark))
    whole = X.sequence_matrix(put(spark)(rows), ["hour", "score"])
    assert got.columns == whole.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert [r["position"] for r in got.orderBy("ts", "display_id", "ad_id").collect()] == list(range(1, 81))


def test_rows_do_not_move_for_few_documents(spark, rows):
    features = materialise(numbers(spark).withColumn("ad_score", F.col("score") * 2))
    both = rows.withColumn("ad_document_id", F.col("document_id") + 1)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        sent, moved = D.insert_document_features(both, features), D.insert_document_features(both, features, small=3)
        assert "Exchange hashpartitioning" not in plan(sent) and "SortMergeJoin" not in plan(sent)
        assert "SortMergeJoin" in plan(moved) and sent.columns == moved.columns
        assert sorted(map(str, sent.collect())) == sorted(map(str, moved.collect()))
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert {(r["document_id"], r["score"], r["ad_score"]) for r in sent.collect()} == {(0, 0.5, 3.0), (1, 1.5, 18.0), (2, 9.0, 4.0), (3, 2.0, 0.0)}


def test_shuffle_files_go_with_the_query(spark):
    """Before, they stayed until the driver collected its garbage."""
    prepare_session(spark)
    assert SQL_SETTINGS["spark.sql.classic.shuffleDependency.fileCleanup.enabled"] == "true"
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(d) for d in manager.localDirsString()]
    seen = lambda: sum(f.startswith("shuffle_") for top in folders for _, _, fs in os.walk(top) for f in fs)
    before = seen()
    for _ in range(3):
        materialise(spark.range(20_000).groupBy((F.col("id") % 500).alias("g")).count())
    assert seen() <= before
