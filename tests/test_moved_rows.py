"""Rows that move no more often than their joins need, and fits on all rows."""

import contextlib
import io

from pyspark.sql import functions as F

from clickloom.operators import doctypes as D
from clickloom.plans import features as X
from clickloom.plans import models as M
from clickloom.plans.wide import wide_impressions


def plan(spark, make):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    text = io.StringIO()
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        with contextlib.redirect_stdout(text):
            make().explain("formatted")
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    return text.getvalue().split("\n\n")


def test_impressions_move_for_their_display_and_their_ad_only(spark):
    clicks = spark.createDataFrame([(1, 7, 1), (1, 8, 0), (2, 7, 0), (3, 9, 1)], "display_id bigint, ad_id bigint, clicked int")
    events = spark.createDataFrame(
        [(1, 5, 10, 0, 1, "US>a>b"), (2, 6, 11, 3600000, 2, "FR>a>b"), (3, 6, None, 1, 2, "FR>a>b")],
        "display_id bigint, uuid bigint, document_id bigint, ts bigint, platform int, geo_location string",
    )
    promoted = spark.createDataFrame([(7, 11, "c", "d"), (8, 10, "e", "f")], "ad_id bigint, document_id bigint, campaign_id string, advertiser_id string")
    meta = spark.createDataFrame([(10, "s", "p", ""), (11, "t", None, "2015-01-01 00:00:00")], "document_id bigint, source_id string, publisher_id string, publish_time string")
    out = wide_impressions(clicks, events, promoted, meta)
    got = sorted((r["display_id"], r["ad_id"], r["source_id"], r["ad_source_id"], r["country_group"], r["hour"]) for r in out.collect())
    assert got == [(1, 7, "s", "t", "US", 1), (1, 8, "s", "s", "US", 1), (2, 7, "t", "t", "Rest", 2)]
    moved = [d for d in plan(spark, lambda: wide_impressions(clicks, events, promoted, meta)) if ") Exchange" in d and "clicked" in d]
    assert len(moved) == 2


def test_documents_of_all_kinds_meet_the_rows_once_a_role(spark):
    a = spark.createDataFrame([(1, 0.5, 0.25), (2, 0.1, 0.2)], "document_id bigint, a_prob double, ad_a_prob double")
    b = spark.createDataFrame([(2, 0.3, 0.4), (3, 0.7, 0.8)], "document_id bigint, b_prob double, ad_b_prob double")
    rows = spark.createDataFrame([(1, 3), (2, 1), (None, 9)], "document_id bigint, ad_document_id bigint")

    def put():
        return D.insert_document_features(rows, D.combine_features([a, b]))

    got = {r["document_id"]: (r["a_prob"], r["b_prob"], r["ad_a_prob"], r["ad_b_prob"]) for r in put().collect()}
    assert got == {1: (0.5, 0.0, 0.0, 0.8), 2: (0.1, 0.3, 0.25, 0.0), None: (0.0, 0.0, 0.0, 0.0)}


def test_two_large_keys_are_joined_without_gathering(spark):
    rows = spark.createDataFrame([(1, 1, "x", 4), (1, 2, None, 5), (1, 2, "y", 5)], "display_id bigint, ad_id bigint, a string, b bigint")
    found = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "5", 3)], "key_name string, key_value string, n bigint")

    def put():
        return X.insert_profiles(rows, found, {"a": "a", "b": "b"}, ["n"], small=0)

    # Two rows with one row key and different values of a key are no error here.
    assert sorted((r["a"] or "", r["a_n"], r["b_n"]) for r in put().collect()) == [("", 2, 3), ("x", 1, 0), ("y", 0, 3)]
    assert not [d for d in plan(spark, put) if "collect_list" in d]


def test_a_cohort_is_fitted_on_all_its_rows(spark):
    rows = spark.range(24_000).select(
        F.col("id").alias("display_id"), F.lit(2).alias("num_ads"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ad_id"),
    ).withColumn("clicked", F.col("ad_id")).withColumn("x", (F.col("display_id") % 7 + F.col("ad_id")).cast("double"))
    models, fit_set = M.fit_bounded_cohorts(
        rows, "num_ads", "display_id", lambda **limits: M.boosting(["x"], maxIter=1, maxDepth=1, **limits)
    )
    assert set(models) == {2} and fit_set.count() == 48_000
