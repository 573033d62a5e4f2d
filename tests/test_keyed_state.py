"""Keyed stream state: exact for rows out of order, as large as the open buckets; tables of newest rows stay small."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.operators import profiles as P
from clickloom.streaming import streams as T
from clickloom.streaming.keyed import gap_profile, keyed_gaps
from clickloom.streaming.versioned import VersionedTable

VIEWS = "uuid bigint, document_id bigint, ts bigint, platform int, geo_location string, traffic_source int"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    data = [(1 if i % 3 == 0 else rng.choice([2, 3, None]), 0, i * 500 + rng.randrange(1500), 1, "US", 1) for i in range(600)]
    return spark.createDataFrame(data, VIEWS)


def write_files(log, root, order, files):
    line = log.withColumn("part", F.ntile(files).over(W.orderBy(F.expr(order))))
    for p in range(1, files + 1):
        line.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(root)


def check(got, want):
    got, want = ({r["uuid"]: r for r in df.collect()} for df in (got, want))
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("tot", "ts_min", "ts_max", "gap_min", "gap_max"):
            assert got[k][c] == w[c], (k, c)
        for c in ("ts_avg", "ts_var", "gap_avg", "gap_var"):
            assert got[k][c] == pytest.approx(w[c]), (k, c)


@pytest.mark.parametrize("order", ["-ts", "hash(uuid, ts)"])
def test_late_rows_and_a_repeated_batch(spark, log, tmp_path, order):
    root, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    write_files(log, root, order, 4)
    broken = T.fail_once(2)
    T.with_restart(
        lambda: keyed_gaps(T.page_view_stream(spark, root, 1), "uuid", out, ckpt, "1 hour", 20_000, broken), lambda: None
    )
    check(gap_profile(spark, out, "uuid"), P.time_profile(log, ["uuid"], "ts", {}))


def test_state_follows_the_open_buckets(spark, log, tmp_path):
    """In time order with a short delay, buckets behind the watermark leave the state; rows behind it are left out."""
    root, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    write_files(log, root, "ts", 6)
    query = keyed_gaps(T.page_view_stream(spark, root, 1), "uuid", out, ckpt, "2 seconds", 20_000)
    check(gap_profile(spark, out, "uuid"), P.time_profile(log, ["uuid"], "ts", {}))
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    buckets = log.selectExpr("uuid", "ts div 20000 AS b").distinct().count()
    # One value and one timer (two entries: by key and by time) for each open bucket of the four keys.
    assert sizes and max(sizes) <= 3 * 4 * 5 < 3 * buckets and max(sizes) < log.count() / 5


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    root, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for ts in ([-5000, 0, 900_000], [950_000], [3000, 960_000]):
        spark.createDataFrame([(1, 0, t, 1, "US", 1) for t in ts], VIEWS).coalesce(1).write.mode("append").parquet(root)
    keyed_gaps(T.page_view_stream(spark, root, 1), "uuid", out, ckpt, "1 second", 20_000)
    got = gap_profile(spark, out, "uuid").first()
    assert (got["tot"], got["ts_min"], got["ts_max"], got["gap_min"]) == (5, -5000, 960_000, 5000)


def test_versions_stay_few(spark, tmp_path):
    """Fifty batches: the newest rows are right after each tenth, and a reader opens a bounded number of runs."""
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], fan=4)
    want = {}
    for batch in range(50):
        rows = [(k, batch * 10 + k if k else -batch) for k in {batch % 7, batch % 3}] + [(None, batch)]
        want |= dict(rows)
        assert table.put(spark.createDataFrame(rows, "k int, x int").coalesce(1), batch)
        assert len(table.manifest()["runs"]) <= 3 * 3
        if batch % 10 == 9:
            assert {r["k"]: r["x"] for r in table.read().collect()} == want
    assert len(table.read().inputFiles()) <= 9 * 8
    assert not table.put(spark.createDataFrame([(0, 99)], "k int, x int"), 49)
    assert {r["k"]: r["x"] for r in table.read().collect()} == want
    stored = len(list((tmp_path / "t" / "runs").iterdir()))
    assert stored <= len(table.manifest()["runs"]) + len(table.manifest()["gone"])


def test_no_batch_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        VersionedTable(spark, str(tmp_path / "none"), ["k"]).read()


def test_many_small_keys_share_entries(spark, tmp_path):
    """The engine calls the function for shards and buckets, however many keys there are; keys of a shard stay apart."""
    root, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    log = spark.range(6000).select(
        F.when(F.col("id") % 2000 > 0, F.col("id") % 2000).alias("uuid"), F.lit(0).cast("bigint").alias("document_id"),
        (F.col("id") % 7 * 9000 + F.col("id") % 2).alias("ts"), F.lit(1).alias("platform"), F.lit("US").alias("geo_location"), F.lit(1).alias("traffic_source"),
    )
    write_files(log, root, "hash(uuid, ts)", 3)
    query = keyed_gaps(T.page_view_stream(spark, root, 1), "uuid", out, ckpt, "1 hour", 20_000, shards=4)
    check(gap_profile(spark, out, "uuid"), P.time_profile(log, ["uuid"], "ts", {}))
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 3 * 4 * 3 < log.select("uuid").distinct().count() / 10
