"""Hand-made rows for the edge cases: null keys, one-row groups, ties, constants, malformed text."""

import math

import pytest
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import scalars as S
from clickloom.operators import aggregates as A
from clickloom.operators import joins as J
from clickloom.operators import profiles as P
from clickloom.operators import ranks as R
from clickloom.operators import splits as L
from clickloom.plans import features as X
from clickloom.plans import ranking as K
from clickloom.sources import readers
from clickloom.sources.stages import StageStore


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_null_keys_join_each_other(spark):
    left = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "k int, a int")
    right = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "k int, b int")
    assert J.join_null_safe(left, right, ["k"]).count() == 5
    assert J.join_null_safe(left, right, ["k"], "left_semi").count() == 3


def test_null_key_is_a_profile_group(spark):
    df = spark.createDataFrame([(None, 10, 1), (None, 40, 0), (5, 3, 1)], "k int, ts bigint, clicked int")
    got = {r["k"]: r for r in P.click_profile(df, ["k"]).collect()}
    assert got[None]["tot"] == 2 and got[None]["gap_min"] == 30 and got[None]["gap_var"] is None
    one = got[5]
    assert (one["gap_min"], one["gap_max"], one["gap_avg"], one["gap_var"], one["ts_var"]) == (0, 0, 0.0, 0.0, None)


def test_equal_instants_give_zero_gaps(spark):
    df = spark.createDataFrame([(1, t, 0) for t in (5, 5, 5, 9)], "k int, ts bigint, clicked int")
    r = P.click_profile(df, ["k"]).first()
    assert (r["gap_min"], r["gap_max"]) == (0, 4)
    assert r["gap_avg"] == pytest.approx(4 / 3) and r["gap_var"] == pytest.approx(16 / 3)


def displays(spark):
    # 1: click at position 2; 2: no click; 3: two clicks at 1 and 3
    data = [(1, 10, 0, 0.9), (1, 11, 1, 0.5), (2, 10, 0, 0.4), (2, 12, 0, 0.3), (3, 1, 1, 0.8), (3, 2, 0, 0.7), (3, 3, 1, 0.6)]
    return spark.createDataFrame(data, "display_id int, ad_id int, clicked int, prob double")


def test_map_with_missing_and_double_clicks(spark):
    r = K.map_single(displays(spark)).first()
    assert r["clicks"] == 3 and r["map"] == pytest.approx((1 / 2 + 1 + 1 / 3) / 3)
    ap = {x["display_id"]: x["ap"] for x in K.average_precision_at_k(displays(spark), 12).collect()}
    assert ap == {1: pytest.approx(0.5), 3: pytest.approx((1 + 2 / 3) / 2)}


def test_map_of_nothing_is_zero(spark):
    empty = displays(spark).where("display_id > 99")
    assert K.map_single(empty).first()["map"] == 0
    assert K.map_at_k(empty, 12).first()["map"] == 0
    by_range = K.map_by_ranges(empty.withColumn("day", F.lit(1)), [(1, 11)]).collect()
    assert [r["map12"] for r in by_range] == [0]


def test_single_and_general_average_precision_agree(spark):
    one_click = displays(spark).where("display_id = 1")
    assert K.map_single(one_click).first()["map"] == K.map_at_k(one_click, 12).first()["map"]


def test_relevant_list_longer_than_k(spark):
    df = spark.createDataFrame([(1, i, 1, 1.0 - i / 10) for i in range(5)], "display_id int, ad_id int, clicked int, prob double")
    assert K.map_at_k(df, 2).first()["map"] == pytest.approx(1.0)


def test_repeated_predictions_hit_once(spark):
    pred = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "g int, i string, o int")
    rel = spark.createDataFrame([(1, "a"), (1, "b")], "g int, i string")
    ap = K.average_precision_with_repeats(pred, rel, 3, "g", "i", [F.asc("o")]).first()["ap"]
    assert ap == pytest.approx((1 + 2 / 3) / 2)
    none = K.average_precision_with_repeats(pred, rel.where("i = 'x'"), 3, "g", "i", [F.asc("o")]).first()["ap"]
    assert none == 0


def test_ties_go_to_the_lower_id(spark):
    df = spark.createDataFrame([(1, i, 0, 0.5) for i in (3, 1, 2)], "display_id int, ad_id int, clicked int, prob double")
    assert K.ranked_lists(df).first()["ad_id"] == "1 2 3"
    got = R.rank_in_group(df, ["display_id"], [F.desc("prob"), F.asc("ad_id")])
    assert {r["ad_id"]: r["position"] for r in got.collect()} == {1: 1, 2: 2, 3: 3}


def test_sequence_ties_go_to_the_higher_index(spark):
    df = spark.createDataFrame([([0, 1, 0], [0.5, 0.5, 0.5])], "l array<int>, s array<double>")
    assert df.select(K.sequence_positions(df, "l", "s").alias("p")).first()["p"] == 2


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 7) for i in range(5)], "i int, x int")
    assert X.minmax(df, ["x"]).distinct().collect()[0][0] is None
    assert X.zscore(df, ["x"]).distinct().collect()[0][0] is None
    assert A.label_correlations(df.withColumn("y", F.col("i") % 2), "y", ["x"]).first()["corr"] is None


def test_malformed_rows(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    open(path, "w").write("id,price\n1,5\nx,6\n3\n\\N,8\n4,9\n")
    kept = readers.csv_without_malformed(spark, path, "id bigint, price bigint")
    assert rows(kept, "id") == [(1, 5), (4, 9)]
    assert kept.select("price").where("price > 8").count() == 1
    assert readers.malformed_rows(spark, path, "id bigint, price bigint").count() == 3


def test_null_tokens_and_first_character(spark):
    df = spark.createDataFrame([("\\N",), ("2",), ("",)], "p string")
    got = df.select(S.null_token("p", "\\N").alias("a"), S.first_char_int("p").alias("b")).collect()
    assert [tuple(r) for r in got] == [(None, None), ("2", 2), ("", None)]
    fixed = C.update_where(df, "p", F.col("p") == "\\N", "2")
    assert [r["p"] for r in fixed.collect()] == ["2", "2", ""]


def test_hours_and_days_before_the_start(spark):
    df = spark.createDataFrame([(-1,), (-3_600_001,), (0,), (86_400_000,)], "ts bigint")
    got = df.select("ts", S.hour_of_day("ts").alias("h"), S.day_of_log("ts").alias("d")).collect()
    assert {r["ts"]: (r["h"], r["d"]) for r in got} == {-1: (24, 0), -3_600_001: (23, 0), 0: (1, 1), 86_400_000: (1, 2)}


def test_hex_halves(spark):
    df = spark.createDataFrame([("0000001000000f",), ("fffffff0000000",)], "u string")
    got = [tuple(r) for r in df.select(S.hex_half("u", 1), S.hex_half("u", 2)).collect()]
    assert got == [(1, 15), (0xFFFFFFF, 0)]


def test_publish_years(spark):
    df = spark.createDataFrame([("2016-06-14 03:59:59",), ("1999-01-01 00:00:00",), ("2017-01-01 00:00:00",), ("",)], "t string")
    got = [r[0] for r in df.select(S.publish_offset("t")).collect()]
    assert got == [-998, None, None, None]
    assert df.select(S.publish_offset("t", year_filter=False).alias("x")).where("x IS NULL").count() == 1


def test_text_formats(spark):
    df = spark.createDataFrame([(1234.5, 30.0), (1234567.04, 90061.0)], "x double, s double")
    got = [tuple(r) for r in df.select(S.format_number_es("x"), S.duration_text("s")).collect()]
    assert got == [("1.234,5", "30.0 segundos"), ("1.234.567,0", "1.04 días")]


def test_denormalised_sizes(spark):
    df = spark.createDataFrame([((n - 2) / 10, n) for n in range(2, 13)], "x double, n int")
    assert df.where(S.denormalise_size("x") != F.col("n")).count() == 0


def test_woe_of_an_empty_cell(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "l string, y int")
    got = {r["level"]: r for r in A.woe_iv(df, "l", "y").collect()}
    assert got["b"]["woe"] is None and got["a"]["woe"] == pytest.approx(math.log(2))
    assert all(r["woe"] is not None for r in A.woe_iv(df, "l", "y", smoothing=0.5).collect())


def test_leave_one_out(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1)], "k int, y int")
    got = sorted((r["k"], r["y"], r["prob"]) for r in A.leave_one_out_rate(df, "k", "y").collect())
    assert got == [(1, 0, 1.0), (1, 1, 0.5), (1, 1, 0.5), (2, 1, 0.0)]


def test_report_stops_at_the_next_block(spark, tmp_path):
    path = str(tmp_path / "r.txt")
    open(path, "w").write("run\n\tFeature\tGain\n1\tad_prob\t0.5\n2\tday\t0.25\nFeature\tCover\tCover\n1\tx\t1\n")
    assert rows(readers.report(spark, path), "position") == [(1, "ad_prob", 0.5), (2, "day", 0.25)]


def test_stage_is_computed_once_and_again_for_new_columns(spark, tmp_path):
    store, runs = StageStore(spark, str(tmp_path / "s")), []

    def compute():
        runs.append(1)
        return spark.range(3).withColumn("b", F.lit(len(runs)))

    store.get("t", compute)
    store.get("t", compute, columns=["b"])
    assert len(runs) == 1
    assert StageStore(spark, str(tmp_path / "s")).read("t", ["missing"]) is None


def test_matrix_has_the_published_width():
    numerics = X.tree_numerics()
    assert (len(numerics), len(X.leader_numerics()), len(X.tree_features())) == (348, 154, 510)
    assert len(set(X.tree_features())) == 510


def test_accumulate_equals_one_pass(spark):
    df = spark.createDataFrame([(k, i) for i in range(20) for k in (1, None, 3)], "k int, x bigint")

    def state(d):
        return d.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"))

    merged = J.accumulate(state(df.where("x < 7")), state(df.where("x >= 7")), "k", ["n"], ["lo"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, state(df).select("k", "n", "lo").collect()))


def test_a_stage_without_its_marker_is_computed_again(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "s"))
    store.get("t", lambda: spark.range(100))
    (tmp_path / "s" / "t" / "_SUCCESS").unlink()
    assert store.read("t") is None and store.get("t", lambda: spark.range(7)).count() == 7


def test_data_lines_that_equal_the_header_stay(spark, tmp_path):
    for name in ("a", "b"):
        open(tmp_path / f"{name}.csv", "w").write('id,price\nid,price\n1,"5"\n')
    got = sorted(map(tuple, readers.text_fields(spark, str(tmp_path), ["a", "b"]).collect()))
    assert got == [("1", "5"), ("1", "5"), ("id", "price"), ("id", "price")]
    assert readers.malformed_rows(spark, str(tmp_path), "id bigint, price bigint").count() == 2


def test_profile_keys_of_any_type_stay_apart(spark):
    df = spark.sql("""SELECT * FROM VALUES (1.2D, TIMESTAMP'2020-01-01 00:00:00.1', DATE'2020-01-01', 1, 0), (1.7D, TIMESTAMP'2020-01-01 00:00:00.2',
        DATE'2020-01-02', 2, 1) AS t(d, t, day, ts, clicked)""").withColumn("ts", F.col("ts").cast("bigint"))
    got = P.click_profiles(df, ["d", "t", "day"]).collect()
    assert len(got) == 6 and {r["tot"] for r in got} == {1}
    assert {r["key_value"] for r in got if r["key_name"] == "d"} == {"1.2", "1.7"}


def test_null_scores_rank_last(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 0.5), (1, 2, 1, None), (1, 3, 0, None), (2, 1, 1, None)], "display_id int, ad_id int, clicked int, prob double"
    )
    assert K.map_single(df).first()["map"] == pytest.approx((1 / 2 + 1) / 2) == K.map_at_k(df, 12).first()["map"]
    wide = df.withColumn("other", F.lit(0.1)).withColumn("day", F.lit(1))
    got = {r["score"]: r["map12"] for r in K.map_by_ranges(wide, [(1, 2)], scores=["prob", "other"]).collect()}
    assert got == {"prob": pytest.approx(0.75), "other": pytest.approx(0.75)}


def test_a_null_group_is_a_group(spark):
    df = spark.createDataFrame([(g, i) for i in range(2) for g in (None, 1, 2, 3, 4)], "g int, i int")
    for out, c in (
        (L.train_valid(df, "g", 0.5), "part"), (L.tail_validation(df, "g", 0.5), "part"), (L.random_blocks(df, "g", 3), "block"),
        (L.ordered_blocks(df, "g", 2), "block"), (L.kfold(df, "g", 2), "fold"), (L.sample_groups(df, "g", 1.0), "i"),
    ):
        rows = out.select("g", c).collect()
        assert len(rows) == 10 and all(r[c] is not None for r in rows)
        if c != "i":
            assert len({tuple(r) for r in rows}) == 5
    sub = L.ordered_sub_blocks(df, "g", 2, 2)
    assert sub.where("block IS NULL OR sub_block IS NULL").count() == 0 and sub.where("g IS NULL AND block = 1").count() == 2
