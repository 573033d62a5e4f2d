"""Many keys looked up at once: the same values by broadcast joins, by one stacked join and by plain Python."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from clickloom.plans import features as X

KEYS = {"a": "a", "b": "b", "ad_b": "b"}


@pytest.fixture(scope="module")
def tables(spark):
    # A hot key value, null keys, keys without a profile, a null row id and rows that repeat whole.
    data = [(d, i, None if d % 11 == 0 else "hot" if d % 3 else f"a{d}", d % 5 if i else None, i) for d in range(60) for i in range(3)]
    data += [(None, 1, "hot", 2, 3), (5, 1, *data[16][2:]), (5, 1, *data[16][2:])]
    rows = spark.createDataFrame(data, "display_id bigint, ad_id bigint, a string, b bigint, ad_b bigint")
    found = [("a", "hot", 1, 0.5), ("a", None, 2, 0.25), ("a", "a3", 3, None), ("b", "0", 4, 1.0), ("b", "2", 5, 2.0), ("b", None, 6, 3.0)]
    return rows, spark.createDataFrame(found, "key_name string, key_value string, n bigint, p double")


def brute(rows, profiles):
    known = {(r["key_name"], r["key_value"]): (r["n"], r["p"]) for r in profiles.collect()}
    out = []
    for r in rows.collect():
        line = list(r)
        for c, name in KEYS.items():
            n, p = known.get((name, None if r[c] is None else str(r[c])), (0, 0.0))
            line += [n, 0.0 if p is None else p]
        out.append(tuple(line))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [0, 4, 1000])
def test_same_rows_whatever_is_broadcast(tables, small):
    rows, profiles = tables
    out = X.insert_profiles(rows, profiles, KEYS, ["n", "p"], small=small)
    names = [*rows.columns, *[f"{c}_{s}" for c in KEYS for s in ("n", "p")]]
    assert set(out.columns) == set(names)
    assert sorted((tuple(r) for r in out.select(names).collect()), key=str) == brute(rows, profiles)
    assert X.insert_profiles(rows.limit(0), profiles, KEYS, ["n"], small=small).count() == 0
    assert X.insert_profiles(rows, profiles.limit(0), KEYS, ["n"], small=small).where("a_n <> 0 OR b_n <> 0").count() == 0


def test_wide_rows_move_once_for_all_large_keys(spark, tables):
    rows, profiles = tables
    wide = rows.withColumn("payload", F.concat_ws(":", "display_id", F.lit("x")))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    text = io.StringIO()
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        with contextlib.redirect_stdout(text):
            X.insert_profiles(wide, profiles, KEYS, ["n", "p"], small=0).explain("formatted")
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    details = text.getvalue().split("\n\n")
    moved = [d for d in details if ") Exchange" in d and "payload" in d]
    joins = [d for d in details if ") SortMergeJoin" in d]
    assert len(moved) == 1 and len(joins) == 2, "one join with the profiles, one back to the rows"


def test_two_values_under_one_row_key_are_an_error(spark, tables):
    _, profiles = tables
    rows = spark.createDataFrame([(1, 1, "hot"), (1, 1, "a3")], "display_id bigint, ad_id bigint, a string")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY|uplicate"):
        X.lookup(rows, profiles, {"a": "a"}, ["n"]).collect()


def test_codes_of_all_columns_come_from_one_join(spark, tables):
    rows, _ = tables
    rows = rows.where("display_id IS NOT NULL").distinct()
    got = {(r["display_id"], r["ad_id"]): (r["a"], r["b"]) for r in X.category_codes(rows, ["a", "b"], ["display_id", "ad_id"]).collect()}
    data = rows.collect()
    levels = {c: sorted({r[c] for r in data if r[c] is not None}) for c in ("a", "b")}
    code = lambda c, x: len(levels[c]) + 1 if x is None else levels[c].index(x) + 1
    assert got == {(r["display_id"], r["ad_id"]): (code("a", r["a"]), code("b", r["b"])) for r in data}
