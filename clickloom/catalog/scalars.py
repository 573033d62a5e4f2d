"""Scalar-function queries."""

from pyspark.sql import functions as F

from clickloom.catalog.registry import query
from clickloom.functions import scalars as S


@query(
    "scl_geo_parts",
    """SELECT display_id, split_part(geo_location, '>', 1) AS country, nullif(split_part(geo_location, '>', 2), '') AS state,
       nullif(split_part(geo_location, '>', 3), '') AS dma FROM display_events""",
)
def _(v):
    parts = [S.geo_part("geo_location", i).alias(n) for i, n in ((1, "country"), (2, "state"), (3, "dma"))]
    return v.display_events.select("display_id", *parts)


@query(
    "scl_country_group",
    """SELECT display_id, country_group, CAST(CASE country_group WHEN 'US' THEN 1 WHEN 'CA' THEN 2 WHEN 'GB' THEN 3 ELSE 4 END
       AS INTEGER) AS country_id FROM events_derived""",
)
def _(v):
    country = S.geo_part("geo_location", 1)
    return v.display_events.select(
        "display_id", S.country_group(country).alias("country_group"), S.country_group_id(country).alias("country_id")
    )


@query("scl_hour_day", "SELECT display_id, hour, day, CAST(1 + 24 * (day - 1) + (hour - 1) AS INTEGER) AS log_hour FROM events_derived")
def _(v):
    return v.display_events.select(
        "display_id", S.hour_of_day("ts").alias("hour"), S.day_of_log("ts").alias("day"), S.hour_of_log("ts").alias("log_hour")
    )


@query("scl_epoch_offset", "SELECT document_id, publish_ts FROM doc_meta_derived")
def _(v):
    return v.doc_meta.select("document_id", S.publish_offset("publish_time").alias("publish_ts"))


@query("scl_year_filter", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) > 1996 AND year(o_orderdate) < 2000")
def _(v):
    year = F.year("o_orderdate")
    return v.table("orders").where((year > 1996) & (year < 2000)).select("o_orderkey", year.alias("year"))


@query("scl_first_char_int", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, TRY_CAST(left(o_orderstatus, 1) AS INTEGER) AS status FROM orders")
def _(v):
    return v.table("orders").select(
        "o_orderkey", S.first_char_int("o_orderpriority").alias("priority"), S.first_char_int("o_orderstatus").alias("status")
    )


@query(
    "scl_hex_halves",
    """SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 7) AS BIGINT) AS user_id1,
       CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 8, 7) AS BIGINT) AS user_id2 FROM customer""",
)
def _(v):
    uid = F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 14)
    return v.table("customer").select("c_custkey", S.hex_half(uid, 1).alias("user_id1"), S.hex_half(uid, 2).alias("user_id2"))


@query("scl_strip_quotes", "SELECT event_id, replace(replace(props, '\"', ''), '''', '') AS props FROM events")
def _(v):
    return v.table("events").select("event_id", S.strip_quotes("props").alias("props"))


@query(
    "scl_regex_replace_extract",
    """SELECT c_custkey, replace(c_mktsegment || ' (x): ' || c_name, ' ', '_') AS n0,
       CAST(regexp_extract(name, 'v([0-9]+)', 1) AS INTEGER) AS version,
       CAST(regexp_extract(name, '\\.([0-9]{3})$', 1) AS INTEGER) + 1 AS cohort,
       translate(c_mktsegment || ' (x): ' || c_name, ' ():', '____') AS clean
       FROM (SELECT *, 'GB_v' || CAST(500 + c_nationkey AS VARCHAR) || '_' || CAST(c_custkey AS VARCHAR) || '.' ||
             lpad(CAST(1 + c_custkey % 11 AS VARCHAR), 3, '0') AS name FROM customer) t""",
)
def _(v):
    name = F.concat(
        F.lit("GB_v"), (500 + F.col("c_nationkey")).cast("string"), F.lit("_"), F.col("c_custkey").cast("string"),
        F.lit("."), F.lpad((1 + F.col("c_custkey") % 11).cast("string"), 3, "0"),
    )
    label = F.concat("c_mktsegment", F.lit(" (x): "), "c_name")
    return v.table("customer").select(
        "c_custkey", F.replace(label, F.lit(" "), F.lit("_")).alias("n0"), S.model_version(name).alias("version"),
        S.model_cohort(name).alias("cohort"), S.clean_name(label).alias("clean"),
    )


@query(
    "scl_pad",
    """SELECT o_orderkey, 'testset_' || lpad(CAST(o_orderkey % 32 + 1 AS VARCHAR), 3, '0') || '_' ||
       lpad(CAST(o_custkey % 32 + 1 AS VARCHAR), 3, '0') AS batch_name FROM orders""",
)
def _(v):
    name = S.batch_name("testset", F.col("o_orderkey") % 32 + 1, F.col("o_custkey") % 32 + 1)
    return v.table("orders").select("o_orderkey", name.alias("batch_name"))


@query("scl_concat_collapse", "SELECT display_id, string_agg(CAST(ad_id AS VARCHAR), ' ' ORDER BY price DESC, ad_id) AS ads FROM impressions GROUP BY 1")
def _(v):
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("p"), "ad_id")))
    ads = F.array_join(F.transform(ranked, lambda s: s["ad_id"].cast("string")), " ")
    return v.impressions.groupBy("display_id").agg(ads.alias("ads"))


@query(
    "scl_sparse_text",
    """SELECT l_orderkey, l_linenumber, concat_ws(' ', '1:' || CAST(CAST(nullif(l_quantity, 0) AS INTEGER) AS VARCHAR),
       CASE WHEN l_returnflag = 'R' THEN '2:1' END, CASE WHEN l_linestatus = 'O' THEN '3:1' END,
       '4:' || CAST(l_linenumber AS VARCHAR)) AS line FROM lineitem""",
)
def _(v):
    df = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"),
        (F.col("l_returnflag") == "R").cast("int").alias("r"), (F.col("l_linestatus") == "O").cast("int").alias("o"),
        F.col("l_linenumber").alias("n"),
    )
    return df.select("l_orderkey", "l_linenumber", S.sparse_text(["q", "r", "o", "n"]).alias("line"))


@query("scl_number_format", "SELECT o_orderkey, translate(format('{:,.1f}', round(o_totalprice * 10) / 10), ',.', '.,') AS price FROM orders")
def _(v):
    return v.table("orders").select("o_orderkey", S.format_number_es(F.round(F.col("o_totalprice") * 10) / 10, 1).alias("price"))


@query(
    "scl_duration_text",
    """SELECT display_id, CASE WHEN s < 60 THEN format('{:.1f}', round(s / 1.0, 1)) || ' segundos'
       WHEN s < 3600 THEN format('{:.1f}', round(s / 60.0, 1)) || ' minutos'
       WHEN s < 86400 THEN format('{:.1f}', round(s / 3600.0, 1)) || ' horas'
       ELSE format('{:.2f}', round(s / 86400.0, 2)) || ' días' END AS elapsed
       FROM (SELECT display_id, CAST(display_id * display_id AS DOUBLE) / 8 AS s FROM display_events) t""",
)
def _(v):
    s = (F.col("display_id") * F.col("display_id")).cast("double") / 8
    return v.display_events.select("display_id", S.duration_text(s).alias("elapsed"))


_DUMMIES = ", ".join(
    [f"CAST(CASE WHEN platform = {i} THEN 1 ELSE 0 END AS INTEGER) AS platform{i}" for i in (1, 2, 3)]
    + [f"CAST(CASE WHEN country_group = '{c}' THEN 1 ELSE 0 END AS INTEGER) AS country{c}" for c in ("US", "CA", "GB", "Rest")]
)


@query("scl_one_hot", f"SELECT display_id, {_DUMMIES} FROM events_derived")
def _(v):
    return v.events_derived.select("display_id", *S.platform_dummies(), *S.country_dummies())


@query(
    "scl_int_div_mod",
    """SELECT display_id, CAST(floor((ts - 100000000000) / 3600000.0) AS BIGINT) AS q,
       ((ts - 100000000000) % 3600000 + 3600000) % 3600000 AS r FROM (SELECT display_id, ts + display_id AS ts FROM display_events) t""",
)
def _(v):
    x = F.col("ts") + F.col("display_id") - 100_000_000_000
    return v.display_events.select("display_id", S.floor_div(x, S.HOUR_MS).alias("q"), S.floor_mod(x, S.HOUR_MS).alias("r"))


@query(
    "scl_log_round_sqrt",
    """SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price, round(o_totalprice / 1000) AS thousands,
       round(sqrt(o_totalprice), 6) AS root, CAST(floor(o_totalprice) AS BIGINT) AS whole FROM orders""",
)
def _(v):
    p = F.col("o_totalprice")
    return v.table("orders").select(
        "o_orderkey", F.round(F.ln(p), 6).alias("log_price"), F.round(p / 1000).alias("thousands"),
        F.round(F.sqrt(p), 6).alias("root"), F.floor(p).alias("whole"),
    )


@query("scl_denormalise", "SELECT display_id, CAST(n AS INTEGER) AS num_ads FROM (SELECT display_id, count(*) AS n FROM impressions GROUP BY 1) t")
def _(v):
    stored = v.impressions.groupBy("display_id").agg(((F.count("*") - 2) / 10).alias("x"))
    return stored.select("display_id", S.denormalise_size("x").alias("num_ads"))


@query(
    "scl_array_ops",
    """SELECT display_id, list_slice(a, 1, 3) AS head3, a[1] AS first_ad, list_contains(a, 7) AS has7,
       CAST(len(list_distinct(list_transform(a, lambda x: x % 5))) AS INTEGER) AS kinds, list_reverse(a) AS backwards
       FROM (SELECT display_id, list(ad_id ORDER BY ad_id) AS a FROM impressions GROUP BY 1) t""",
)
def _(v):
    lists = v.impressions.groupBy("display_id").agg(F.array_sort(F.collect_list("ad_id")).alias("a"))
    return lists.select(
        "display_id", F.slice("a", 1, 3).alias("head3"), F.element_at("a", 1).alias("first_ad"),
        F.array_contains("a", F.lit(7).cast("bigint")).alias("has7"),
        F.size(F.array_distinct(F.transform("a", lambda x: x % 5))).alias("kinds"), F.reverse("a").alias("backwards"),
    )


@query(
    "scl_casts",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS uuid, CAST(o_totalprice AS BIGINT) AS price_i,
       CAST(o_custkey AS DOUBLE) AS uuid_d, TRY_CAST(o_orderpriority AS INTEGER) AS bad FROM
       (SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders) t""",
)
def _(v):
    return v.table("orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("uuid"), F.col("o_totalprice").cast("bigint").alias("price_i"),
        F.col("o_custkey").cast("double").alias("uuid_d"), F.col("o_orderpriority").try_cast("int").alias("bad"),
    )


@query("scl_isnan_zero", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0.0 ELSE round(l_discount / l_tax, 6) END AS ratio FROM lineitem")
def _(v):
    ratio = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.round(F.try_divide("l_discount", "l_tax"), 6))
    return v.table("lineitem").select("l_orderkey", "l_linenumber", S.nan_to_zero(ratio).alias("ratio"))
