"""Source queries. Each writes rows of the given tables to the shared folder in the wanted format and reads them back."""

from pyspark.sql import functions as F

from clickloom.catalog.joins import KNOWN_USERS, known_users
from clickloom.catalog.registry import query
from clickloom.functions import scalars as S
from clickloom.operators.splits import ordered_sub_blocks, random_blocks
from clickloom.session import fresh_dir
from clickloom.sources import readers as R
from clickloom.sources import writers as O

EVENT_SCHEMA = "display_id bigint, uuid bigint, document_id bigint, ts bigint, platform int, geo_location string"


def as_csv(v, df, label):
    path = fresh_dir(v.spark, label)
    df.write.option("header", True).csv(path)
    return path


@query("src_typed_csv", "SELECT * FROM display_events")
def _(v):
    return R.typed_csv(v.spark, as_csv(v, v.display_events, "events"), EVENT_SCHEMA)


@query("src_inferred_csv", "SELECT CAST(ad_id AS INTEGER) AS ad, CAST(document_id AS INTEGER) AS doc, campaign_id AS campaign, advertiser_id AS advertiser FROM promoted")
def _(v):
    return R.inferred_csv(v.spark, as_csv(v, v.promoted, "promoted"), ["ad", "doc", "campaign", "advertiser"])


@query("src_drop_malformed", "SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 NOT IN (3, 7)")
def _(v):
    key = F.col("o_orderkey").cast("string")
    price = F.floor("o_totalprice").cast("string")
    line = (
        F.when(F.col("o_orderkey") % 10 == 3, F.concat_ws(",", key, F.lit("n/a"), "o_orderstatus"))
        .when(F.col("o_orderkey") % 10 == 7, F.concat_ws(",", key, price))
        .otherwise(F.concat_ws(",", key, price, "o_orderstatus"))
    )
    path = fresh_dir(v.spark, "malformed")
    v.table("orders").select(line.alias("value")).write.text(path)
    return R.csv_without_malformed(v.spark, path, "id bigint, price bigint, status string", header=False)


@query("src_schema_from_header", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def _(v):
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return R.csv_by_header(v.spark, as_csv(v, rows, "lines"), ["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query("src_text_lines", "SELECT CAST(display_id AS VARCHAR) AS display_id, CAST(uuid AS VARCHAR) AS uuid, geo_location FROM display_events")
def _(v):
    path = fresh_dir(v.spark, "quoted")
    rows = v.display_events.select("display_id", "uuid", "geo_location")
    rows.write.option("header", True).option("quoteAll", True).csv(path)
    return R.text_fields(v.spark, path, ["display_id", "uuid", "geo_location"])


@query("src_limited_read", "SELECT * FROM display_events ORDER BY display_id LIMIT 2500")
def _(v):
    return R.first_rows(R.typed_csv(v.spark, as_csv(v, v.display_events, "events"), EVENT_SCHEMA), ["display_id"])


@query(
    "src_batch_read",
    """SELECT i.display_id, ad_id, clicked, CAST(3 AS INTEGER) AS block, CAST(2 AS INTEGER) AS sub_block FROM impressions i JOIN
       (SELECT display_id, block, CAST(floor((row_number() OVER (PARTITION BY block ORDER BY display_id) - 1) * 4.0 / count(*) OVER (PARTITION BY block)) + 1 AS INTEGER) AS sub_block
        FROM (SELECT display_id, CAST(floor((row_number() OVER (ORDER BY display_id) - 1) * 8.0 / count(*) OVER ()) + 1 AS INTEGER) AS block
              FROM (SELECT DISTINCT display_id FROM impressions) d) t) b USING (display_id) WHERE b.block = 3 AND b.sub_block = 2""",
)
def _(v):
    path = fresh_dir(v.spark, "batches")
    O.partitioned(ordered_sub_blocks(v.impressions.drop("price"), "display_id", 8, 4), path, ["block", "sub_block"])
    return R.batch(v.spark, path, 3, 2)


@query("src_multi_file_union", "SELECT display_id, ad_id, clicked FROM impressions")
def _(v):
    root = fresh_dir(v.spark, "parts")
    blocks = random_blocks(v.impressions.drop("price"), "display_id", 4)
    O.partitioned(blocks, root, ["block"])
    return R.union_of(v.spark, [f"{root}/block={b}" for b in range(1, 5)])


@query("src_format_fallback", "SELECT * FROM display_events")
def _(v):
    base = fresh_dir(v.spark, "fallback")
    v.display_events.write.option("header", True).csv(f"{base}.csv")
    R.parquet_or_csv(v.spark, base, EVENT_SCHEMA)  # converts
    return R.parquet_or_csv(v.spark, base, EVENT_SCHEMA)  # reads the Parquet copy


@query("src_nested_text", "SELECT list([ad_id::DOUBLE, price] ORDER BY ad_id) AS x, list(clicked::DOUBLE ORDER BY ad_id) AS y FROM impressions GROUP BY display_id")
def _(v):
    rows = F.array_sort(F.collect_list(F.struct("ad_id", "price", "clicked")))
    nested = v.impressions.groupBy("display_id").agg(rows.alias("r")).select(
        F.transform("r", lambda s: F.array(s["ad_id"].cast("double"), s["price"])).alias("x"),
        F.transform("r", lambda s: s["clicked"].cast("double")).alias("y"),
    )
    path = fresh_dir(v.spark, "nested")
    nested.select(F.to_json(F.struct("x", "y")).alias("value")).write.text(path)
    return R.nested_text(v.spark, path)


@query("src_report_parse", "SELECT CAST(row_number() OVER (ORDER BY n DESC, p_brand) AS INTEGER) AS position, p_brand AS name, n / 4.0::DOUBLE AS gain FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) t")
def _(v):
    from pyspark.sql import Window as W

    brands = v.table("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    rn = F.row_number().over(W.orderBy(F.desc("n"), "p_brand"))  # a report: one row per brand
    rows = brands.select(rn.alias("o"), F.concat_ws("\t", rn.cast("string"), "p_brand", (F.col("n") / 4).cast("string")).alias("value"))
    extra = v.spark.createDataFrame(
        [(-1, "run\tbrand share"), (0, "\tFeature\tGain"), (10**6, "Feature\tCover\tCover"), (10**6 + 1, "1\tother\t9.5")], "o int, value string"
    )
    path = fresh_dir(v.spark, "report")
    rows.unionByName(extra).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return R.report(v.spark, path)


@query(
    "src_huge_scan",
    f"""SELECT uuid, document_id, platform, traffic_source, CAST(CASE split_part(geo_location, '>', 1) WHEN 'US' THEN 1 WHEN 'CA' THEN 2 WHEN 'GB' THEN 3 ELSE 4 END AS INTEGER) AS country_id, ts
        FROM page_views WHERE uuid IN ({KNOWN_USERS})""",
)
def _(v):
    path = as_csv(v, v.page_views, "page-views")
    return R.scan_page_views(v.spark, path, known_users(v), S.country_group_id(S.geo_part("geo_location", 1)))
