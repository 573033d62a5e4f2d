"""Projection, filter and column-set queries."""

from pyspark.sql import functions as F

from clickloom.catalog.registry import query
from clickloom.functions import columns as C
from clickloom.functions import scalars as S
from clickloom.plans.wide import derive_publish_ts


@query("prj_select", "SELECT uuid, document_id, platform, ts FROM display_events")
def _(v):
    return v.display_events.select("uuid", "document_id", "platform", "ts")


@query(
    "prj_prefix_rename",
    "SELECT ad_id, document_id AS ad_document_id, campaign_id AS ad_campaign_id, advertiser_id AS ad_advertiser_id FROM promoted",
)
def _(v):
    return C.prefix_columns(v.promoted, "ad_", keep=("ad_id",))


@query("prj_rename_map", "SELECT display_id, ad_id AS item, price AS amount, clicked AS label FROM impressions")
def _(v):
    return C.rename(v.impressions, {"ad_id": "item", "price": "amount", "clicked": "label"})


@query("prj_drop_if_exists", "SELECT display_id, ad_id, clicked FROM impressions")
def _(v):
    return C.drop_if_exists(v.impressions, ["price", "docprob", "publish_time"])


@query("prj_regex_columns", "SELECT ad_id, ad_document_id, ad_campaign_id, ad_advertiser_id, ad_source_id, ad_publisher_id, ad_publish_ts, display_id FROM wide")
def _(v):
    return C.select_matching(v.wide, "^ad_", keep=("display_id",))


@query("prj_reorder", "SELECT clicked, display_id, ad_id, price FROM impressions")
def _(v):
    return C.move_first(v.impressions, ["clicked", "display_id"])


@query("prj_drop_by_type", "SELECT display_id, uuid, document_id, ts, platform, hour, day FROM events_derived")
def _(v):
    return C.drop_strings(v.events_derived)


@query(
    "prj_generated_exprs",
    """SELECT l_orderkey, l_linenumber, l_quantity / 10 AS l_quantity_tenth, l_extendedprice / 10 AS l_extendedprice_tenth,
       l_tax / 10 AS l_tax_tenth FROM lineitem""",
)
def _(v):
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    return C.generated(v.table("lineitem"), ["l_orderkey", "l_linenumber"], "{c} / 10", cols, "{c}_tenth")


@query(
    "prj_conditional_update",
    "SELECT document_id, source_id, CASE WHEN publish_time = '' THEN 'unknown' ELSE publish_time END AS publish_time FROM doc_meta",
)
def _(v):
    return C.update_where(v.doc_meta, "publish_time", F.col("publish_time") == "", "unknown").drop("publisher_id")


@query("prj_null_token", "SELECT document_id, nullif(publish_time, '') AS publish_time FROM doc_meta")
def _(v):
    return v.doc_meta.select("document_id", S.null_token("publish_time", "").alias("publish_time"))


@query("prj_fill_zero", "SELECT document_id, source_id, publisher_id, coalesce(publish_ts, 0) AS publish_ts FROM doc_meta_derived")
def _(v):
    return C.fill_zero(v.doc_meta_derived, ["publish_ts"])


@query(
    "prj_label_default",
    """SELECT display_id, ad_id, CAST(clicked AS INTEGER) AS clicked FROM impressions_train
       UNION ALL SELECT display_id, ad_id, CAST(0 AS INTEGER) FROM impressions_test""",
)
def _(v):
    test = C.label_or_zero(v.impressions_test)
    return C.label_or_zero(v.impressions_train.drop("price")).unionByName(test)


@query("flt_equality", "SELECT * FROM events_derived WHERE platform = 2")
def _(v):
    return v.events_derived.where(F.col("platform") == 2)


@query("flt_in_list", "SELECT display_id, country_group, day FROM events_derived WHERE country_group IN ('US', 'GB') AND day IN (3, 5, 8, 13, 700, 701)")
def _(v):
    chosen = F.col("country_group").isin("US", "GB") & F.col("day").isin(3, 5, 8, 13, 700, 701)
    return v.events_derived.where(chosen).select("display_id", "country_group", "day")


@query("flt_range", "SELECT display_id, day, CASE WHEN day < 12 THEN 'early' ELSE 'late' END AS half FROM scores WHERE display_id >= 1000 AND day >= 6")
def _(v):
    kept = v.scores.where((F.col("display_id") >= 1000) & (F.col("day") >= 6))
    return kept.select("display_id", "day", F.when(F.col("day") < 12, "early").otherwise("late").alias("half"))


@query("flt_not_null_key", "SELECT * FROM doc_meta_derived WHERE publish_ts IS NOT NULL")
def _(v):
    return v.doc_meta_derived.dropna(subset=["publish_ts"])


@query("flt_distinct", "SELECT DISTINCT uuid FROM display_events")
def _(v):
    return v.display_events.select("uuid").distinct()


@query(
    "flt_first_per_key",
    """SELECT uuid, display_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ts, display_id) AS rn
       FROM display_events) t WHERE rn = 1""",
)
def _(v):
    first = C.keep_first_per_key(v.display_events, ["uuid"], [F.col("ts"), F.col("display_id")])
    return first.select("uuid", "display_id", "ts")


@query("flt_conj", "SELECT document_id, publish_time FROM doc_meta WHERE publish_time <> '' AND year(CAST(nullif(publish_time, '') AS TIMESTAMP)) > 2000 AND year(CAST(nullif(publish_time, '') AS TIMESTAMP)) < 2017")
def _(v):
    year = F.year(F.try_to_timestamp(S.null_token("publish_time", ""), F.lit("yyyy-MM-dd HH:mm:ss")))
    return v.doc_meta.where((year > 2000) & (year < 2017)).select("document_id", "publish_time")


@query("fea_fill_publish", "SELECT document_id, coalesce(publish_ts, 0) AS publish_ts FROM doc_meta_derived")
def _(v):
    return C.fill_zero(derive_publish_ts(v.doc_meta), ["publish_ts"]).select("document_id", "publish_ts")
