"""Join queries."""

from pyspark.sql import functions as F

from clickloom.catalog.registry import query
from clickloom.functions import scalars as S
from clickloom.operators import aggregates as A
from clickloom.operators import joins as J
from clickloom.plans.wide import derive_publish_ts, join_ad_columns, join_document_roles

KNOWN_USERS = "SELECT DISTINCT o_custkey AS uuid FROM orders WHERE o_custkey % 3 = 0"


def known_users(v):
    return v.display_events.where("uuid % 3 = 0").select("uuid")


@query("join_events", "SELECT i.display_id, ad_id, clicked, uuid, document_id, ts, platform, geo_location FROM impressions i JOIN display_events e USING (display_id)")
def _(v):
    return v.impressions.drop("price").join(v.display_events, "display_id")


@query(
    "join_promoted",
    """SELECT i.display_id, i.ad_id, i.clicked, p.document_id AS ad_document_id, p.campaign_id AS ad_campaign_id,
       p.advertiser_id AS ad_advertiser_id FROM impressions i JOIN promoted p ON p.ad_id = i.ad_id""",
)
def _(v):
    return join_ad_columns(v.impressions.drop("price"), v.promoted)


@query("join_docmeta_two_roles", "SELECT display_id, ad_id, document_id, source_id, publisher_id, publish_ts, ad_document_id, ad_source_id, ad_publisher_id, ad_publish_ts FROM wide")
def _(v):
    base = join_ad_columns(v.impressions.select("display_id", "ad_id"), v.promoted.select("ad_id", "document_id"))
    base = base.join(v.display_events.select("display_id", "document_id"), "display_id")
    return join_document_roles(base, derive_publish_ts(v.doc_meta))


@query("join_wide_impression", "SELECT * FROM wide")
def _(v):
    return v.wide


@query(
    "join_left_fill",
    """SELECT e.display_id, e.document_id, coalesce(t.n, 0) AS views FROM display_events e LEFT JOIN
       (SELECT document_id, count(*) AS n FROM page_views GROUP BY 1) t USING (document_id)""",
)
def _(v):
    views = v.page_views.groupBy("document_id").agg(F.count("*").alias("views"))
    return J.join_left_fill(v.display_events.select("display_id", "document_id"), views, "document_id", ["views"])


@query(
    "join_diff_keys",
    """SELECT w.display_id, w.ad_id, w.ad_document_id, t.n AS ad_views FROM wide w LEFT JOIN
       (SELECT document_id, count(*) AS n FROM page_views GROUP BY 1) t ON w.ad_document_id = t.document_id""",
)
def _(v):
    views = v.page_views.groupBy(F.col("document_id").alias("doc")).agg(F.count("*").alias("ad_views"))
    ads = join_ad_columns(v.impressions.select("display_id", "ad_id"), v.promoted.select("ad_id", "document_id"))
    return ads.join(views, F.col("ad_document_id") == F.col("doc"), "left").drop("doc")


@query(
    "join_full_accumulate",
    "SELECT document_id, count(*) AS tot, CAST(sum(CASE WHEN platform = 1 THEN 1 ELSE 0 END) AS BIGINT) AS platform1, min(ts) AS first, max(ts) AS last FROM page_views GROUP BY 1",
)
def _(v):
    def state(df):
        return df.groupBy("document_id").agg(
            F.count("*").alias("tot"), F.count_if(F.col("platform") == 1).alias("platform1"),
            F.min("ts").alias("first"), F.max("ts").alias("last"),
        )

    late = F.col("uuid") % 2 == 0
    return J.accumulate(
        state(v.page_views.where(late)), state(v.page_views.where(~late)), "document_id", ["tot", "platform1"], ["first"], ["last"]
    )


@query(
    "join_null_safe",
    """SELECT a.document_id, a.publish_ts, p.tot FROM doc_meta_derived a JOIN
       (SELECT publish_ts, count(*) AS tot FROM doc_meta_derived GROUP BY 1) p ON a.publish_ts IS NOT DISTINCT FROM p.publish_ts""",
)
def _(v):
    profile = v.doc_meta_derived.groupBy("publish_ts").agg(F.count("*").alias("tot"))
    return J.join_null_safe(v.doc_meta_derived.select("document_id", "publish_ts"), profile, ["publish_ts"])


@query("join_semi_users", f"SELECT * FROM page_views WHERE uuid IN ({KNOWN_USERS})")
def _(v):
    return J.keep_known(v.page_views, known_users(v), "uuid").select(v.page_views.columns)


@query("join_semi_ads", "SELECT * FROM impressions_train WHERE ad_id IN (SELECT ad_id FROM impressions_test)")
def _(v):
    return J.keep_known(v.impressions_train, v.impressions_test, "ad_id")


@query("join_anti_ads", "SELECT * FROM impressions_train WHERE ad_id NOT IN (SELECT ad_id FROM impressions_test)")
def _(v):
    return J.keep_unknown(v.impressions_train, v.impressions_test, "ad_id")


@query(
    "join_integrity_check",
    """SELECT 'display in events' AS relation, count(DISTINCT display_id) AS orphans FROM impressions WHERE display_id NOT IN (SELECT display_id FROM display_events)
       UNION ALL SELECT 'ad in promoted', count(DISTINCT ad_id) FROM impressions WHERE ad_id NOT IN (SELECT ad_id FROM promoted)
       UNION ALL SELECT 'document in meta', count(DISTINCT document_id) FROM display_events WHERE document_id NOT IN (SELECT document_id FROM doc_meta)
       UNION ALL SELECT 'ad document in meta', count(DISTINCT document_id) FROM promoted WHERE document_id NOT IN (SELECT document_id FROM doc_meta)
       UNION ALL SELECT 'document in labels', count(DISTINCT document_id) FROM doc_meta WHERE document_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(v):
    return J.integrity_report([
        ("display in events", v.impressions, "display_id", v.display_events, "display_id"),
        ("ad in promoted", v.impressions, "ad_id", v.promoted, "ad_id"),
        ("document in meta", v.display_events, "document_id", v.doc_meta, "document_id"),
        ("ad document in meta", v.promoted, "document_id", v.doc_meta, "document_id"),
        ("document in labels", v.doc_meta, "document_id", v.table("labels"), "doc_id"),
    ])


@query(
    "join_key_coverage",
    """SELECT common, only_a, only_b, round(common / (common + only_a), 6) AS a_in_b, round(common / (common + only_b), 6) AS b_in_a FROM
       (SELECT count(*) FILTER (a.ad_id IS NOT NULL AND b.ad_id IS NOT NULL) AS common, count(*) FILTER (b.ad_id IS NULL) AS only_a,
        count(*) FILTER (a.ad_id IS NULL) AS only_b FROM (SELECT DISTINCT ad_id FROM impressions_test) a
        FULL JOIN (SELECT DISTINCT ad_id FROM impressions_train) b ON a.ad_id = b.ad_id) t""",
)
def _(v):
    out = J.key_coverage(v.impressions_test, v.impressions_train, "ad_id")
    return out.withColumns({c: F.round(c, 6) for c in ("a_in_b", "b_in_a")})


@query(
    "join_lookup_left",
    "SELECT p.uuid, p.ts, p.document_id, m.source_id, m.publisher_id, m.publish_ts FROM page_views p LEFT JOIN doc_meta_derived m USING (document_id)",
)
def _(v):
    return v.page_views.select("uuid", "ts", "document_id").join(derive_publish_ts(v.doc_meta), "document_id", "left")


@query("join_ids_subset", "SELECT i.* FROM impressions i WHERE display_id IN (SELECT display_id FROM display_events WHERE platform = 3)")
def _(v):
    ids = v.display_events.where("platform = 3").select("display_id")
    return v.impressions.join(ids, "display_id", "left_semi")


@query(
    "join_time_bucket",
    """SELECT CAST(w AS INTEGER) AS width, (SELECT count(DISTINCT e.display_id) FROM display_events e JOIN page_views p
         ON e.uuid = p.uuid AND e.document_id = p.document_id AND floor(e.ts / (w * 86400000.0)) = floor(p.ts / (w * 86400000.0))) AS hits,
       round((SELECT count(DISTINCT e.display_id) FROM display_events e JOIN page_views p
         ON e.uuid = p.uuid AND e.document_id = p.document_id AND floor(e.ts / (w * 86400000.0)) = floor(p.ts / (w * 86400000.0)))
         / (SELECT count(DISTINCT display_id) FROM display_events), 8) AS coverage FROM range(1, 25) r(w)""",
)
def _(v):
    out = J.time_bucket_coverage(
        v.display_events, v.page_views, "display_id", ["uuid", "document_id"], "ts", S.DAY_MS, range(1, 25)
    )
    return out.withColumn("coverage", F.round("coverage", 8))


@query(
    "join_default_prob",
    """SELECT t.display_id, t.ad_id, round(coalesce(r.prob, (SELECT sum(clicked) / (count(*) + 4.0) FROM impressions_train)), 8) AS prob
       FROM impressions_test t LEFT JOIN (SELECT ad_id, sum(clicked) / (count(*) + 4.0) AS prob FROM impressions_train GROUP BY 1) r USING (ad_id)""",
)
def _(v):
    rates = A.smoothed_rate(v.impressions_train, "ad_id", "clicked", reg=4)
    default = A.overall_rate(v.impressions_train, "clicked", reg=4).scalar()
    out = J.with_default_rate(v.impressions_test, rates, "ad_id", "prob", default)
    return out.withColumn("prob", F.round("prob", 8))


