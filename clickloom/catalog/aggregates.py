"""Aggregation queries."""

from pyspark.sql import functions as F

from clickloom.catalog.registry import query
from clickloom.functions import scalars as S
from clickloom.operators import aggregates as A
from clickloom.operators import doctypes as D
from clickloom.operators import profiles as P
from clickloom.operators.splits import random_blocks, train_valid
from clickloom.plans.baseline import default_rate
from clickloom.plans.wide import PROFILE_KEYS
from clickloom.views import SPLIT_SEED

from clickloom.catalog.joins import KNOWN_USERS, known_users

WEEK2 = float(7 * S.DAY_MS) ** 2


def readable(df, *, hours=("ts_avg", "gap_avg"), weeks2=("ts_var", "gap_var")):
    """Means in hours and variances in square weeks, rounded."""
    cols = {c: F.round(F.col(c) / S.HOUR_MS, 4) for c in hours if c in df.columns}
    cols |= {c: F.round(F.col(c) / WEEK2, 4) for c in weeks2 if c in df.columns}
    if "prob" in df.columns:
        cols["prob"] = F.round("prob", 6)
    return df.withColumns(cols)


def profile_sql(source: str, by: str, value: str = "ts") -> str:
    """Time and gap statistics in SQL over ``source`` with key columns ``by``."""
    return f"""SELECT {by}, tot, clicks, round(clicks / tot, 6) AS prob, ts_min, ts_max, ts_avg, ts_var,
      CAST(CASE WHEN tot = 1 THEN 0 ELSE g_min END AS BIGINT) AS gap_min, CAST(CASE WHEN tot = 1 THEN 0 ELSE g_max END AS BIGINT) AS gap_max,
      CASE WHEN tot = 1 THEN 0 ELSE round(g_avg, 4) END AS gap_avg, CASE WHEN tot = 1 THEN 0 ELSE round(g_var, 4) END AS gap_var FROM
      (SELECT {by}, count(*) AS tot, CAST(sum(clicked) AS BIGINT) AS clicks, min({value}) AS ts_min, max({value}) AS ts_max,
        round(avg(CAST({value} AS DOUBLE)) / 3600000, 4) AS ts_avg, round(var_samp({value} / 604800000.0), 4) AS ts_var, min(d) AS g_min, max(d) AS g_max,
        avg(CAST(d AS DOUBLE)) / 3600000 AS g_avg, var_samp(d / 604800000.0) AS g_var FROM
        (SELECT *, {value} - lag({value}) OVER (PARTITION BY {by} ORDER BY {value}) AS d FROM {source}) t1 GROUP BY {by}) t2"""


STACKED = " UNION ALL ".join(
    f"SELECT '{k}' AS key_name, CAST({k} AS VARCHAR) AS key_value, ts, clicked FROM wide" for k in PROFILE_KEYS
)
VIEW_KEYS = ("uuid", "document_id", "source_id", "publisher_id", "publish_ts")
_VIEWS = """SELECT p.*, CASE split_part(geo_location, '>', 1) WHEN 'US' THEN 1 WHEN 'CA' THEN 2 WHEN 'GB' THEN 3 ELSE 4 END AS country_id,
            m.source_id, m.publisher_id, m.publish_ts FROM page_views p LEFT JOIN doc_meta_derived m USING (document_id)"""
VIEW_STACKED = " UNION ALL ".join(
    f"SELECT '{k}' AS key_name, CAST({k} AS VARCHAR) AS key_value, ts, country_id, platform, traffic_source FROM views_keyed WHERE {k} IS NOT NULL"
    for k in VIEW_KEYS
)
_COUNT = ", ".join(
    f"CAST(count(*) FILTER ({test}) AS BIGINT) AS {name}"
    for name, test in zip(
        P.VIEW_COUNTERS,
        [f"country_id = {i}" for i in (1, 2, 3, 4)] + [f"platform = {i}" for i in (1, 2, 3)] + [f"traffic_source = {i}" for i in (1, 2, 3)],
        strict=True,
    )
)
_CLOCK = ", ".join(
    f"CAST(1 + CAST(floor(ts_{s}_raw / 3600000.0) AS BIGINT) % 24 AS INTEGER) AS hour_{s}, CAST(1 + floor(ts_{s}_raw / 86400000.0) AS INTEGER) AS day_{s}"
    for s in ("min", "max", "avg")
)
VIEW_PROFILE = f"""SELECT key_name, key_value, tot, ts_min_raw AS ts_min, ts_max_raw AS ts_max, round(ts_avg_raw / 3600000, 4) AS ts_avg, ts_var,
      CAST(CASE WHEN tot = 1 THEN 0 ELSE g_min END AS BIGINT) AS gap_min, CAST(CASE WHEN tot = 1 THEN 0 ELSE g_max END AS BIGINT) AS gap_max,
      CASE WHEN tot = 1 THEN 0 ELSE round(g_avg, 4) END AS gap_avg, CASE WHEN tot = 1 THEN 0 ELSE round(g_var, 4) END AS gap_var,
      {", ".join(P.VIEW_COUNTERS)}, {_CLOCK} FROM
      (SELECT key_name, key_value, count(*) AS tot, min(ts) AS ts_min_raw, max(ts) AS ts_max_raw, avg(CAST(ts AS DOUBLE)) AS ts_avg_raw,
        round(var_samp(ts / 604800000.0), 4) AS ts_var, min(d) AS g_min, max(d) AS g_max, avg(CAST(d AS DOUBLE)) / 3600000 AS g_avg,
        var_samp(d / 604800000.0) AS g_var, {_COUNT} FROM
        (SELECT *, ts - lag(ts) OVER (PARTITION BY key_name, key_value ORDER BY ts) AS d FROM views_stacked) t1 GROUP BY 1, 2) t2"""
VIEW_CTES = {"views_keyed": _VIEWS, "views_stacked": VIEW_STACKED}


@query("agg_group_size_hist", "SELECT size, count(*) AS groups, CAST(sum(size) AS BIGINT) AS rows FROM (SELECT display_id, count(*) AS size FROM impressions GROUP BY 1) t GROUP BY 1")
def _(v):
    return A.group_size_histogram(v.impressions, "display_id")


@query(
    "agg_key_profile",
    """SELECT uuid, CAST(sum(clicked) AS BIGINT) AS clicks, count(*) AS tot, min(ts) AS ts_min, max(ts) AS ts_max,
       round(avg(CAST(ts AS DOUBLE)) / 3600000, 4) AS ts_avg, round(var_samp(ts / 604800000.0), 4) AS ts_var FROM wide GROUP BY 1""",
)
def _(v):
    out = P.click_profile(v.wide, ["uuid"], sample_by="display_id").select("uuid", "clicks", "tot", *P.TIME_STATS)
    return readable(out)


@query(
    "agg_key_gaps",
    """SELECT uuid, CASE WHEN count(*) = 1 THEN 0 ELSE min(d) END AS gap_min, CASE WHEN count(*) = 1 THEN 0 ELSE max(d) END AS gap_max,
       CASE WHEN count(*) = 1 THEN 0 ELSE round(avg(CAST(d AS DOUBLE)) / 3600000, 4) END AS gap_avg,
       CASE WHEN count(*) = 1 THEN 0 ELSE round(var_samp(d / 604800000.0), 4) END AS gap_var
       FROM (SELECT uuid, ts - lag(ts) OVER (PARTITION BY uuid ORDER BY ts) AS d FROM page_views) t GROUP BY 1""",
)
def _(v):
    out = P.time_profile(v.page_views, ["uuid"], "ts", {}, sample_by="ts").select("uuid", *P.GAP_STATS)
    return readable(out)


@query("agg_key_profile_all", profile_sql("stacked", "key_name, key_value"), stacked=STACKED)
def _(v):
    return readable(P.click_profiles(v.wide, PROFILE_KEYS, sample_by="display_id"))


@query(
    "agg_key_profile_train_test",
    f"""SELECT p.* EXCLUDE (clicks, prob), coalesce(r.train_tot, 0) AS train_tot, coalesce(r.clicks, 0) AS clicks, round(coalesce(r.clicks / r.train_tot, 0), 6) AS prob
        FROM ({profile_sql("stacked_parts", "key_name, key_value")}) p LEFT JOIN
        (SELECT key_name, key_value, count(*) AS train_tot, CAST(sum(clicked) AS BIGINT) AS clicks FROM stacked_parts WHERE part = 'train' GROUP BY 1, 2) r
        ON p.key_name = r.key_name AND p.key_value IS NOT DISTINCT FROM r.key_value""",
    wide_parts="SELECT wide.*, part FROM wide JOIN split_ids USING (display_id)",
    stacked_parts=STACKED.replace("clicked FROM wide", "clicked, part FROM wide_parts"),
)
def _(v):
    rows = train_valid(v.wide, "display_id", 0.8, SPLIT_SEED, ids=v.display_ids)
    return readable(P.train_test_profiles(rows, None, PROFILE_KEYS, sample_by="display_id", is_train=F.col("part") == "train"))


@query("agg_click_rate", "SELECT ad_id, CAST(sum(clicked) AS BIGINT) AS clicks, count(*) AS tot, round(sum(clicked) / count(*), 8) AS prob FROM impressions_train GROUP BY 1")
def _(v):
    return A.smoothed_rate(v.impressions_train, "ad_id", "clicked").withColumn("prob", F.round("prob", 8))


@query(
    "agg_rate_train_tot_all",
    """SELECT ad_id, CAST(coalesce(sum(clicked), 0) AS BIGINT) AS clicks, count(*) AS tot, round(coalesce(sum(clicked) / nullif(count(clicked), 0), 0), 8) AS prob
       FROM (SELECT ad_id, clicked FROM impressions_train UNION ALL SELECT ad_id, NULL FROM impressions_test) t GROUP BY 1""",
)
def _(v):
    out = A.train_rate_all_tot(v.impressions_train, v.impressions_test, "ad_id")
    return out.withColumn("prob", F.round("prob", 8))


_REGS = (0, 3, 4, 5, 6)


@query(
    "agg_smoothed_rate",
    "SELECT ad_id, " + ", ".join(f"round(sum(clicked) / (count(*) + {r}.0), 8) AS prob_reg{r}" for r in _REGS) + " FROM impressions GROUP BY 1",
)
def _(v):
    rates = [F.round(F.try_divide(F.sum("clicked").cast("double"), F.count("*") + F.lit(float(r))), 8).alias(f"prob_reg{r}") for r in _REGS]
    return v.impressions.groupBy("ad_id").agg(*rates)


@query(
    "agg_global_rate",
    "SELECT CAST(k AS INTEGER) AS k, CAST(reg AS INTEGER) AS reg, round(r, 8) AS rate FROM (" + " UNION ALL ".join(
        f"SELECT {k} AS k, {reg} AS reg, sum(clicked) / nullif(count(*) + {reg}.0, 0) AS r FROM impressions_train {where}"
        for k, where in ((1, "WHERE ad_id IN (SELECT ad_id FROM impressions_test)"), (2, "WHERE ad_id NOT IN (SELECT ad_id FROM impressions_test)"), (3, ""))
        for reg in (0, 4)
    ) + ") t",
)
def _(v):
    out = None
    for k in (1, 2, 3):
        for reg in (0, 4):
            row = default_rate(v.impressions_train, v.impressions_test, k, reg).select(
                F.lit(k).alias("k"), F.lit(reg).alias("reg"), F.round("rate", 8).alias("rate")
            )
            out = row if out is None else out.unionByName(row)
    return out


@query("agg_conditional_counts", f"SELECT document_id, {_COUNT} FROM views_keyed GROUP BY 1", views_keyed=_VIEWS)
def _(v):
    keyed = P.with_document_keys(v.page_views, v.doc_meta_derived)
    return keyed.groupBy("document_id").agg(*[F.sum(e).alias(n) for n, e in P.view_counters().items()])


@query("agg_pageview_profile", VIEW_PROFILE, **VIEW_CTES)
def _(v):
    return readable(P.view_profiles(P.with_document_keys(v.page_views, v.doc_meta_derived), VIEW_KEYS))


@query(
    "agg_partial_final",
    """SELECT document_id, count(*) AS tot, CAST(sum(clicked) AS BIGINT) AS clicks, min(ts) AS ts_min, max(ts) AS ts_max,
       round(avg(CAST(ts AS DOUBLE)) / 3600000, 4) AS ts_avg, round(var_samp(ts / 604800000.0), 4) AS ts_var FROM wide GROUP BY 1""",
)
def _(v):
    blocks = random_blocks(v.wide, "display_id", 7)
    return readable(P.merge_moments(P.batch_moments(blocks, ["document_id"], "block", "ts", "clicked"), ["document_id"]))


RATES_SQL = """SELECT document_id, coalesce(p, 0) AS docprob, coalesce(a, 0) AS ad_docprob FROM
  (SELECT document_id, avg(clicked) AS p FROM wide GROUP BY 1) x FULL JOIN
  (SELECT ad_document_id AS document_id, avg(clicked) AS a FROM wide GROUP BY 1) y USING (document_id)"""


def type_sql(kind: str) -> dict[str, str]:
    """Subqueries of the type roll-up for one table of types."""
    return {
        "doc_rates": RATES_SQL,
        "type_rows": f"""SELECT t.document_id, type_id, confidence_level, coalesce(docprob, 0) AS docprob, coalesce(ad_docprob, 0) AS ad_docprob
            FROM types_{kind} t LEFT JOIN doc_rates USING (document_id)""",
        "type_rates": """SELECT type_id, sum(docprob * confidence_level) / count(*) AS type_prob,
            sum(ad_docprob * confidence_level) / count(*) AS ad_type_prob FROM type_rows GROUP BY 1""",
        "doc_scores": """SELECT document_id, sum(type_prob * confidence_level) AS types_prob, sum(ad_type_prob * confidence_level) AS ad_types_prob
            FROM type_rows JOIN type_rates USING (type_id) GROUP BY 1""",
        "type_ranks": """SELECT document_id, type_prob, ad_type_prob, row_number() OVER (PARTITION BY document_id
            ORDER BY confidence_level DESC, type_id) AS rn FROM type_rows JOIN type_rates USING (type_id)""",
    }


@query("agg_topic_weighted_rate", "SELECT type_id, round(type_prob, 8) AS type_prob, round(ad_type_prob, 8) AS ad_type_prob FROM type_rates", **type_sql("topic"))
def _(v):
    rates = D.document_click_rates(v.wide)
    out = D.type_rates(D.with_document_rates(v.doc_types("topic"), rates))
    return out.select("type_id", F.round("type_prob", 8).alias("type_prob"), F.round("ad_type_prob", 8).alias("ad_type_prob"))


@query("agg_doc_weighted_score", "SELECT document_id, round(types_prob, 8) AS types_prob, round(ad_types_prob, 8) AS ad_types_prob FROM doc_scores", **type_sql("topic"))
def _(v):
    typed = D.with_document_rates(v.doc_types("topic"), D.document_click_rates(v.wide))
    out = D.document_scores(D.rated_types(typed))
    return out.select("document_id", F.round("types_prob", 8).alias("types_prob"), F.round("ad_types_prob", 8).alias("ad_types_prob"))


@query("agg_doc_click_rates", "SELECT document_id, round(docprob, 8) AS docprob, round(ad_docprob, 8) AS ad_docprob FROM doc_rates", doc_rates=RATES_SQL)
def _(v):
    out = D.document_click_rates(v.wide)
    return out.select("document_id", F.round("docprob", 8).alias("docprob"), F.round("ad_docprob", 8).alias("ad_docprob"))


@query(
    "agg_types_per_doc",
    """SELECT role, max(n) AS most, min(n) AS least, round(avg(n), 6) AS mean FROM (
         SELECT 'all' AS role, n FROM sizes UNION ALL
         SELECT 'page', n FROM sizes WHERE document_id IN (SELECT document_id FROM wide) UNION ALL
         SELECT 'ad', n FROM sizes WHERE document_id IN (SELECT ad_document_id FROM wide)) t GROUP BY 1""",
    sizes="SELECT document_id, count(*) AS n FROM types_topic GROUP BY 1",
)
def _(v):
    out = D.types_per_document(v.doc_types("topic"), v.wide)
    return out.withColumn("mean", F.round("mean", 6))


@query(
    "agg_distinct_counts",
    """SELECT part, count(DISTINCT display_id) AS display_id, count(DISTINCT ad_id) AS ad_id, count(DISTINCT price) AS price, count(DISTINCT clicked) AS clicked FROM (
       SELECT * FROM split_impressions UNION ALL SELECT display_id, ad_id, price, clicked, 'whole' FROM impressions) t GROUP BY 1""",
)
def _(v):
    both = v.split_impressions.unionByName(v.impressions.withColumn("part", F.lit("whole")))
    return A.distinct_counts(both, ["display_id", "ad_id", "price", "clicked"], by=["part"])


_SUMMARY = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "publish_ts")


@query(
    "agg_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median,
        round(quantile_cont(x, 0.75), 6) AS q3, round(avg(x), 4) AS mean, round(max(x), 6) AS max, CAST(count(*) - count(x) AS BIGINT) AS nulls
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {t}) t""" for c, t in (("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"), ("l_discount", "lineitem"), ("l_tax", "lineitem"), ("ps", "days"))
    ),
    days=f"SELECT publish_ts / {S.DAY_MS} AS ps FROM doc_meta_derived",
)
def _(v):
    lines = A.numeric_summary(v.table("lineitem"), list(_SUMMARY[:4]))
    days = A.numeric_summary(v.doc_meta_derived.select((F.col("publish_ts") / S.DAY_MS).alias("ps")), ["ps"])
    out = lines.unionByName(days)
    return out.withColumns({c: F.round(c, 4 if c == "mean" else 6) for c in ("min", "q1", "median", "q3", "mean", "max")})


@query("agg_frequency_table", "SELECT part, country_group, count(*) AS n FROM split_impressions JOIN events_derived USING (display_id) GROUP BY 1, 2")
def _(v):
    joined = v.split_impressions.select("display_id", "part").join(v.events_derived.select("display_id", "country_group"), "display_id")
    return A.frequency_table(joined, "country_group", "part")


@query("agg_crosstab", "SELECT country_group, " + ", ".join(f"count(*) FILTER (platform = {i}) AS platform_{i}" for i in (1, 2, 3)) + " FROM wide GROUP BY 1")
def _(v):
    return A.crosstab(v.wide, "country_group", "platform", [1, 2, 3])


@query("agg_class_balance", "SELECT CAST(sum(clicked) AS BIGINT) AS positives, CAST(sum(1 - clicked) AS BIGINT) AS negatives, round(sum(1 - clicked) / sum(clicked), 6) AS ratio FROM impressions")
def _(v):
    return A.class_balance(v.impressions, "clicked").withColumn("ratio", F.round("ratio", 6))


_CORR = ("hour", "day", "platform", "document_id", "ad_document_id", "publish_ts", "ts")


@query("agg_correlation", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(corr(CAST({c} AS DOUBLE), clicked), 5) AS corr FROM wide""" for c in _CORR[1:])
       + " UNION ALL SELECT 'hour', NULL UNION ALL SELECT 'price', round(corr(price, clicked), 5) FROM impressions")
def _(v):
    wide = A.label_correlations(v.wide, "clicked", _CORR)
    price = A.label_correlations(v.impressions, "clicked", ["price"])
    return wide.unionByName(price).withColumn("corr", F.round("corr", 5))


@query(
    "agg_woe_iv",
    """SELECT level, good, bad, round(gs, 8) AS good_share, round(bs, 8) AS bad_share, round(CASE WHEN gs > 0 AND bs > 0 THEN ln(gs / bs) END, 6) AS woe,
       round((gs - bs) * CASE WHEN gs > 0 AND bs > 0 THEN ln(gs / bs) END, 8) AS iv FROM
       (SELECT ad_advertiser_id AS level, CAST(sum(clicked) AS BIGINT) AS good, CAST(sum(1 - clicked) AS BIGINT) AS bad,
        sum(clicked) / (SELECT sum(clicked) FROM wide) AS gs, sum(1 - clicked) / (SELECT sum(1 - clicked) FROM wide) AS bs FROM wide GROUP BY 1) t""",
)
def _(v):
    out = A.woe_iv(v.wide, "ad_advertiser_id", "clicked")
    return out.withColumns({"good_share": F.round("good_share", 8), "bad_share": F.round("bad_share", 8), "woe": F.round("woe", 6), "iv": F.round("iv", 8)})


@query(
    "agg_chi2_levels",
    """WITH c AS (SELECT ad_advertiser_id AS level, CAST(sum(clicked) AS BIGINT) AS good, CAST(sum(1 - clicked) AS BIGINT) AS bad,
         (SELECT CAST(sum(clicked) AS DOUBLE) FROM wide) AS g, (SELECT CAST(sum(1 - clicked) AS DOUBLE) FROM wide) AS b FROM wide GROUP BY 1),
       e AS (SELECT *, (good + bad) * g / (g + b) AS e1, (good + bad) * b / (g + b) AS e2, (g + b - good - bad) * g / (g + b) AS e3, (g + b - good - bad) * b / (g + b) AS e4 FROM c),
       y AS (SELECT *, least(0.5, abs(good - e1), abs(bad - e2), abs(g - good - e3), abs(b - bad - e4)) AS k FROM e),
       x AS (SELECT *, (abs(good - e1) - k) ** 2 / e1 + (abs(bad - e2) - k) ** 2 / e2 + (abs(g - good - e3) - k) ** 2 / e3 + (abs(b - bad - e4) - k) ** 2 / e4 AS chi2 FROM y)
       SELECT level, good, bad, round(chi2, 6) AS chi2, chi2 > 3.841459 AS significant, round(100.0 * good / (good + bad), 6) AS rate FROM x""",
)
def _(v):
    out = A.chi2_levels(v.wide, "ad_advertiser_id", "clicked")
    return out.withColumns({"chi2": F.round("chi2", 6), "rate": F.round("rate", 6)})


@query(
    "agg_density_2d",
    """SELECT platform, CAST(floor((display_id - lo) * 20 / CAST(hi - lo + 1 AS DOUBLE)) + 1 AS INTEGER) AS bin, count(*) AS n
       FROM display_events, (SELECT min(display_id) AS lo, max(display_id) AS hi FROM display_events) r GROUP BY 1, 2""",
)
def _(v):
    low, high = v.display_events.agg(F.min("display_id"), F.max("display_id")).first()
    return A.density_2d(v.display_events, "platform", "display_id", low, high, 20)


FEATURE_RANKS = """SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY gain DESC, feature) AS rank FROM
  (SELECT country_group AS model, ad_advertiser_id AS feature, round(avg(clicked), 10) AS gain FROM wide GROUP BY 1, 2) t"""


def feature_ranks(v):
    """One ranking of the advertisers per country group, standing in for the feature rankings of several models."""
    from pyspark.sql import Window as W

    gains = v.wide.groupBy(F.col("country_group").alias("model"), F.col("ad_advertiser_id").alias("feature")).agg(
        F.round(F.avg("clicked"), 10).alias("gain")
    )
    # At most one row per (model, feature): a few hundred rows.
    rank = F.row_number().over(W.partitionBy("model").orderBy(F.desc("gain"), "feature"))
    return gains.select("model", "feature", rank.alias("rank"))


@query(
    "agg_feature_rank_stats",
    "SELECT feature, CAST(max(rank) AS INTEGER) AS mx, CAST(min(rank) AS INTEGER) AS mn, round(avg(rank), 6) AS av, round(stddev_samp(rank), 6) AS sd, count(*) AS cnt FROM feature_ranks GROUP BY 1",
    feature_ranks=FEATURE_RANKS,
)
def _(v):
    out = A.rank_statistics(feature_ranks(v), "feature", "rank")
    return out.withColumns({"av": F.round("av", 6), "sd": F.round("sd", 6)})


@query("agg_row_mean", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 6) AS mean FROM lineitem")
def _(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", F.round(A.row_mean(["l_quantity", "l_discount", "l_tax"]), 6).alias("mean"))


@query("agg_word_count", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) t WHERE word <> '' GROUP BY 1")
def _(v):
    return A.word_counts(v.table("documents"), "text")


@query(
    "agg_reduction_ratio",
    f"SELECT count(*) AS rows_read, count(*) FILTER (uuid IN ({KNOWN_USERS})) AS rows_kept, round(count(*) FILTER (uuid IN ({KNOWN_USERS})) / count(*), 8) AS ratio FROM page_views",
)
def _(v):
    known = known_users(v).distinct().withColumn("_known", F.lit(1))
    out = v.page_views.select("uuid").join(known, "uuid", "left").agg(F.count("*").alias("rows_read"), F.count("_known").alias("rows_kept"))
    return out.withColumn("ratio", F.round(F.try_divide("rows_kept", "rows_read"), 8))


