"""Window, order and set queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.catalog.aggregates import FEATURE_RANKS, feature_ranks, type_sql
from clickloom.catalog.registry import query
from clickloom.operators import doctypes as D
from clickloom.operators import ranks as R
from clickloom.operators.aggregates import rank_statistics, smoothed_rate
from clickloom.operators.profiles import gap_to_previous
from clickloom.operators.splits import sample_groups
from clickloom.plans import models as M

RELEVANT = "SELECT display_id, ad_id, prob, CAST(CASE WHEN ad_id % 4 = 0 OR clicked = 1 THEN 1 ELSE 0 END AS INTEGER) AS relevant FROM scores"


def relevant_scores(v):
    """Scores with several relevant ads per display."""
    return v.scores.select(
        "display_id", "ad_id", "prob", F.when((F.col("ad_id") % 4 == 0) | (F.col("clicked") == 1), 1).otherwise(0).alias("relevant")
    )


@query("win_group_size", "SELECT display_id, ad_id, clicked, count(*) OVER (PARTITION BY display_id) AS num_ads FROM impressions")
def _(v):
    return R.group_totals(v.impressions.drop("price"), ["display_id"], {"num_ads": F.count("*")})


@query(
    "win_gap_to_previous",
    """SELECT display_id, uuid, ts, ts - lag(ts) OVER (PARTITION BY uuid ORDER BY ts, display_id) AS gap FROM display_events""",
)
def _(v):
    return gap_to_previous(v.display_events.select("display_id", "uuid", "ts"), ["uuid"], "ts", "display_id")


@query("win_first_last", "SELECT document_id, min(ts) AS first_ts, max(ts) AS last_ts FROM page_views GROUP BY 1")
def _(v):
    return v.page_views.groupBy("document_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_AD = ("ad_document_id", "ad_campaign_id", "ad_advertiser_id", "ad_source_id", "ad_publish_ts")


@query(
    "win_leader_values",
    "SELECT display_id, ad_id, " + ", ".join(f"first_value({c}) OVER w AS clk1_{c}" for c in _AD)
    + " FROM wide JOIN ad_rate USING (ad_id) WINDOW w AS (PARTITION BY display_id ORDER BY prob DESC, ad_id)",
)
def _(v):
    from clickloom.plans.features import leader_columns

    rates = smoothed_rate(v.impressions, "ad_id", "clicked", reg=4).select("ad_id", "prob")
    rows = v.wide.select("display_id", "ad_id", *_AD).join(rates, "ad_id")
    return leader_columns(rows, "display_id", "prob", "ad_id", _AD).select("display_id", "ad_id", *[f"clk1_{c}" for c in _AD])


def topk_sql(k: int, name: str) -> str:
    cells = [
        f"coalesce(round(max(CASE WHEN rn = {i} THEN {s} END), 8), 0) AS {p}{name}_prob_{i}"
        for s, p in (("type_prob", ""), ("ad_type_prob", "ad_")) for i in range(1, k + 1)
    ]
    return f"SELECT document_id, {', '.join(cells)} FROM type_ranks GROUP BY 1"


@query("win_topk_pivot", topk_sql(10, "topic"), **type_sql("topic"))
def _(v):
    typed = D.with_document_rates(v.doc_types("topic"), D.document_click_rates(v.wide))
    out = D.top_type_pivot(D.rated_types(typed), 10, "topic")
    return out.select("document_id", *[F.round(c, 8).alias(c) for c in out.columns if c != "document_id"])


@query("win_rank_in_display", "SELECT display_id, ad_id, row_number() OVER (PARTITION BY display_id ORDER BY prob DESC, ad_id) AS position FROM scores")
def _(v):
    scores = v.scores.select("display_id", "ad_id", "prob")
    return R.rank_in_group(scores, ["display_id"], [F.desc("prob"), F.asc("ad_id")], sizes_from=v.display_ids).drop("prob")


@query(
    "win_running_hits",
    """SELECT display_id, ad_id, position, hits, round(hits / position, 8) AS precision FROM
       (SELECT *, row_number() OVER w AS position, CAST(sum(relevant) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hits FROM relevant_scores
        WINDOW w AS (PARTITION BY display_id ORDER BY prob DESC, ad_id)) t WHERE relevant = 1""",
    relevant_scores=RELEVANT,
)
def _(v):
    sizes = v.display_ids
    placed = R.rank_in_group(relevant_scores(v), ["display_id"], [F.desc("prob"), F.asc("ad_id")], sizes_from=sizes)
    hits = R.rank_in_group(placed.where("relevant = 1"), ["display_id"], [F.asc("position")], "hits", sizes_from=sizes)
    return hits.select("display_id", "ad_id", "position", "hits", F.round(F.col("hits") / F.col("position"), 8).alias("precision"))


@query("win_partition_total", "SELECT display_id, ad_id, round(sum(price) OVER (PARTITION BY display_id), 2) AS total, round(price / sum(price) OVER (PARTITION BY display_id), 6) AS share FROM impressions")
def _(v):
    out = R.group_totals(v.impressions, ["display_id"], {"total": F.sum("price")})
    return out.select("display_id", "ad_id", F.round("total", 2).alias("total"), F.round(F.col("price") / F.col("total"), 6).alias("share"))


@query(
    "win_argmax_argsort",
    """SELECT display_id, CAST(list_position(list(clicked ORDER BY ad_id), max(clicked)) AS INTEGER) AS best,
       list(CAST(i AS INTEGER) ORDER BY prob DESC, i) AS "order" FROM
       (SELECT *, row_number() OVER (PARTITION BY display_id ORDER BY ad_id) AS i FROM scores) t GROUP BY 1""",
)
def _(v):
    rows = F.array_sort(F.collect_list(F.struct("ad_id", "clicked", "prob")))
    lists = v.scores.groupBy("display_id").agg(rows.alias("rows"))
    labels = F.transform("rows", lambda r: r["clicked"])
    indexed = F.transform("rows", lambda r, i: F.struct((-r["prob"]).alias("s"), (i + 1).alias("i")))
    return lists.select(
        "display_id", F.array_position(labels, F.array_max(labels)).cast("int").alias("best"),
        F.transform(F.array_sort(indexed), lambda r: r["i"]).alias("order"),
    )


@query("win_display_share", "SELECT display_id, ad_id, round(1.0 / count(*) OVER (PARTITION BY display_id), 8) AS expected FROM impressions")
def _(v):
    out = R.group_totals(v.impressions.select("display_id", "ad_id"), ["display_id"], {"n": F.count("*")})
    return out.select("display_id", "ad_id", F.round(1 / F.col("n"), 8).alias("expected"))


@query("ord_mixed", "SELECT display_id, ad_id, row_number() OVER (ORDER BY display_id, prob DESC, ad_id) AS position FROM scores")
def _(v):
    rows = v.scores.select("display_id", "ad_id", "prob")
    return R.global_position(rows, [F.asc("display_id"), F.desc("prob"), F.asc("ad_id")]).drop("prob")


@query("ord_nulls_last", "SELECT document_id, publish_ts, row_number() OVER (ORDER BY publish_ts ASC NULLS LAST, document_id) AS position FROM doc_meta_derived")
def _(v):
    rows = v.doc_meta_derived.select("document_id", "publish_ts")
    return R.global_position(rows, [F.asc_nulls_last("publish_ts"), F.asc("document_id")])


@query("ord_top_n_values", "SELECT geo_location, count(*) AS n FROM display_events GROUP BY 1 ORDER BY n DESC, geo_location LIMIT 10")
def _(v):
    counts = v.display_events.groupBy("geo_location").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "geo_location").limit(10)


@query("ord_limit_head", "SELECT display_id, ad_id, price FROM impressions ORDER BY price DESC, display_id, ad_id LIMIT 25")
def _(v):
    return v.impressions.orderBy(F.desc("price"), "display_id", "ad_id").limit(25).drop("clicked")


@query("ord_topk_features", "SELECT feature, max(rank) AS mx FROM feature_ranks GROUP BY 1 ORDER BY mx, feature LIMIT 8", feature_ranks=FEATURE_RANKS)
def _(v):
    stats = rank_statistics(feature_ranks(v), "feature", "rank")
    return stats.orderBy("mx", "feature").limit(8).select("feature", F.col("mx").cast("bigint").alias("mx"))


@query(
    "ord_restore",
    """SELECT display_id, ad_id, round(CASE WHEN n BETWEEN 2 AND 12 THEN prob / total + 1.0 / n ELSE prob END, 8) AS prob, row_number() OVER (ORDER BY display_id, ad_id) AS position
       FROM (SELECT *, count(*) OVER (PARTITION BY display_id) AS n, greatest(sum(prob) OVER (PARTITION BY display_id), 1) AS total FROM scores) t""",
)
def _(v):
    """Each cohort's function scores the displays of its size as a whole; the rows come back in the order of their keys."""

    def of_size(n):
        import numpy as np

        return lambda x: x[:, :, 0] / np.maximum(x[:, :, 0].sum(axis=1, keepdims=True), 1) + 1 / n

    functions = {n: of_size(n) for n in M.COHORTS}
    scored = M.score_sequences(v.scores, "display_id", "ad_id", ["prob"], functions, lambda x: x[:, :, 0])
    return R.global_position(scored.withColumn("prob", F.round("prob", 8)), [F.asc("display_id"), F.asc("ad_id")])


@query("set_union_all", "SELECT display_id, ad_id, clicked FROM impressions")
def _(v):
    rows = v.impressions.drop("price")
    return reduce(DataFrame.unionByName, [rows.where(F.col("display_id") % 4 == b) for b in range(4)])


@query("set_union_train_valid", "SELECT display_id, ad_id, part FROM split_impressions")
def _(v):
    rows = v.split_impressions.select("display_id", "ad_id", "part")
    return rows.where("part = 'train'").unionByName(rows.where("part = 'valid'"))


@query(
    "set_complement",
    """SELECT display_id FROM (SELECT display_id, row_number() OVER (ORDER BY md5('1:' || CAST(display_id AS VARCHAR)), display_id) AS rn,
       count(*) OVER () AS n FROM (SELECT DISTINCT display_id FROM impressions) d) t WHERE rn > floor(0.25 * n)""",
)
def _(v):
    ids = v.impressions.select("display_id").distinct()
    return ids.join(sample_groups(ids, "display_id", 0.25, seed=1), "display_id", "left_anti")


@query("set_intersect_keys", "SELECT ad_id FROM impressions_train INTERSECT SELECT ad_id FROM impressions_test")
def _(v):
    return v.impressions_train.select("ad_id").intersect(v.impressions_test.select("ad_id"))


