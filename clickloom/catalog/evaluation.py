"""Ranking evaluation and baseline queries."""

from pyspark.sql import functions as F

from clickloom.catalog.registry import query
from clickloom.catalog.windows import RELEVANT, relevant_scores
from clickloom.plans import baseline as B
from clickloom.plans import ranking as K

POSITIONS = """SELECT *, row_number() OVER (PARTITION BY display_id ORDER BY prob DESC, ad_id) AS position,
  count(*) OVER (PARTITION BY display_id) AS n FROM scores"""


# The ``impressions`` view clicks the dearest ad of a display, so ``one_click`` holds by construction.


def rounded(df, *columns, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("ev_ap_single", "SELECT round(avg(1.0 / position), 8) AS map, count(*) AS clicks FROM positions WHERE clicked = 1", positions=POSITIONS)
def _(v):
    return rounded(K.map_single(v.scores, one_click=True), "map")


def map_k_sql(k: int, label: str, source: str) -> str:
    return f"""WITH r AS (SELECT *, row_number() OVER w AS position, sum({label}) OVER (w ROWS UNBOUNDED PRECEDING) AS hits,
        sum({label}) OVER (PARTITION BY display_id) AS total FROM {source} WINDOW w AS (PARTITION BY display_id ORDER BY prob DESC, ad_id)),
      a AS (SELECT display_id, sum(CASE WHEN {label} = 1 AND position <= {k} THEN hits / position ELSE 0 END) / least(max(total), {k}) AS ap
        FROM r WHERE total > 0 GROUP BY 1)
      SELECT round(avg(ap), 8) AS map, count(*) AS groups FROM a"""


@query("ev_map_at_k", map_k_sql(3, "relevant", "relevant_scores"), relevant_scores=RELEVANT)
def _(v):
    return rounded(K.map_at_k(relevant_scores(v), 3, label="relevant"), "map")


@query(
    "ev_apk_dedupe",
    """WITH p AS (SELECT l_orderkey AS display_id, l_partkey % 5 AS item, l_returnflag, row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) AS position FROM lineitem),
       rel AS (SELECT DISTINCT display_id, item FROM p WHERE l_returnflag = 'R'),
       f AS (SELECT display_id, item, min(position) AS position FROM p WHERE position <= 4 GROUP BY 1, 2),
       h AS (SELECT f.*, row_number() OVER (PARTITION BY display_id ORDER BY position) AS hits FROM f SEMI JOIN rel USING (display_id, item)),
       g AS (SELECT display_id, sum(hits / position) AS gain FROM h GROUP BY 1),
       n AS (SELECT display_id, count(*) AS n FROM rel GROUP BY 1)
       SELECT d.display_id, round(coalesce(gain / least(n, 4), 0), 8) AS ap FROM (SELECT DISTINCT display_id FROM p) d
       LEFT JOIN g USING (display_id) LEFT JOIN n USING (display_id)""",
)
def _(v):
    lines = v.table("lineitem").withColumnRenamed("l_orderkey", "display_id").withColumn("item", F.col("l_partkey") % 5)
    relevant = lines.where("l_returnflag = 'R'").select("display_id", "item").distinct()
    order = [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_linenumber"), F.asc("l_suppkey")]
    return rounded(K.average_precision_with_repeats(lines, relevant, 4, "display_id", "item", order), "ap")


def ranges_sql(ranges, source="positions", by=""):
    keys = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"""SELECT {keys}CAST({lo} AS INTEGER) AS day_from, CAST({hi} AS INTEGER) AS day_to, round(coalesce(avg(CASE WHEN day BETWEEN {lo} AND {hi} THEN 1.0 / position END), 0), 8) AS map12
            FROM {source} WHERE clicked = 1 {f'GROUP BY {by}' if by else ''}""" for lo, hi in ranges
    )


@query("ev_map_by_ranges", ranges_sql(B.TRAINING_DAY_RANGES), positions=POSITIONS)
def _(v):
    return rounded(K.map_by_ranges(v.scores, B.TRAINING_DAY_RANGES, one_click=True), "map12")


@query("ev_map12", map_k_sql(12, "clicked", "scores"))
def _(v):
    return rounded(K.map_at_k(v.scores, 12), "map")


@query(
    "ev_improvement",
    """SELECT n AS num_ads, round(m, 8) AS map12, round(p, 8) AS chance, round(100 * (m - p) * (1 - p), 6) AS gain,
       round(100 * (m - p) / nullif(1 - p, 0), 6) AS gain_norm FROM (SELECT n, avg(1.0 / position) AS m, 1.0 / n AS p FROM positions WHERE clicked = 1 GROUP BY 1) t""",
    positions=POSITIONS,
)
def _(v):
    return rounded(rounded(K.improvement_by_size(v.scores, one_click=True), "map12", "chance"), "gain", "gain_norm", digits=6)


@query(
    "ev_log_loss",
    """SELECT round(loss, 8) AS log_loss, round(1 - loss, 8) AS score FROM (SELECT avg(-(clicked * ln(p) + (1 - clicked) * ln(1 - p))) AS loss
       FROM (SELECT clicked, least(greatest(prob, 1e-15), 1 - 1e-15) AS p FROM scores) t) u""",
)
def _(v):
    return rounded(K.log_loss(v.scores), "log_loss", "score")


@query(
    "ev_sequence_map",
    """WITH i AS (SELECT *, row_number() OVER (PARTITION BY display_id ORDER BY ad_id) AS i FROM scores),
       r AS (SELECT *, row_number() OVER (PARTITION BY display_id ORDER BY prob DESC, i DESC) AS position,
             row_number() OVER (PARTITION BY display_id ORDER BY clicked DESC, i) AS first_label FROM i)
       SELECT round(avg(1.0 / position), 8) AS map, count(*) AS sequences FROM r WHERE first_label = 1""",
)
def _(v):
    rows = F.array_sort(F.collect_list(F.struct("ad_id", "clicked", "prob")))
    seqs = v.scores.groupBy("display_id").agg(rows.alias("rows")).select(
        F.transform("rows", lambda r: r["clicked"]).alias("labels"), F.transform("rows", lambda r: r["prob"]).alias("scores")
    )
    position = K.sequence_positions(seqs, "labels", "scores")
    return rounded(seqs.agg(F.avg(1 / position).alias("map"), F.count("*").alias("sequences")), "map")


@query("ev_confusion", "SELECT clicked, CAST(CASE WHEN prob > 0.25 THEN 1 ELSE 0 END AS INTEGER) AS predicted, count(*) AS n FROM scores GROUP BY 1, 2")
def _(v):
    return K.confusion(v.scores, 0.25)


@query("ev_accuracy", "SELECT round(avg(CASE WHEN (prob > 0.25) = (clicked = 1) THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM scores")
def _(v):
    return rounded(K.accuracy(v.scores, 0.25), "accuracy")


@query(
    "ev_global_ap",
    """SELECT round(avg(hits / rn), 8) AS ap, count(*) AS positives FROM (SELECT clicked, row_number() OVER w AS rn,
       sum(clicked) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM scores WINDOW w AS (ORDER BY prob DESC, display_id, ad_id)) t WHERE clicked = 1""",
)
def _(v):
    return rounded(K.global_average_precision(v.scores), "ap")


_KS, _RS = (1, 2, 3), (0, 3, 4, 5, 6)
_DEFAULTS = " UNION ALL ".join(
    f"SELECT {k} AS k, {r} AS reg, sum(clicked) / nullif(count(*) + {r}.0, 0) AS d FROM impressions_train {w}"
    for k, w in ((1, "WHERE ad_id IN (SELECT ad_id FROM impressions_test)"), (2, "WHERE ad_id NOT IN (SELECT ad_id FROM impressions_test)"), (3, ""))
    for r in _RS
)
VALID = """SELECT i.display_id, i.ad_id, i.clicked, s.day FROM split_impressions i JOIN scores s USING (display_id, ad_id) WHERE part = 'valid'"""
GRID = {
    "valid_rows": VALID,
    "defaults": _DEFAULTS,
    "ad_sums": "SELECT ad_id, sum(clicked) AS c, count(*) AS n FROM impressions_train GROUP BY 1",
    "grid_positions": """SELECT *, row_number() OVER (PARTITION BY k, reg, display_id ORDER BY prob DESC, ad_id) AS position FROM
        (SELECT CAST(d.k AS INTEGER) AS k, CAST(d.reg AS INTEGER) AS reg, v.*, coalesce(s.c / (s.n + CAST(d.reg AS DOUBLE)), d.d) AS prob
         FROM valid_rows v CROSS JOIN defaults d LEFT JOIN ad_sums s ON s.ad_id = v.ad_id) t""",
}


def valid_rows(v):
    days = v.events_derived.select("display_id", ((F.col("day") - 1) % 13 + 1).cast("int").alias("day"))
    return v.split_impressions.where("part = 'valid'").select("display_id", "ad_id", "clicked").join(days, "display_id")


@query("ev_baseline_grid", ranges_sql(B.DEFAULT_DAY_RANGES, "grid_positions", "k, reg"), **GRID)
def _(v):
    return rounded(B.baseline_grid_map(v.impressions_train, valid_rows(v), _KS, _RS, one_click=True), "map12")


@query("ev_ranked_list", "SELECT display_id, string_agg(CAST(ad_id AS VARCHAR), ' ' ORDER BY prob DESC, ad_id) AS ad_id FROM scores GROUP BY 1")
def _(v):
    return K.ranked_lists(v.scores)


SUBMISSION = """SELECT display_id, string_agg(CAST(ad_id AS VARCHAR), ' ' ORDER BY prob DESC, ad_id) AS ad_id FROM
  (SELECT t.display_id, t.ad_id, coalesce(r.prob, (SELECT sum(clicked) / (count(*) + 4.0) FROM impressions_train WHERE ad_id NOT IN (SELECT ad_id FROM impressions_test))) AS prob
   FROM impressions_test t LEFT JOIN (SELECT ad_id, sum(clicked) / (count(*) + 4.0) AS prob FROM impressions_train GROUP BY 1) r USING (ad_id)) s GROUP BY 1"""


@query("ev_baseline_submission", SUBMISSION)
def _(v):
    return K.ranked_lists(B.baseline_scores(v.impressions_train, v.impressions_test, k=2, reg=4))
