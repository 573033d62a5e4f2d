"""Split and sample queries."""

from pyspark.sql import functions as F

from clickloom.catalog.registry import query
from clickloom.operators import splits as P

RANKED = "SELECT display_id, row_number() OVER (ORDER BY md5('1:' || CAST(display_id AS VARCHAR)), display_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT display_id FROM impressions) d"


@query("spl_random_blocks", "SELECT i.display_id, ad_id, CAST(floor((rn - 1) * 16.0 / n) + 1 AS INTEGER) AS block FROM impressions i JOIN ranked USING (display_id)", ranked=RANKED)
def _(v):
    return P.random_blocks(v.impressions.select("display_id", "ad_id"), "display_id", 16, ids=v.display_ids)


@query(
    "spl_ordered_blocks",
    """SELECT display_id, block, CAST(floor((row_number() OVER (PARTITION BY block ORDER BY display_id) - 1) * 4.0 / count(*) OVER (PARTITION BY block)) + 1 AS INTEGER) AS sub_block
       FROM (SELECT display_id, CAST(floor((row_number() OVER (ORDER BY display_id) - 1) * 8.0 / count(*) OVER ()) + 1 AS INTEGER) AS block
             FROM (SELECT DISTINCT display_id FROM impressions) d) t""",
)
def _(v):
    return P.ordered_sub_blocks(v.impressions.select("display_id").distinct(), "display_id", 8, 4)


@query("spl_sample_groups", "SELECT i.display_id, ad_id FROM impressions i JOIN ranked USING (display_id) WHERE rn <= floor(0.1 * n)", ranked=RANKED)
def _(v):
    return P.sample_groups(v.impressions.select("display_id", "ad_id"), "display_id", 0.1, ids=v.display_ids)


@query("spl_train_valid", "SELECT i.display_id, ad_id, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'valid' END AS part FROM impressions i JOIN ranked USING (display_id)", ranked=RANKED)
def _(v):
    return P.train_valid(v.impressions.select("display_id", "ad_id"), "display_id", 0.8, ids=v.display_ids)


@query(
    "spl_day_balanced",
    """WITH days AS (SELECT DISTINCT display_id, day FROM scores), h AS (SELECT *, md5('1:' || CAST(display_id AS VARCHAR)) AS h FROM days),
       early AS (SELECT *, row_number() OVER (ORDER BY h, display_id) AS rn FROM h WHERE day < 12),
       kept AS (SELECT display_id, h FROM h WHERE day >= 12 UNION ALL SELECT display_id, h FROM early WHERE rn <= (SELECT count(*) FROM h WHERE day >= 12)),
       r AS (SELECT display_id, row_number() OVER (ORDER BY h, display_id) AS rn, count(*) OVER () AS n FROM kept)
       SELECT s.display_id, s.ad_id, s.day, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'valid' END AS part FROM scores s JOIN r USING (display_id)""",
)
def _(v):
    return P.day_balanced(v.scores.select("display_id", "ad_id", "day"), "display_id", "day")


@query("spl_row_cap", "SELECT i.display_id, ad_id FROM impressions i JOIN ranked USING (display_id) WHERE rn <= trunc(20000.0 / (SELECT count(*) FROM impressions) * n)", ranked=RANKED)
def _(v):
    return P.row_capped(v.impressions.select("display_id", "ad_id"), "display_id", 20000, ids=v.display_ids)


@query(
    "spl_accumulate_to_cap",
    """WITH b AS (SELECT CAST(floor((rn - 1) * 16.0 / n) + 1 AS INTEGER) AS block, count(*) AS rows FROM impressions JOIN ranked USING (display_id) GROUP BY 1),
       c AS (SELECT *, CAST(sum(rows) OVER (ORDER BY block) AS BIGINT) AS running FROM b) SELECT block, rows, running FROM c WHERE running - rows <= 30000""",
    ranked=RANKED,
)
def _(v):
    blocks = P.random_blocks(v.impressions.select("display_id"), "display_id", 16, ids=v.display_ids)
    sizes = blocks.groupBy("block").agg(F.count("*").alias("rows"))
    return P.accumulate_to_cap(sizes, "block", "rows", 30000)


@query("spl_kfold", "SELECT i.display_id, ad_id, CAST(rn % 4 AS INTEGER) AS fold FROM impressions i JOIN ranked USING (display_id)", ranked=RANKED)
def _(v):
    return P.kfold(v.impressions.select("display_id", "ad_id"), "display_id", 4)


@query("spl_tail_validation", "SELECT i.display_id, ad_id, CASE WHEN rn <= floor((1 - 0.15) * n) THEN 'train' ELSE 'valid' END AS part FROM impressions i JOIN ranked USING (display_id)", ranked=RANKED)
def _(v):
    return P.tail_validation(v.impressions.select("display_id", "ad_id"), "display_id", 0.15, ids=v.display_ids)
