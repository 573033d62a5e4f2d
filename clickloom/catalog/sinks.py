"""Sink queries: write with the operator, return what a reader finds."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clickloom.catalog.evaluation import POSITIONS, SUBMISSION
from clickloom.catalog.registry import query
from clickloom.operators.ranks import group_totals
from clickloom.operators.splits import random_blocks, sample_groups
from clickloom.plans import baseline as B
from clickloom.plans import ranking as K
from clickloom.session import fresh_dir, materialise
from clickloom.sources import readers as R
from clickloom.sources import writers as O
from clickloom.sources.stages import StageStore
from clickloom.catalog.splits import RANKED

SIZED = "SELECT display_id, ad_id, clicked, count(*) OVER (PARTITION BY display_id) AS num_ads FROM impressions"


def sized(v):
    return group_totals(v.impressions.drop("price"), ["display_id"], {"num_ads": F.count("*")})


@query("snk_submission_csv", SUBMISSION)
def _(v):
    path = fresh_dir(v.spark, "submission")
    O.submission_csv(K.ranked_lists(B.baseline_scores(v.impressions_train, v.impressions_test)), path)
    return R.typed_csv(v.spark, path, "display_id bigint, ad_id string")


@query("snk_append_csv", "SELECT uuid, document_id, ts FROM page_views WHERE platform < 3")
def _(v):
    path = fresh_dir(v.spark, "append")
    for platform in (1, 2):
        O.append_csv(v.page_views.where(F.col("platform") == platform).select("uuid", "document_id", "ts"), path)
    return R.typed_csv(v.spark, path, "uuid bigint, document_id bigint, ts bigint", header=False)


@query("snk_libsvm", "SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, [l_linenumber::DOUBLE, l_quantity, l_discount, l_tax] AS features FROM lineitem")
def _(v):
    rows = v.table("lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    path = fresh_dir(v.spark, "libsvm")
    O.libsvm(rows, path, "label", ["l_linenumber", "l_quantity", "l_discount", "l_tax"])
    back = v.spark.read.format("libsvm").option("numFeatures", 4).load(path)
    return back.select("label", vector_to_array("features").alias("features"))


@query("snk_batch_table", "SELECT i.display_id, ad_id, clicked, CAST(floor((rn - 1) * 8.0 / n) + 1 AS INTEGER) AS block FROM impressions i JOIN ranked USING (display_id)", ranked=RANKED)
def _(v):
    """Eight batches, of which one lacks half of its rows at first and is written again; all rows are read back."""
    path = fresh_dir(v.spark, "batch-table")
    rows = random_blocks(materialise(v.impressions.drop("price")), "display_id", 8)
    O.partitioned(rows.where("block <> 3 OR ad_id % 2 = 0"), path, ["block"])
    O.replace_partitions(rows.where("block = 3"), path, ["block"])
    return v.spark.read.parquet(path)


@query(
    "snk_cohort_partitions",
    """SELECT s.display_id, ad_id, clicked, CAST(num_ads AS INTEGER) AS num_ads, CAST(floor((rn - 1) * 4.0 / n) + 1 AS INTEGER) AS block
       FROM sized s JOIN ranked USING (display_id) WHERE num_ads BETWEEN 2 AND 12""",
    ranked=RANKED, sized=SIZED,
)
def _(v):
    """Cohort by batch; one batch of one cohort is first written without its clicks, then again by itself."""
    path = fresh_dir(v.spark, "cohorts")
    rows = random_blocks(materialise(sized(v)), "display_id", 4).where(F.col("num_ads").between(2, 12))
    one = (F.col("num_ads") == 5) & (F.col("block") == 2)
    O.partitioned(rows.where(~(one & (F.col("clicked") == 1))), path, ["num_ads", "block"])
    O.replace_partitions(rows.where(one), path, ["num_ads", "block"])
    return v.spark.read.parquet(path)


@query("snk_fixed_parts_text", "SELECT display_id, ad_id, clicked::BIGINT AS clicked, CAST(4 AS BIGINT) AS parts FROM impressions")
def _(v):
    path = fresh_dir(v.spark, "parts-json")
    O.fixed_parts_json(v.impressions.drop("price"), path, 4)
    back = v.spark.read.schema("display_id bigint, ad_id bigint, clicked bigint").json(path)
    parts = back.select(F.input_file_name().alias("f")).agg(F.count_distinct("f")).scalar()
    return back.withColumn("parts", parts)


@query("snk_train_valid_named", "SELECT display_id, ad_id, clicked, part, CAST(num_ads AS INTEGER) AS num_ads, CAST(1234 AS INTEGER) AS seed, 0.8::DOUBLE AS ratio FROM (SELECT *, count(*) OVER (PARTITION BY display_id) AS num_ads FROM split_impressions) t")
def _(v):
    path = fresh_dir(v.spark, "named-split")
    rows = group_totals(v.split_impressions.drop("price"), ["display_id"], {"num_ads": F.count("*")})
    O.named_split(rows, path, "num_ads", 1234, 0.8)
    return v.spark.read.parquet(path)


@query(
    "snk_metrics_log",
    """SELECT 'baseline' AS run, 'map' AS key, round(avg(1.0 / position), 8) AS value FROM positions WHERE clicked = 1
       UNION ALL SELECT 'baseline', 'clicks', CAST(count(*) AS DOUBLE) FROM positions WHERE clicked = 1
       UNION ALL SELECT 'data', 'rows', CAST(count(*) AS DOUBLE) FROM impressions""",
    positions=POSITIONS,
)
def _(v):
    path = fresh_dir(v.spark, "metrics")
    m = K.map_single(v.scores, one_click=True).first()
    O.log_metrics(v.spark, path, "baseline", {"map": m["map"], "clicks": m["clicks"]})
    O.log_metrics(v.spark, path, "data", {"rows": v.impressions.count()})
    return v.spark.read.parquet(path).withColumn("value", F.round("value", 8))


@query("snk_probabilities", "SELECT display_id, ad_id, round(prob, 6) AS prob FROM scores")
def _(v):
    base = fresh_dir(v.spark, "probabilities")
    rows = v.scores.select("display_id", "ad_id", F.round("prob", 6).alias("prob"))
    O.probabilities(rows, f"{base}.parquet")
    O.probabilities(v.spark.read.parquet(f"{base}.parquet"), f"{base}.csv", "csv")
    return R.typed_csv(v.spark, f"{base}.csv", "display_id bigint, ad_id bigint, prob double")


@query("snk_debug_sample", "SELECT i.display_id, ad_id, clicked FROM impressions i JOIN ranked USING (display_id) WHERE rn <= floor(0.01 * n)", ranked=RANKED)
def _(v):
    base = fresh_dir(v.spark, "debug")
    sample = sample_groups(v.impressions.drop("price"), "display_id", 0.01)
    sample.write.option("header", True).csv(f"{base}.csv")
    return R.parquet_or_csv(v.spark, base, "display_id bigint, ad_id bigint, clicked int")


@query("snk_stage_skip", "SELECT display_id, ad_id, num_ads, CAST(1 AS INTEGER) AS computed FROM sized", sized=SIZED)
def _(v):
    stages = StageStore(v.spark)
    runs = []

    def compute():
        runs.append(1)
        return sized(v).drop("clicked")

    stages.get("num_ads", compute, columns=["num_ads"])
    again = stages.get("num_ads", compute, columns=["num_ads"])  # found, not computed
    return again.withColumn("computed", F.lit(len(runs)))
