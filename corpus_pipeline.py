"""From raw documents to packed training sequences: language, near-duplicates, personal data, mixing, packing.

Every stage takes the documents its predecessor kept and returns documents again; the last returns packed pieces. Null
texts are rejected by the language stage (nothing can be read in them); null ids and repeated rows pass through every
stage by the rules that the operators state. Extra columns of documents stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, prepare
from clickloom.llm.language import UNKNOWN, fit_on, predict
from clickloom.llm.mixing import mix
from clickloom.llm.near_dup import near_duplicates
from clickloom.llm.packing import pack
from clickloom.llm.pii import redact

#: Documents whose sets of five-word shingles are as similar as this are near duplicates here; op1's limit is its own.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others (no text, or no letter in it) go."""
    prepare(spark)
    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return predict(whole, fit_on(docs)).where(F.col("lang_pred") != UNKNOWN).select("row.*")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (a Jaccard similarity of 0.8 or more, linked transitively), the one with
    the smallest id; of rows with the same id, one."""
    prepare(spark)
    scratch = Scratch(spark, "stage-near-dup")
    marks = scratch.write(near_duplicates(docs, percent=NEAR_PERCENT))
    ids = scratch.write(
        marks.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().withColumnRenamed("count", "_rows")
    )
    named = docs.where(F.col("doc_id").isNotNull())
    # Texts meet ids in a merge join at every size, so that cost grows with the input alone.
    once = named.join(ids.where("_rows = 1").select("doc_id").hint("merge"), "doc_id", "left_semi").select(docs.columns)
    out = once.union(docs.where(F.col("doc_id").isNull()))
    if ids.where("_rows > 1").limit(1).count():
        again = named.join(ids.where("_rows > 1").select("doc_id"), "doc_id", "left_semi")
        one = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("_row"))
        out = out.union(one.select("_row.*"))
    return out


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the kind in place of each span of personal data; n_chars follows the text."""
    prepare(spark)
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source wants it: not at all, once or twice."""
    prepare(spark)
    scratch = Scratch(spark, "stage-mix")
    keyed = scratch.write(docs.withColumn("_key", F.monotonically_increasing_id()))
    copies = mix(keyed, key="_key").where("copies > 0").select(F.col("key").alias("_key"), F.col("copies").alias("_copies"))
    times = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_n")
    return keyed.join(copies.select("_key", times).hint("merge"), "_key").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("language", language), ("near_dup", near_dup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(prepare(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        if id(before) in scratch.paths:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
