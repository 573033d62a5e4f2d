"""The click-log tables as views over the star-schema Parquet tables.

Each view exists as a DataFrame (``Views``) and, in ``views_sql``, as SQL text with the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.scalars import epoch_ms
from clickloom.operators.aggregates import smoothed_rate
from clickloom.operators.splits import train_valid
from clickloom.plans.wide import derive_event_columns, derive_publish_ts, wide_impressions
from clickloom.session import prepare_session

SPLIT_SEED = 1234


class Views:
    """Lazy access to the raw tables (``v.table('orders')``) and to the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare_session(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def impressions(self) -> DataFrame:
        lines = self.table("lineitem")
        items = lines.groupBy(
            F.col("l_orderkey").alias("display_id"), F.col("l_partkey").alias("ad_id")
        ).agg(F.max("l_extendedprice").alias("price"))
        winner = lines.groupBy(F.col("l_orderkey").alias("display_id")).agg(
            F.max(F.struct(F.col("l_extendedprice").alias("price"), (-F.col("l_partkey")).alias("neg_ad"))).alias("top")
        )
        return items.join(winner, "display_id").select(
            "display_id",
            "ad_id",
            "price",
            F.when(F.col("ad_id") == -F.col("top.neg_ad"), 1).otherwise(0).alias("clicked"),
        )

    @cached_property
    def display_ids(self) -> DataFrame:
        """The displays of ``impressions``, repeated; needs no join."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("display_id"))

    @cached_property
    def split_impressions(self) -> DataFrame:
        """``impressions`` with ``part`` = train or valid, by display (80 / 20)."""
        return train_valid(self.impressions, "display_id", 0.8, seed=SPLIT_SEED, ids=self.display_ids)

    @cached_property
    def impressions_train(self) -> DataFrame:
        return self.split_impressions.where("part = 'train'").drop("part")

    @cached_property
    def impressions_test(self) -> DataFrame:
        return self.split_impressions.where("part = 'valid'").select("display_id", "ad_id")

    @cached_property
    def n_documents(self) -> int:
        return self.table("documents").count()  # answered from the Parquet footers

    @cached_property
    def display_events(self) -> DataFrame:
        orders = self.table("orders")
        start = orders.agg(F.min(epoch_ms("o_orderdate"))).first()[0]
        country = (
            F.when(F.col("r_name") == "AMERICA", "US")
            .when(F.col("r_name") == "EUROPE", "GB")
            .when(F.col("r_name") == "ASIA", "CA")
            .otherwise(F.col("r_name"))
        )
        return (
            orders.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("o_orderkey").alias("display_id"),
                F.col("o_custkey").alias("uuid"),
                (F.col("o_orderkey") % F.lit(self.n_documents)).alias("document_id"),
                (epoch_ms("o_orderdate") - F.lit(start)).alias("ts"),
                F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END").alias("platform"),
                F.concat_ws(">", country, "n_name", "c_mktsegment").alias("geo_location"),
            )
        )

    @cached_property
    def events_derived(self) -> DataFrame:
        return derive_event_columns(self.display_events)

    @cached_property
    def promoted(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("ad_id"),
            (F.col("p_partkey") % F.lit(self.n_documents)).alias("document_id"),
            F.col("p_type").alias("campaign_id"),
            F.col("p_brand").alias("advertiser_id"),
        )

    @cached_property
    def doc_meta(self) -> DataFrame:
        day = F.date_add(F.lit("1999-06-01").cast("date"), F.col("doc_id").cast("int"))
        text = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00:00"))
        return self.table("documents").select(
            F.col("doc_id").alias("document_id"),
            F.col("source").alias("source_id"),
            F.col("lang").alias("publisher_id"),
            F.when(F.col("doc_id") % 7 == 0, "").otherwise(text).alias("publish_time"),
        )

    @cached_property
    def doc_meta_derived(self) -> DataFrame:
        return derive_publish_ts(self.doc_meta)

    @cached_property
    def page_views(self) -> DataFrame:
        events = self.table("events")
        start = events.agg(F.min(epoch_ms("ts"))).first()[0]
        return events.select(
            F.col("user_id").alias("uuid"),
            F.get_json_object("props", "$.k").cast("bigint").alias("document_id"),
            (epoch_ms("ts") - F.lit(start)).alias("ts"),
            (F.col("event_id") % 3 + 1).cast("int").alias("platform"),
            F.concat(
                F.expr("element_at(array('US','CA','GB','ES','MX'), cast(user_id % 5 as int) + 1)"),
                F.lit(">S"),
                (F.col("user_id") % 10).cast("string"),
            ).alias("geo_location"),
            F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
            .alias("traffic_source"),
        )

    @cached_property
    def wide(self) -> DataFrame:
        return wide_impressions(self.impressions.drop("price"), self.display_events, self.promoted, self.doc_meta)

    @cached_property
    def scores(self) -> DataFrame:
        """Impressions scored by the smoothed click rate of the ad, with the day 1..13 of the display."""
        rate = smoothed_rate(self.impressions, "ad_id", "clicked", reg=4).select("ad_id", "prob")
        days = self.events_derived.select("display_id", ((F.col("day") - 1) % 13 + 1).cast("int").alias("day"))
        return (
            self.impressions.join(rate, "ad_id")
            .join(days, "display_id")
            .select("display_id", "ad_id", "clicked", "prob", "day")
        )

    def doc_types(self, kind: str) -> DataFrame:
        """(document_id, type_id, confidence_level); kind is topic, entity or category."""
        word = F.col("word")
        type_id = {"topic": F.substring(word, 1, 2), "entity": word, "category": F.substring(word, 1, 1)}[kind]
        texts = self.table("documents").select(
            F.col("doc_id").alias("document_id"), F.filter(F.split(F.lower("text"), " "), lambda w: w != "").alias("words")
        )
        # The text's word count travels with each word, so no second aggregate is joined back.
        words = texts.select("document_id", F.size("words").alias("all_n"), F.explode("words").alias("word"))
        counts = words.groupBy("document_id", "all_n", type_id.alias("type_id")).agg(F.count("*").alias("n"))
        return counts.select("document_id", "type_id", (F.col("n") / F.col("all_n")).alias("confidence_level"))
