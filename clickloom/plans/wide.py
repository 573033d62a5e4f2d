"""The wide impression table: impressions, events, promoted items and document metadata in two roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.functions.columns import prefix_columns
from clickloom.session import materialise

# The ten keys that get a profile; the last five belong to the ad.
PAGE_KEYS = ("uuid", "document_id", "source_id", "publisher_id", "publish_ts")
AD_KEYS = ("ad_id", "ad_document_id", "ad_source_id", "ad_publisher_id", "ad_publish_ts")
PROFILE_KEYS = PAGE_KEYS + AD_KEYS


def derive_event_columns(events: DataFrame) -> DataFrame:
    """Country, country group, hour and day of each display."""
    country = S.geo_part("geo_location", 1)
    return events.select(
        "*",
        country.alias("country"),
        S.country_group(country).alias("country_group"),
        S.hour_of_day("ts").alias("hour"),
        S.day_of_log("ts").alias("day"),
    )


def derive_publish_ts(meta: DataFrame, year_filter: bool = True) -> DataFrame:
    return meta.select(
        "document_id", "source_id", "publisher_id", S.publish_offset("publish_time", year_filter).alias("publish_ts")
    )


def join_ad_columns(impressions: DataFrame, promoted: DataFrame) -> DataFrame:
    """Impressions with the ad's document, campaign and advertiser, prefixed ``ad_``."""
    return impressions.join(prefix_columns(promoted, "ad_", keep=("ad_id",)), "ad_id")


def join_document_roles(df: DataFrame, meta: DataFrame) -> DataFrame:
    """The same document table joined as page document and as ad document."""
    as_ad = prefix_columns(meta, "ad_")
    return df.join(meta, "document_id").join(as_ad, "ad_document_id")


def wide_impressions(impressions: DataFrame, events: DataFrame, promoted: DataFrame, meta: DataFrame) -> DataFrame:
    """All base joins in one plan.

    Document metadata meets the displays and the items that name the documents, each far fewer than the impressions, so
    these rows move for their display and their item only; what follows from a display's columns is derived at the end.
    The items are written, so their size is known. No broadcast hints: Spark broadcasts a side when its size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and else sort-merges, splitting skewed keys.
    """
    meta = derive_publish_ts(meta)
    items = materialise(promoted.join(meta, "document_id"))
    df = impressions.join(events.join(meta, "document_id"), "display_id")
    df = derive_event_columns(join_ad_columns(df, items))
    return df.select(
        "display_id", "ad_id", "clicked", "uuid", "document_id", "ts", "platform", "geo_location", "country",
        "country_group", "hour", "day", "source_id", "publisher_id", "publish_ts", "ad_document_id",
        "ad_campaign_id", "ad_advertiser_id", "ad_source_id", "ad_publisher_id", "ad_publish_ts",
    )
