"""Readers: CSV with declared or inferred types, text lines, nested text, reports, batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.scalars import strip_quotes
from clickloom.session import is_complete

# Column types of the page-view log; fixed by the published files.
PAGE_VIEW_SCHEMA = "uuid bigint, document_id bigint, ts bigint, platform int, geo_location string, traffic_source int"


def typed_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def inferred_csv(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Types guessed from the data (one more scan); use ``typed_csv`` for large files."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.toDF(*names) if names else df


def csv_without_malformed(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows that do not fit the schema are left out, whichever columns are read later."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("columnPruning", "false").csv(path, header=header)


def lines_without_header(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files but the first line of each, as ``value``; empty lines are left out.

    Read as a table of one column whose separator and quote do not occur, so a data line that equals the header stays.
    """
    options = {"header": True, "sep": "\u0001", "quote": "", "escape": "", "mode": "PERMISSIVE"}
    return spark.read.options(**options).schema("value string").csv(path)


def malformed_rows(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """The raw lines that ``csv_without_malformed`` leaves out."""
    lines = lines_without_header(spark, path) if header else spark.read.text(path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.select(F.from_csv("value", f"{schema}, _corrupt_record string", options).alias("r"))
    return parsed.where("r._corrupt_record IS NOT NULL").select("r._corrupt_record")


def schema_from_header(header: str, integers: Sequence[str], strings: Sequence[str]) -> T.StructType:
    """Schema from a header line: named integer and string columns, the rest double."""
    def kind(name: str) -> T.DataType:
        return T.LongType() if name in integers else T.StringType() if name in strings else T.DoubleType()

    return T.StructType([T.StructField(n, kind(n)) for n in header.replace('"', "").split(",")])


def csv_by_header(spark: SparkSession, path: str, integers: Sequence[str], strings: Sequence[str]) -> DataFrame:
    header = spark.read.text(path).first()["value"]
    return typed_csv(spark, path, schema_from_header(header, integers, strings))


def text_fields(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Lines without the header and without quotes, split at commas into text columns."""
    lines = lines_without_header(spark, path)
    parts = F.split(strip_quotes("value"), ",")
    return lines.select(*[parts[i].alias(n) for i, n in enumerate(names)])


def first_rows(df: DataFrame, order_by: Sequence[str], n: int = 2500) -> DataFrame:
    """The first n rows by key (a top-n, no full sort)."""
    return df.orderBy(*order_by).limit(n)


def batch(spark: SparkSession, path: str, number: int, sub: int | None = None, column: str = "block") -> DataFrame:
    """One batch (and sub-batch) of a partitioned table; other partitions are not listed into the scan."""
    df = spark.read.parquet(path).where(F.col(column) == number)
    return df if sub is None else df.where(F.col(f"sub_{column}") == sub)


def union_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parts of a split stacked by column name; a column missing in a part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def parquet_or_csv(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """``base.parquet`` if it was written to the end; else ``base.csv``, converted on the way."""
    if not is_complete(spark, f"{base}.parquet"):
        typed_csv(spark, f"{base}.csv", schema).write.mode("overwrite").parquet(f"{base}.parquet")
    return spark.read.parquet(f"{base}.parquet")


def nested_text(spark: SparkSession, path: str, schema: str = "x array<array<double>>, y array<double>") -> DataFrame:
    """Text lines that hold nested lists, parsed as data (never evaluated)."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def report(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """(position, name, gain) of a tab report: ``skip`` lines, then rows numbered 1, 2, ... until another block.

    Rows before the first line whose number or gain is no number count; line order is the order of one text file.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    rows = lines.select(
        "line", F.try_element_at(parts, F.lit(1)).try_cast("int").alias("position"),
        F.try_element_at(parts, F.lit(2)).alias("name"), F.try_element_at(parts, F.lit(3)).try_cast("double").alias("gain"),
    ).where(F.col("line") >= skip)
    bad = rows.where(F.col("position").isNull() | F.col("gain").isNull()).agg(F.min("line")).scalar()
    return rows.where(bad.isNull() | (F.col("line") < bad)).select("position", "name", "gain")


def scan_page_views(spark: SparkSession, path: str, users: DataFrame, country_id: Column) -> DataFrame:
    """The log of known users, projected to the columns that are kept. One split scan; the filter comes first."""
    views = typed_csv(spark, path, PAGE_VIEW_SCHEMA)
    kept = views.join(users.select("uuid").distinct(), "uuid", "left_semi")
    return kept.select("uuid", "document_id", "platform", "traffic_source", country_id.alias("country_id"), "ts")
