"""Writers: submission lists, batch and cohort tables, text forms, metric and importance logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.scalars import sparse_text


def submission_csv(lists: DataFrame, path: str, group: str = "display_id") -> None:
    """(group, list) in group order. Files are range-sorted parts with a header each."""
    lists.orderBy(group).write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path)


def libsvm(df: DataFrame, path: str, label: str, columns: Sequence[str]) -> None:
    """Sparse label / index:value lines; nulls count as zero and zeros are dropped."""
    filled = df.select(F.col(label).cast("double").alias("label"), *columns).fillna(0, subset=list(columns))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(filled)
    vectors.select("label", "features").write.mode("overwrite").format("libsvm").save(path)


def libsvm_lines(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """The same lines as a text column."""
    return df.select(F.concat_ws(" ", F.col(label).cast("string"), sparse_text(columns)).alias("value"))


def partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One directory per value of ``by``.

    Rows are rebalanced by those columns: adaptive execution splits a hot value over many tasks and
    joins small ones, so files come out near the advisory size.
    """
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write the partitions that ``df`` has rows for in place of the stored ones; all others stay as they are.

    So a batch that was broken off, or whose rows have changed, is written again by itself.
    """
    rows = df.hint("rebalance", *[F.col(c) for c in by])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def fixed_parts_json(df: DataFrame, path: str, parts: int = 4) -> None:
    df.repartition(parts).write.mode("overwrite").json(path)


def named_split(df: DataFrame, path: str, cohort: str, seed: int, ratio: float) -> None:
    """Train and valid rows under cohort, seed, ratio and part."""
    tagged = df.withColumns({"seed": F.lit(seed), "ratio": F.lit(ratio)})
    partitioned(tagged, path, [cohort, "seed", "ratio", "part"])


def log_metrics(spark: SparkSession, path: str, run: str, metrics: Mapping[str, float]) -> None:
    """Append (run, key, value) rows; a handful per run."""
    rows = [(run, k, float(x)) for k, x in metrics.items()]
    spark.createDataFrame(rows, "run string, key string, value double").coalesce(1).write.mode("append").parquet(path)


def log_importance(importance: DataFrame, path: str, model: str) -> None:
    """Append (model, feature, gain, cover, frequency)."""
    importance.select(F.lit(model).alias("model"), "feature", "gain", "cover", "frequency").write.mode("append").parquet(path)


def probabilities(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Keyed scores as ``csv`` or ``parquet``."""
    writer = scores.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
