"""Column-set work: choosing, renaming, dropping and filling columns by name, pattern or type."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prefix every column but those in ``keep``."""
    return df.select([F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_if_exists(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def matching(df: DataFrame, pattern: str, invert: bool = False) -> list[str]:
    """Column names in which the pattern occurs (or does not occur)."""
    return [c for c in df.columns if bool(re.search(pattern, c)) != invert]


def select_matching(df: DataFrame, pattern: str, invert: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    chosen = set(matching(df, pattern, invert)) | set(keep)
    return df.select([c for c in df.columns if c in chosen])


def move_first(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names, *[c for c in df.columns if c not in names])


def non_string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind != "string"]


def drop_strings(df: DataFrame) -> DataFrame:
    return df.select(non_string_columns(df))


def update_where(df: DataFrame, column: str, condition: Column, value) -> DataFrame:
    """Replace a column's value where the condition holds."""
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def fill_zero(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(names) if names is not None else None)


def label_or_zero(df: DataFrame, label: str = "clicked") -> DataFrame:
    """The label column, 0 where it is null or the table has none."""
    value = F.coalesce(F.col(label), F.lit(0)) if label in df.columns else F.lit(0)
    return df.withColumn(label, value.cast("int"))


def generated(df: DataFrame, keep: Sequence[str], template: str, columns: Sequence[str], name: str) -> DataFrame:
    """One expression per column from a template, all in a single projection.

    ``template`` and ``name`` are format strings with ``{c}`` for the column.
    """
    return df.select(*keep, *[F.expr(template.format(c=c)).alias(name.format(c=c)) for c in columns])


def keep_first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """First row per key. Spark prunes to one row per key in every map task before the shuffle."""
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")
